"""Source and target comparison: both sides stay DataFrames, only bounded summaries are small."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize
from .ordering import Order, dense_ordinal, marked_cell, row_mark, rows_of_marks
from .quality import FAILED, PASSED
from .sets import differing_counts, fingerprints, row_counts

MATCH = "Match"
NO_MATCH = "Do Not Match"


class RepeatedKeys(ValueError):
    """A cell comparison needs keys that are unique on both sides."""


# --- schemas ----------------------------------------------------------------


def schema_differences(left: DataFrame, right: DataFrame) -> list[tuple]:
    """``(position, left_name, left_type, right_name, right_type)`` where names or types differ in order."""
    l, r = left.dtypes, right.dtypes
    found = []
    for i in range(max(len(l), len(r))):
        a = l[i] if i < len(l) else (None, None)
        b = r[i] if i < len(r) else (None, None)
        if a != b:
            found.append((i + 1, *a, *b))
    return found


def schema_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.sparkSession.createDataFrame(
        schema_differences(left, right),
        "position int, left_name string, left_type string, right_name string, right_type string",
    )


# --- whole tables and rows --------------------------------------------------


def row_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with ``side`` and the number of ``copies`` in excess."""
    excess = F.col("left_n") - F.col("right_n")
    return (
        row_counts(left, right)
        .where("left_n <> right_n")
        .withColumn("side", F.when(excess > 0, F.lit("left")).otherwise(F.lit("right")))
        .withColumn("copies", F.abs(excess))
        .drop("left_n", "right_n")
    )


def row_diff_shown(left: DataFrame, right: DataFrame, shown: int = 10) -> DataFrame:
    """The first differing rows for a reader; :func:`row_diff` has them all."""
    found = row_diff(left, right)
    return found.orderBy("side", *[f"`{c}`" for c in left.columns]).limit(shown)


def row_diff_summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: sizes of both sides and the number of rows in excess on each.

    Sizes come from the rows' fingerprints, and only rows of buckets that differ are shuffled.
    """
    sizes = fingerprints(left, right).agg(
        F.coalesce(F.sum("left_n"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("right_n"), F.lit(0)).alias("right_rows")
    )
    excess = differing_counts(left, right).agg(
        F.coalesce(F.sum(F.greatest(F.col("left_n") - F.col("right_n"), F.lit(0))), F.lit(0)).alias("left_only"),
        F.coalesce(F.sum(F.greatest(F.col("right_n") - F.col("left_n"), F.lit(0))), F.lit(0)).alias("right_only"),
    )
    # One row each.
    return sizes.withColumns({c: excess.select(c).scalar() for c in ("left_only", "right_only")}).withColumn(
        "mismatches", F.col("left_only") + F.col("right_only")
    )


def table_equality(left: DataFrame, right: DataFrame, name: str = "table") -> DataFrame:
    """One row ``name, result, left_rows, right_rows, mismatches``: equal schemas and equal rows in any order."""
    if schema_differences(left, right):
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        tagged = left.select(one.alias("_l"), none.alias("_r")).union(right.select(none.alias("_l"), one.alias("_r")))
        sizes = tagged.agg(
            F.coalesce(F.sum("_l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("_r"), F.lit(0)).alias("right_rows")
        )
        return sizes.select(
            F.lit(name).alias("name"),
            F.lit(NO_MATCH).alias("result"),
            "left_rows",
            "right_rows",
            F.lit(None).cast("bigint").alias("mismatches"),
        )
    summary = row_diff_summary(left, right)
    return summary.select(
        F.lit(name).alias("name"),
        F.when(F.col("mismatches") == 0, F.lit(MATCH)).otherwise(F.lit(NO_MATCH)).alias("result"),
        "left_rows",
        "right_rows",
        "mismatches",
    )


def as_check(equality: DataFrame, suite: str = "reconciliation") -> DataFrame:
    """A :func:`table_equality` row as a check result row."""
    return equality.select(
        F.lit(suite).alias("suite"),
        F.concat(F.lit("equal:"), F.col("name")).alias("check"),
        F.when(F.col("result") == MATCH, F.lit(PASSED)).otherwise(F.lit(FAILED)).alias("outcome"),
        F.concat_ws(
            " ",
            F.concat(F.lit("left="), F.col("left_rows")),
            F.concat(F.lit("right="), F.col("right_rows")),
            F.concat(F.lit("mismatches="), F.coalesce(F.col("mismatches").cast("string"), F.lit("schema"))),
        ).alias("evidence"),
    )


def table_set_report(left: Mapping[str, DataFrame], right: Mapping[str, DataFrame]) -> DataFrame:
    """``name, result, left_rows, right_rows, mismatches`` for every table name of either set.

    A name on one side only is reported as missing, with the rows of the side that has it.
    """
    lines = []
    for name in sorted({*left, *right}):
        if name in left and name in right:
            lines.append(table_equality(left[name], right[name], name))
        else:
            present, side, other = (left[name], "right", "left") if name in left else (right[name], "left", "right")
            lines.append(
                present.agg(F.count(F.lit(1)).alias(f"{other}_rows")).select(
                    F.lit(name).alias("name"),
                    F.lit(f"Missing in {side}").alias("result"),
                    *[F.col(c) if c == f"{other}_rows" else F.lit(None).cast("bigint").alias(c) for c in ("left_rows", "right_rows")],
                    F.lit(None).cast("bigint").alias("mismatches"),
                )
            )
    return reduce(DataFrame.unionByName, lines)


# --- cells ------------------------------------------------------------------


def require_unique(df: DataFrame, keys: Sequence[str], side: str) -> None:
    """Raise when a key repeats; counted map-side first, over the key columns only."""
    worst = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if worst and worst > 1:
        raise RepeatedKeys(f"{side}: a key of {list(keys)} occurs {worst} times")


def _cells_differ(left: Column, right: Column, left_type: T.DataType, right_type: T.DataType) -> Column:
    """NULL equals NULL; numbers of different types are compared as numbers, other different types as text."""
    numbers = isinstance(left_type, T.NumericType) and isinstance(right_type, T.NumericType)
    if left_type != right_type and not numbers:
        left, right = left.cast("string"), right.cast("string")
    return ~left.eqNullSafe(right)


def _paired(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with equal keys; a NULL key part equals a NULL key part."""
    require_unique(left, keys, "left")
    require_unique(right, keys, "right")
    l = left.select(*keys, F.struct(*columns).alias("_left"))
    r = right.select(*[F.col(k).alias(f"_{i}_key") for i, k in enumerate(keys)], F.struct(*columns).alias("_right"))
    same = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_{i}_key")) for i, k in enumerate(keys)])
    return l.join(r, same, "inner")


def cell_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, column, left_value, right_value`` for each differing cell of rows with equal keys (NULL equals NULL).

    Both sides must have the same column names.
    """
    if set(left.columns) != set(right.columns):
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    columns = [c for c in left.columns if c not in keys]
    differs = {
        c: _cells_differ(F.col("_left")[c], F.col("_right")[c], left.schema[c].dataType, right.schema[c].dataType)
        for c in columns
    }
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col("_left")[c].cast("string").alias("left_value"),
                F.col("_right")[c].cast("string").alias("right_value"),
                differs[c].alias("_differs"),
            )
            for c in columns
        ]
    )
    paired = _paired(left, right, keys, columns).where(reduce(operator.or_, differs.values()))
    return paired.select(*keys, F.inline(cells)).where("_differs").drop("_differs")


def column_mismatch_count(left: DataFrame, right: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Number of equal-keyed rows whose column differs."""
    paired = _paired(left, right, keys, [column])
    types = (left.schema[column].dataType, right.schema[column].dataType)
    differs = _cells_differ(F.col("_left")[column], F.col("_right")[column], *types)
    return paired.agg(F.count_if(differs).alias("mismatch_count"))


# --- ordered results --------------------------------------------------------


def _common(left: DataFrame, right: DataFrame) -> tuple[list[Column], list[Column]]:
    """The cells of both sides, position by position, as :func:`_cells_differ` compares them."""
    sides: tuple[list[Column], list[Column]] = ([], [])
    for a, b in zip(left.schema.fields, right.schema.fields):
        numbers = isinstance(a.dataType, T.NumericType) and isinstance(b.dataType, T.NumericType)
        if a.dataType == b.dataType:
            kind = a.dataType
        elif numbers:
            both = left.sparkSession.range(0).select(F.coalesce(F.lit(None).cast(a.dataType), F.lit(None).cast(b.dataType)).alias("v"))
            kind = both.schema["v"].dataType
        else:
            kind = T.StringType()
        for side, field in zip(sides, (a, b)):
            cell = F.col(f"`{field.name}`")
            side.append(marked_cell(cell if field.dataType == kind else cell.cast(kind), kind))
    return sides


def _positions(left: DataFrame, right: DataFrame, left_order: Order, right_order: Order) -> DataFrame:
    """``position, status`` and both sides' marks for positions that differ.

    Only 128-bit marks of the rows are sorted, numbered and joined; of rows that differ, about one pair in 2^128 is
    missed. Within nested values -0.0 differs from 0.0.
    """

    def numbered(df: DataFrame, cells: list[Column], order: Order, name: str) -> DataFrame:
        marked = df.withColumn(name, row_mark(cells, name))
        return dense_ordinal(marked, [*order, F.col(f"{name}.a"), F.col(f"{name}.b")], "position", keep=[name])

    cells = _common(left, right)
    source = numbered(left, cells[0], left_order, "_source")
    target = numbered(right, cells[1], right_order, "_target")
    unequal = F.col("_source") != F.col("_target") if len(left.columns) == len(right.columns) else F.lit(True)
    status = (
        F.when(F.col("_target").isNull(), F.lit("source only"))
        .when(F.col("_source").isNull(), F.lit("target only"))
        .when(unequal, F.lit("differs"))
    )
    return source.join(target, "position", "full").withColumn("status", status).where(F.col("status").isNotNull())


def ordered_diff(left: DataFrame, right: DataFrame, left_order: Order, right_order: Order) -> DataFrame:
    """``position, status, source_row, target_row`` for every position where two ordered results differ.

    Rows are compared cell by cell in column position; a position that only
    the longer side has is ``source only`` or ``target only``. Rows that the order leaves open follow their marks.
    Whole rows are read, in a second pass, for differing positions only.
    """
    cells = _common(left, right)
    found = materialize(_positions(left, right, left_order, right_order), "positions")
    for df, own, mark, name in ((left, cells[0], "_source", "source_row"), (right, cells[1], "_target", "target_row")):
        row = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]))
        found = rows_of_marks(df, own, found, mark, row, name)
    return found.select("position", "status", "source_row", "target_row")


def ordered_compare(left: DataFrame, right: DataFrame, left_order: Order, right_order: Order) -> DataFrame:
    """One row with the verdict, both sizes and the number of differing positions.

    Different sizes settle the verdict, so positions are numbered only for equal sizes.
    """
    sizes = (left.count(), right.count())
    if sizes[0] != sizes[1]:
        text = f"Failure: Mismatched number of records (Source: {sizes[0]}, Target: {sizes[1]})"
        return left.sparkSession.range(1).select(
            F.lit(text).alias("verdict"),
            F.lit(sizes[0]).cast("bigint").alias("source_rows"),
            F.lit(sizes[1]).cast("bigint").alias("target_rows"),
            F.lit(None).cast("bigint").alias("differing"),
        )
    found = _positions(left, right, left_order, right_order).agg(F.count(F.lit(1)).alias("differing"))
    return found.select(
        F.when(F.col("differing") == 0, F.lit("Success")).otherwise(F.lit("Failure")).alias("verdict"),
        F.lit(sizes[0]).cast("bigint").alias("source_rows"),
        F.lit(sizes[1]).cast("bigint").alias("target_rows"),
        "differing",
    )


# --- sides of different kinds -----------------------------------------------


def load_side(spark: SparkSession, side: Mapping[str, object]) -> DataFrame:
    """DataFrame of a descriptor.

    ``{"kind": "sql", "query": ...}``, ``{"kind": "table", "name": ...}``,
    ``{"kind": "file", "format": ..., "path": ..., "schema": ..., "options": {...}}`` or
    ``{"kind": "jdbc", "options": {...}}``.
    """
    kind = side["kind"]
    options = dict(side.get("options", {}))
    if kind == "sql":
        return spark.sql(side["query"])
    if kind == "table":
        return spark.table(side["name"])
    if kind == "file":
        reader = spark.read.format(side["format"]).options(**options)
        if side.get("schema") is not None:
            reader = reader.schema(side["schema"])
        return reader.load(side["path"])
    if kind == "jdbc":
        return spark.read.format("jdbc").options(**options).load()
    raise ValueError(f"unknown kind of side: {kind!r}")


def compare_sides(spark: SparkSession, source: Mapping[str, object], target: Mapping[str, object]) -> DataFrame:
    """Row comparison of two descriptors by column name; a column of one side only is an error."""
    return row_diff_summary(load_side(spark, source), load_side(spark, target))
