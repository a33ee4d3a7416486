"""Joins on names; Spark picks the physical join from sizes it knows or measures.

No side is broadcast by hand: literal tables carry their size, and adaptive
execution broadcasts a side only after measuring it and splits skewed
partitions of the others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .ordering import GROUP_ROWS_PER_TASK, largest_group

# Cells of a value space that one task makes before they are spread.
SPACE_CELLS = 10_000
# Rows from which neighbouring tables of a star join are joined with each other first: about where a
# table no longer fits the default broadcast size.
JOIN_TOGETHER_ROWS = 200_000


def keep_listed(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in the list; a semi-join, so repeated list keys do not multiply rows.

    The list meets the join as it is: adaptive execution splits a hot key of ``df`` only where no aggregate lies
    between a side's shuffle and the join.
    """
    return df.join(keys.select(*on), list(on), "left_semi")


def left_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], key_rows: int = GROUP_ROWS_PER_TASK
) -> DataFrame:
    """Left outer equi-join.

    Adaptive execution can split a skewed left side of an outer join, but not a
    skewed right side. Where one right key has more than ``key_rows`` rows, the
    matches come from an inner join, which can be split on either side, and the
    rest from an anti-join. Both ways give the same columns in the same order,
    also where both sides have a column of one name. Counting the largest right
    key is a job of its own, run when this function is called.
    """
    joined = left.join(right, list(on), "left")
    if largest_group(right, on) <= key_rows:
        return joined
    matched = left.join(right, list(on), "inner")
    added = [f for f in right.schema.fields if f.name not in on]
    alone = left.join(right.select(*on), list(on), "left_anti")
    kept = [*on, *[c for c in left.columns if c not in on]]
    filled = alone.select(*[F.col(f"`{c}`") for c in kept], *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    return matched.union(filled)


def not_listed(df: DataFrame, keys: DataFrame, key: Column, listed: str) -> DataFrame:
    """Rows whose key expression matches no listed key; NULL keys match nothing and stay."""
    probe = keys.select(F.col(listed).alias("_listed"))
    return df.withColumn("_key", key).join(probe, F.col("_key") == F.col("_listed"), "left_anti").drop("_key")


def extra_rows(df: DataFrame, column: str, known: Sequence[object] | DataFrame) -> DataFrame:
    """Rows whose id is not NULL and not among the known ids (a short list, or a one-column table)."""
    rows = df.where(F.col(column).isNotNull())
    if isinstance(known, DataFrame):
        return not_listed(rows, known, F.col(column), known.columns[0])
    return rows.where(~F.col(column).isin(list(known)))


def extra_ids(df: DataFrame, column: str, known: Sequence[object] | DataFrame) -> DataFrame:
    """Distinct ids that are not known; they are made distinct before the comparison."""
    return extra_rows(df.select(column).distinct(), column, known)


def _table_sizes(tables: Sequence[DataFrame]) -> list[int]:
    """Row counts of several tables from one job."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n") for i, t in enumerate(tables)]
    return [row["n"] for row in sorted(reduce(DataFrame.union, counts).collect())] if counts else []


def _together(
    tables: Sequence[tuple[DataFrame, Sequence[str]]], how: str, together_rows: int
) -> list[tuple[DataFrame, list[str]]]:
    """Neighbouring large tables with the same join names, joined among themselves if each has unique keys.

    A table with a repeated key would make pairs of keys that the base may not even have.
    """
    names = [list(on) for _, on in tables]
    alike = [i for i, on in enumerate(names) if on in names[max(i - 1, 0) : i] + names[i + 1 : i + 2]]
    sizes = dict(zip(alike, _table_sizes([tables[i][0] for i in alike])))
    merged: list[tuple[DataFrame, list[str], bool]] = []
    for i, ((table, _), on) in enumerate(zip(tables, names)):
        large = sizes.get(i, 0) > together_rows and largest_group(table, on) == 1
        if large and merged and merged[-1][1] == on and merged[-1][2]:
            merged[-1] = (merged[-1][0].join(table, on, how), on, True)
        else:
            merged.append((table, on, large))
    return [(table, on) for table, on, _ in merged]


def star_join(
    base: DataFrame,
    inner: Sequence[tuple[DataFrame, Sequence[str]]],
    left: Sequence[tuple[DataFrame, Sequence[str]]],
    active: str | None = None,
    together_rows: int = JOIN_TOGETHER_ROWS,
) -> DataFrame:
    """``base`` inner-joined and left-joined on shared names.

    With ``active``, every table keeps only rows where that flag is 1 before
    its join (an unmatched base row of a left join stays), and the flag is
    dropped.

    Small tables are joined one by one, so that Spark can broadcast each.
    Neighbouring tables of more than ``together_rows`` rows with unique keys of
    the same names are first joined with each other (inner, or full outer for the left joins,
    which gives the same rows): the base then meets them in one join that stands
    alone, as skew handling needs.
    """

    def ready(table: DataFrame) -> DataFrame:
        return table.where(F.col(active) == 1).drop(active) if active else table

    joined = ready(base)
    for table, on in _together([(ready(t), on) for t, on in inner], "inner", together_rows):
        joined = joined.join(table, on, "inner")
    for table, on in _together([(ready(t), on) for t, on in left], "full", together_rows):
        joined = joined.join(table, on, "left")
    return joined


def join_sizes(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Row counts that the inner, left and right joins would have, without making the pairs.

    Each side is counted per key first, so a key repeated on both sides costs one row.
    """
    keys = [F.col(c) for c in on]
    l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    sizes = l.join(r, list(on), "full").agg(
        F.coalesce(F.sum(F.col("_l") * F.col("_r")), F.lit(0)).alias("_inner"),
        F.coalesce(F.sum(F.col("_l") * F.coalesce(F.col("_r"), F.lit(1))), F.lit(0)).alias("_left"),
        F.coalesce(F.sum(F.col("_r") * F.coalesce(F.col("_l"), F.lit(1))), F.lit(0)).alias("_right"),
    )
    lines = [
        F.struct(F.lit(how).alias("join_type"), F.col(f"_{how}").cast("bigint").alias("n_rows"))
        for how in ("inner", "left", "right")
    ]
    return sizes.select(F.inline(F.array(*lines)))


def lookup_first(
    df: DataFrame, lookup: DataFrame, column: str, key: str, value: str, order_by: str, name: str
) -> DataFrame:
    """Value of the first lookup row whose key equals the column's text; NULL when there is none.

    The lookup is reduced to a row a key. One that Spark knows to be small is broadcast; any other is written first,
    when this function is called, so that a hot key of ``df`` can be split.
    """
    first = lookup.groupBy(F.col(key).cast("string").alias("_key")).agg(F.min_by(F.col(value), F.col(order_by)).alias(name))
    first = F.broadcast(first) if known_small(lookup) else materialize(first, "lookup")
    return df.withColumn("_key", F.col(column).cast("string")).join(first, "_key", "left").drop("_key")


def known_small(df: DataFrame) -> bool:
    """Whether Spark's own estimate of the rows' size is within its broadcast threshold."""
    spark = df.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= limit


def lookup_all(df: DataFrame, lookup: DataFrame, column: str, key: str, value: str, name: str) -> DataFrame:
    """As :func:`lookup_first`, with one output row for every matching lookup row."""
    every = lookup.select(F.col(key).cast("string").alias("_key"), F.col(value).alias(name))
    return df.withColumn("_key", F.col(column).cast("string")).join(every, "_key", "left").drop("_key")


def value_space(source: DataFrame, domains: Mapping[str, Sequence[object]], name: str | None = None) -> DataFrame:
    """Every combination of literal values, numbered from 1 with the last name varying fastest.

    ``source`` lends its session only. The lists are exploded in turn, so no join is made; a space of more than
    ``SPACE_CELLS`` cells so far is spread over all tasks before the next list.
    """
    cells = 1
    space = source.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("_id"))
    for column, values in domains.items():
        if cells > SPACE_CELLS:
            space = space.repartition("_id")
        cells *= len(values)
        space = space.select(
            "*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_pos", column)
        ).withColumn("_id", F.col("_id") * F.lit(len(values)) + F.col("_pos"))
        space = space.drop("_pos")
    columns = [F.col(c) for c in domains]
    return space.select(*([(F.col("_id") + 1).alias(name)] if name else []), *columns)


def covered_space(df: DataFrame, space: DataFrame, columns: Sequence[str], name: str = "n") -> DataFrame:
    """Each combination of the space with the number of rows of ``df`` that have it (0 for none; NULL equals NULL)."""
    counted = df.groupBy(*[F.col(c).alias(f"_{c}") for c in columns]).agg(F.count(F.lit(1)).alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return space.join(counted, same, "left").select(
        *space.columns, F.coalesce(F.col("_n"), F.lit(0)).alias(name)
    )
