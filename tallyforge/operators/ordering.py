"""Numbering, running values and record ranges that hold when one group is huge.

A window over one group runs in one task. Where a group may be too large for
that, rows are range-partitioned on (group, order), written once, and each
group's pieces are scanned side by side; the totals carried from one piece to
the next are at most one row per range partition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize

Order = Sequence[str | Column]

# Rows of one group that a single window task may sort; larger groups are split.
GROUP_ROWS_PER_TASK = 5_000_000
# Records that an ordered limit may hold; longer ranges are numbered instead.
RANGE_BY_LIMIT = 10_000

_LOCAL_BITS = 33
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1


def dense_ordinal(
    df: DataFrame, order_by: Order, name: str = "ordinal", start: int = 1, keep: Sequence[str] | None = None
) -> DataFrame:
    """Number all rows ``start, start+1, ...`` in the given (complete) order.

    Range partitions are sorted locally; each row's position is its partition's
    offset plus its place there, so no task ever sees more than one partition.
    With ``keep`` only those columns are written; what the order needs besides is shuffled, and no more.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    numbered = ranged.withColumn("_place", F.monotonically_increasing_id())
    placed = materialize(numbered if keep is None else numbered.select(*keep, "_place"), "ordinal")
    part = F.shiftright("_place", _LOCAL_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows")).collect()
    offsets, seen = [], 0
    for row in sorted(counts):  # one row per range partition
        offsets.append((row["_part"], seen))
        seen += row["_rows"]
    if not offsets:
        return placed.drop("_place").withColumn(name, F.lit(None).cast("bigint"))
    offset_table = spark.createDataFrame(offsets, "_part bigint, _offset bigint")
    local = F.col("_place").bitwiseAND(F.lit(_LOCAL_MASK))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offset_table), "_part")  # one row per range partition
        .withColumn(name, F.col("_offset") + local + F.lit(start))
        .drop("_part", "_offset", "_place")
    )


def marked_cell(column: Column, dtype: T.DataType) -> Column:
    """What stands for a cell in a mark: nested values as text, since a hash passes over the NULLs within them."""
    nested = isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))
    return F.to_json(F.struct(column.alias("v"))) if nested else column


def row_mark(columns: Sequence[Column], name: str) -> Column:
    """128 bits that stand for a row's values: two hashes of them, each with a sign of its own for every NULL."""
    signs = [c.isNull() for c in columns]
    return F.struct(
        F.xxhash64(F.lit(1), *signs, *columns).alias("a"), F.xxhash64(F.lit(2), *reversed(columns), *signs).alias("b")
    ).alias(name)


def rows_of_marks(df: DataFrame, columns: Sequence[Column], marks: DataFrame, mark: str, row: Column, name: str) -> DataFrame:
    """``marks`` with the row that each mark stands for; ``df`` is read again, and only rows that are asked for go on."""
    found = df.select(row_mark(columns, "_mark"), row.alias(name))
    asked = marks.select(F.col(mark).alias("_mark")).distinct()
    once = found.join(asked, "_mark", "left_semi").groupBy("_mark").agg(F.first(name).alias(name))
    return marks.join(once, F.col(mark) == F.col("_mark"), "left").drop("_mark")


def sparse_ordinal(df: DataFrame, name: str = "ordinal", start: int = 1) -> DataFrame:
    """Unique increasing ids with gaps; no shuffle and no second pass."""
    return df.withColumn(name, F.monotonically_increasing_id() + F.lit(start))


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Row count of the largest group (counted map-side first)."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.agg(F.max("_rows")).first()[0] or 0


def _scan_groups(
    df: DataFrame,
    group: Sequence[str],
    order_by: Order,
    scan: Callable[[WindowSpec], Column],
    total: Column,
    name: str,
    group_rows: int,
    slices: int | None,
) -> DataFrame:
    """``scan`` over each group in order; ``total`` is what a piece of a group adds to the pieces after it."""
    if largest_group(df, group) <= group_rows:
        return df.withColumn(name, scan(Window.partitionBy(*group).orderBy(*order_by)))

    keys = [*group, *order_by]
    ranged = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    placed = materialize(ranged.withColumn("_piece", F.spark_partition_id()), "pieces")
    totals = placed.groupBy(*group, "_piece").agg(total.alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # Only a group that began in an earlier partition carries a total: at most one row per range partition.
    carried = (
        totals.withColumn("_carry", F.sum("_total").over(earlier))
        .where(F.col("_carry").isNotNull())
        .select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_piece").alias("_p"), "_carry")
    )
    same = F.col("_piece") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    scanned = placed.withColumn("_local", scan(Window.partitionBy("_piece", *group).orderBy(*order_by)))
    kind = df.select(scan(Window.partitionBy(*group).orderBy(*order_by)).alias("_v")).schema["_v"].dataType
    whole = F.coalesce(F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0)), F.col("_carry")).cast(kind)
    return scanned.join(F.broadcast(carried), same, "left").select(*df.columns, whole.alias(name))


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order_by: Order,
    value: Column,
    name: str,
    group_rows: int = GROUP_ROWS_PER_TASK,
    slices: int | None = None,
) -> DataFrame:
    """Running sum of ``value`` within each group, one output row per input row."""

    def scan(window: WindowSpec) -> Column:
        return F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    return _scan_groups(df, group, order_by, scan, F.sum(value), name, group_rows, slices)


def group_serial(
    df: DataFrame,
    group: Sequence[str],
    order_by: Order,
    name: str = "serial",
    group_rows: int = GROUP_ROWS_PER_TASK,
    slices: int | None = None,
) -> DataFrame:
    """Sequence number 1, 2, ... within each group."""

    def scan(window: WindowSpec) -> Column:
        return F.row_number().over(window).cast("bigint")

    return _scan_groups(df, group, order_by, scan, F.count(F.lit(1)), name, group_rows, slices)


def first_per_group(df: DataFrame, group: Sequence[str | Column], order_by: Order, keep_rank: bool = False) -> DataFrame:
    """First row of each group. Spark limits every group map-side before the shuffle, so hot groups stay small."""
    window = Window.partitionBy(*group).orderBy(*order_by)
    first = df.withColumn("row_number", F.row_number().over(window)).where("row_number = 1")
    return first if keep_rank else first.drop("row_number")


def record_range(df: DataFrame, order_by: Order, first: int, last: int) -> DataFrame:
    """Records ``first..last`` (1-based, inclusive, clipped at the end), in the given order.

    For a range that ends beyond ``RANGE_BY_LIMIT`` only marks of the rows are sorted, numbered and written, by jobs that
    run when this function is called; the table is then read again for the rows whose marks are in the range. Rows
    that the order leaves open follow their marks.
    """
    if first < 1 or last < first:
        raise ValueError(f"not a record range: {first}..{last}")
    if last <= RANGE_BY_LIMIT:
        return df.orderBy(*order_by).limit(last).offset(first - 1)
    columns = [F.col(f"`{c}`") for c in df.columns]
    cells = [marked_cell(c, f.dataType) for c, f in zip(columns, df.schema.fields)]
    marked = df.withColumn("_mark", row_mark(cells, "_mark"))
    by = [*order_by, F.col("_mark.a"), F.col("_mark.b")]
    picked = dense_ordinal(marked, by, "_ordinal", keep=["_mark"]).where(F.col("_ordinal").between(first, last))
    wanted = picked.select("_ordinal", F.col("_mark").alias("_wanted"))
    rows = rows_of_marks(df, cells, wanted, "_wanted", F.struct(*columns), "_row")
    return rows.orderBy("_ordinal").select(*[F.col("_row")[c].alias(c) for c in df.columns])


def nth_record(df: DataFrame, order_by: Order, n: int) -> DataFrame:
    return record_range(df, order_by, n, n)


def top_n(df: DataFrame, order_by: Order, n: int) -> DataFrame:
    """First n rows of a complete order (each task keeps n, no global sort)."""
    return df.orderBy(*order_by).limit(n)
