"""Set operations over whole rows.

Both tables are tagged, put together and grouped by all columns: one shuffle,
and copies of a row collapse map-side, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import Order, dense_ordinal, marked_cell, row_mark

# Copies of one row that one task may write; beyond it the copies come from a range.
COPIES_PER_ROW = 1_000
# Buckets of row fingerprints; the sums of a bucket hold 2^31 rows a side.
BUCKETS = 4096


def _tagged(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, list[Column]]:
    """Rows of both tables with ``_l`` and ``_r``, 1 for the side a row is of, and their columns.

    Without ``columns`` both sides must have the same column names; a column of one side only is an error, not equal.
    """
    if columns is None and {c.lower() for c in left.columns} != {c.lower() for c in right.columns}:
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    columns = list(columns or left.columns)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    quoted = [F.col(f"`{c}`") for c in columns]
    both = left.select(*quoted, one.alias("_l"), none.alias("_r")).unionByName(
        right.select(*quoted, none.alias("_l"), one.alias("_r"))
    )
    return both, quoted


def row_counts(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows of both tables with ``left_n`` and ``right_n``, their number of copies on each side."""
    both, quoted = _tagged(left, right, columns)
    return both.groupBy(*quoted).agg(F.sum("_l").alias("left_n"), F.sum("_r").alias("right_n"))


def _marked(left: DataFrame, right: DataFrame) -> tuple[DataFrame, list[Column]]:
    both, quoted = _tagged(left, right)
    cells = [marked_cell(c, f.dataType) for c, f in zip(quoted, both.schema.fields)]
    marked = both.withColumn("_mark", row_mark(cells, "_mark"))
    return marked.withColumn("_bucket", F.pmod(F.xxhash64("_mark.a", "_mark.b"), F.lit(BUCKETS)).cast("int")), quoted


def fingerprints(left: DataFrame, right: DataFrame) -> DataFrame:
    """``bucket, left_n, right_n, equal`` for each bucket of rows by hash, whatever the rows' order.

    Rows of one side add their 128-bit mark to the bucket's sums and those of the other take theirs away; a bucket with
    equal sizes whose sums vanish has the same rows, with their copies, on both sides. Sums combine
    map-side, so a task sends a row a bucket, however many rows it reads.
    """
    marked, _ = _marked(left, right)
    sign = F.col("_l") - F.col("_r")
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    quarters = [low("_mark.a"), F.shiftrightunsigned("_mark.a", 32), low("_mark.b"), F.shiftrightunsigned("_mark.b", 32)]
    sums = [F.sum(sign * q).alias(f"_s{i}") for i, q in enumerate(quarters)]
    found = marked.groupBy("_bucket").agg(F.sum("_l").alias("left_n"), F.sum("_r").alias("right_n"), *sums)
    equal = F.col("left_n") == F.col("right_n")
    for i in range(len(quarters)):
        equal = equal & (F.col(f"_s{i}") == 0)
    return found.select(F.col("_bucket").alias("bucket"), "left_n", "right_n", equal.alias("equal"))


def differing_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """:func:`row_counts` of the rows in buckets whose fingerprints differ: all rows with unequal counts, and few others.

    Equal tables are read twice, but none of their rows is shuffled.
    """
    marked, quoted = _marked(left, right)
    unequal = fingerprints(left, right).where(~F.col("equal")).select(F.col("bucket").alias("_bucket"))
    # At most BUCKETS numbers.
    some = marked.join(F.broadcast(unequal), "_bucket", "left_semi")
    return some.groupBy(*quoted).agg(F.sum("_l").alias("left_n"), F.sum("_r").alias("right_n"))


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of left that right does not have."""
    return row_counts(left, right).where("left_n > 0 AND right_n = 0").drop("left_n", "right_n")


def surplus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows left has more often than right, with the number of ``copies`` in excess (EXCEPT ALL, kept compact)."""
    return (
        row_counts(left, right)
        .where("left_n > right_n")
        .withColumn("copies", F.col("left_n") - F.col("right_n"))
        .drop("left_n", "right_n")
    )


def once_only(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows occurring exactly once over both tables, with their side."""
    return (
        row_counts(left, right)
        .where("left_n + right_n = 1")
        .withColumn("side", F.when(F.col("left_n") == 1, F.lit("left")).otherwise(F.lit("right")))
        .drop("left_n", "right_n")
    )


def amplify(df: DataFrame, n: int, order_by: Order, name: str = "id") -> DataFrame:
    """Exactly n rows: whole copies of the table, then its first rows in the given order, with a dense id from 0.

    A column of the id's name is replaced; the id comes last. The rows are numbered and counted by jobs that run when
    this function is called.
    """
    spark = df.sparkSession
    numbered = dense_ordinal(df, order_by, "_ordinal", start=0)
    size = numbered.agg(F.count(F.lit(1))).first()[0]
    if size == 0:
        if n:
            raise ValueError("an empty table cannot be amplified")
        return df.drop(name).withColumn(name, F.lit(None).cast("bigint"))
    kept = [c for c in df.columns if c != name]
    copies = -(-n // size)
    if copies <= COPIES_PER_ROW:
        spread = numbered.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(max(copies - 1, 0)))))
        made = spread.withColumn(name, F.col("_copy") * F.lit(size) + F.col("_ordinal"))
        return made.where(F.col(name) < n).select(*kept, name)
    # Few rows, many copies: the range gives the parallelism.
    ids = spark.range(n).select(F.col("id").alias(name), (F.col("id") % F.lit(size)).alias("_ordinal"))
    return ids.join(numbered.drop(name), "_ordinal").select(*kept, name)


def list_intersection(first: Column, second: Column) -> Column:
    """Distinct elements that both lists hold, in first-list order."""
    return F.array_intersect(first, second)
