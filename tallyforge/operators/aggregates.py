"""Grouped and global aggregates; every one combines map-side before its shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import GROUP_ROWS_PER_TASK, group_serial

# Inclusive id ranges and their bucket numbers; all else is the default bucket.
ID_BUCKETS = (
    (0, 2499999999, 0),
    (2500000000, 3999999999, 1),
    (4000000000, 5499999999, 2),
    (5500000000, 6999999999, 3),
    (7000000000, 8499999999, 4),
)
ID_BUCKET_DEFAULT = 5


def exact_sum(column: Column, scale: int) -> Column:
    """Sum of values that have at most ``scale`` decimals, as a double that does not depend on the order of the rows.

    Further decimals are rounded away; a value of 10^(28 - scale) or more is an error.
    """
    return F.sum(column.cast(f"decimal(28,{scale})")).cast("double")


def _sum(column: Column, scale: int | None) -> Column:
    return F.sum(column) if scale is None else exact_sum(column, scale)


def sum_by(df: DataFrame, group: Sequence[str], column: str, name: str, scale: int | None = None) -> DataFrame:
    """Sum per group in the column's own kind (integers as bigint, decimals, doubles); exact with a ``scale``."""
    return df.groupBy(*group).agg(_sum(F.col(column), scale).alias(name))


def distinct_count_by(df: DataFrame, group: Sequence[str], column: str, name: str) -> DataFrame:
    """Exact distinct count. Spark first groups by (group, value), which spreads a hot group over all tasks."""
    return df.groupBy(*group).agg(F.count_distinct(column).alias(name))


def bucket_of(
    column: Column,
    buckets: Sequence[tuple[int, int, int]] = ID_BUCKETS,
    default: int = ID_BUCKET_DEFAULT,
) -> Column:
    chain = None
    for low, high, number in buckets:
        inside = column.between(low, high)
        chain = F.when(inside, F.lit(number)) if chain is None else chain.when(inside, F.lit(number))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def bucket_counts(df: DataFrame, column: Column, **ranges: object) -> DataFrame:
    bucket = bucket_of(column, **ranges).alias("customer_split")
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("customer_count"))


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def totals_by_type(
    df: DataFrame,
    kind: Column,
    amount: Column,
    types: dict[str, str],
    group: Sequence[str] = (),
    scale: int | None = None,
) -> DataFrame:
    """One total column per type (``type -> column name``), per group or over all rows; 0 where a type is absent.

    Totals have the amount's own kind, or are exact to ``scale`` decimals.
    """
    sums = [F.coalesce(_sum(F.when(kind == value, amount), scale), F.lit(0)).alias(name) for value, name in types.items()]
    return df.groupBy(*group).agg(*sums) if group else df.agg(*sums)


def group_list(
    df: DataFrame,
    group: Sequence[str],
    column: str,
    name: str,
    separator: str = ", ",
    chunk: int = 100_000,
    tie_break: Sequence[str] = (),
    group_rows: int = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """A group's values, sorted and joined into one text per ``chunk`` values.

    A group of up to ``chunk`` values gives one row (chunk 0); a larger one goes
    on in further rows, so that no cell and no task holds an unbounded list.
    """
    order = [column, *tie_break]
    numbered = group_serial(df.where(F.col(column).isNotNull()), group, order, "_serial", group_rows)
    chunk_no = F.floor((F.col("_serial") - 1) / F.lit(chunk)).cast("bigint")
    listed = numbered.groupBy(*group, chunk_no.alias("chunk")).agg(
        F.array_join(F.array_sort(F.collect_list(column)), separator).alias(name)
    )
    return listed


def value_at_max(df: DataFrame, group: Sequence[str], value: str, by: str, name: str) -> DataFrame:
    """``value`` of the row with the greatest ``by``; the greatest value among ties."""
    best = F.max_by(F.col(value), F.struct(by, value)).alias(name)
    rows = df.where(F.col(by).isNotNull())
    return rows.groupBy(*group).agg(best) if group else rows.agg(best)


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    """One row with the count; 0 on empty input."""
    return df.agg(F.count(F.lit(1)).alias(name))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def null_profile(df: DataFrame) -> DataFrame:
    """NULL count of every column and the row count, one row per column, from one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)]
    )
    lines = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("nulls"), F.col("_rows").alias("rows"))
            for i, c in enumerate(df.columns)
        ]
    )
    return counted.select(F.inline(lines)).withColumn("all_null", F.col("nulls") == F.col("rows"))


def all_columns_null(df: DataFrame) -> DataFrame:
    """One row: is every column NULL in every row (true for an empty input)?"""
    filled = [F.count(F.col(f"`{c}`")) for c in df.columns]
    return df.agg(F.greatest(*filled, F.lit(0).cast("bigint")).alias("_filled")).select(
        (F.col("_filled") == 0).alias("all_null")
    )


def column_sum(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row with the sum in the column's own kind; 0 for no values."""
    return df.agg(F.coalesce(F.sum(column), F.lit(0)).alias(name))
