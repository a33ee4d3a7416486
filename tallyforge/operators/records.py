"""Reading and editing ranges of nested records by dotted path."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nested import path_get, path_set
from .ordering import Order, dense_ordinal


def read_records(df: DataFrame, order_by: Order, path: str, first: int, last: int) -> DataFrame:
    """``record, value`` of a dotted path for records ``first..last``; the end is clipped at the table size."""
    numbered = dense_ordinal(df, order_by, "_record")
    chosen = numbered.where(F.col("_record").between(first, last))
    return chosen.select(F.col("_record").alias("record"), path_get(df, path).alias("value"))


def edit_records(
    df: DataFrame, order_by: Order, first: int, last: int, edits: Mapping[str, object]
) -> tuple[DataFrame, dict[str, str]]:
    """The whole table with dotted paths set in records ``first..last``, and each path's outcome.

    A range past the last record is an error, raised before anything could be written.
    """
    numbered = dense_ordinal(df, order_by, "_record")
    size = numbered.agg(F.count(F.lit(1))).first()[0]
    if first < 1 or last < first or last > size:
        raise IndexError(f"records {first}..{last} are not within 1..{size}")
    edited, outcome = path_set(numbered, edits, F.col("_record").between(first, last))
    return edited.drop("_record"), outcome
