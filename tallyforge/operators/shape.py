"""Projections, predicates and row rules."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_constants(df: DataFrame, values: Mapping[str, tuple[object, str]]) -> DataFrame:
    """Constant columns ``name -> (value, type)``, added or overwritten on every row."""
    return df.withColumns({name: F.lit(value).cast(kind) for name, (value, kind) in values.items()})


def yes_no(condition: Column, yes: str = "YES", no: str = "NO") -> Column:
    """Two-way flag; a NULL condition gives ``no``."""
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def update_where(df: DataFrame, column: str, condition: Column, value: Column) -> DataFrame:
    """New value where the condition holds, the old one elsewhere."""
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def cast_column(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Cast one column; what cannot be cast becomes NULL."""
    return df.withColumn(column, F.col(column).try_cast(kind))


def cast_all_but(df: DataFrame, keep: Sequence[str], kind: str = "decimal(12,0)") -> DataFrame:
    """Cast every column except those kept; fractions round half up, overflow gives NULL."""
    return df.select(*[F.col(c) if c in keep else F.col(c).try_cast(kind).alias(c) for c in df.columns])


def _renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    repeated = sorted({n for n in names if list(names).count(n) > 1})
    if repeated:
        raise ValueError(f"column names collide after renaming: {repeated}")
    return df.toDF(*names)


def lowercase_columns(df: DataFrame) -> DataFrame:
    return _renamed(df, [c.lower() for c in df.columns])


def strip_prefix(df: DataFrame) -> DataFrame:
    """``table.column`` -> ``column``: the second dot-part of each name, names without a dot unchanged."""
    return _renamed(df, [c.split(".")[1] if "." in c else c for c in df.columns])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns; names that are absent are ignored."""
    return df.drop(*names)


def keep_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns that exist, in table order."""
    return df.select(*[c for c in df.columns if c in names])


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def fill_nulls(df: DataFrame, columns: Sequence[str], value: int | float | str | bool = 0) -> DataFrame:
    return df.fillna(value, subset=list(columns))


def replace_sentinel(column: Column, value: Column, sentinel: str = "NULL", also_null: bool = False) -> Column:
    """Replace the text sentinel (and real NULLs on request)."""
    hit = column == sentinel
    if also_null:
        hit = hit | column.isNull()
    return F.when(hit, value).otherwise(column)


def pack_struct(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    return df.withColumn(name, F.struct(*columns))


def add_to_field(df: DataFrame, struct: str, field: str, amount: int | float) -> DataFrame:
    """Add to one field of a struct; the other fields stay."""
    return df.withColumn(struct, F.col(struct).withField(field, F.col(struct)[field] + F.lit(amount)))


def swap_codes(column: Column, first: str = "M", second: str = "F") -> Column:
    """Exchange two code values; anything else becomes NULL."""
    return F.when(column == first, F.lit(second)).when(column == second, F.lit(first))


def row_score(columns: Sequence[str]) -> Column:
    """Sum of a row's integer columns."""
    return reduce(operator.add, [F.col(c).cast("bigint") for c in columns])


def accept_reject(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows meeting the condition, and all others (a NULL condition counts as a reject)."""
    marked = df.withColumn("_accepted", F.coalesce(condition, F.lit(False)))
    return (
        marked.where("_accepted").drop("_accepted"),
        marked.where("NOT _accepted").drop("_accepted"),
    )


def with_acceptance(df: DataFrame, condition: Column, name: str = "accepted") -> DataFrame:
    """One pass over the input when both sides go to the same sink."""
    return df.withColumn(name, F.coalesce(condition, F.lit(False)))
