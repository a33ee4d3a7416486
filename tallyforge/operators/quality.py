"""Checks. Each returns one row ``suite, check, outcome, evidence`` so that results can be put together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.uniform import uniform
from ..scratch import materialize

PASSED = "passed"
FAILED = "failed"


def _result(measured: DataFrame, suite: str, check: str, passed: Column, evidence: Column) -> DataFrame:
    return measured.select(
        F.lit(suite).alias("suite"),
        F.lit(check).alias("check"),
        F.when(passed, F.lit(PASSED)).otherwise(F.lit(FAILED)).alias("outcome"),
        evidence.alias("evidence"),
    )


def _facts(**facts: Column) -> Column:
    pairs = [F.concat(F.lit(f"{name}="), value.cast("string")) for name, value in facts.items()]
    return F.concat_ws(" ", *pairs)


def fixed_result(df: DataFrame, suite: str, check: str, passed: bool, evidence: str) -> DataFrame:
    """Result row known on the driver (names, schemas)."""
    one = df.sparkSession.range(1)
    return _result(one, suite, check, F.lit(passed), F.lit(evidence))


def partition_check(df: DataFrame, column: str, suite: str = "structure") -> DataFrame:
    """The partition column exists and has no NULL."""
    if column not in df.columns:
        return fixed_result(df, suite, "partition_column", False, f"column {column} is absent")
    measured = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(column).isNull()).alias("nulls"))
    return _result(
        measured, suite, "partition_column", F.col("nulls") == 0, _facts(nulls=F.col("nulls"), rows=F.col("rows"))
    )


def structure_check(df: DataFrame, suite: str = "structure") -> DataFrame:
    """Fails when every column is NULL in every row (an empty input included)."""
    filled = [F.count(F.col(f"`{c}`")).alias(f"_f{i}") for i, c in enumerate(df.columns)]
    measured = df.agg(F.count(F.lit(1)).alias("rows"), *filled)
    any_filled = F.greatest(*[F.col(f"_f{i}") for i in range(len(df.columns))], F.lit(0).cast("bigint")) > 0
    all_null = sum((F.when(F.col(f"_f{i}") == 0, 1).otherwise(0) for i in range(len(df.columns))), F.lit(0))
    return _result(
        measured, suite, "file_structure", any_filled, _facts(all_null_columns=all_null, rows=F.col("rows"))
    )


def expected_value_check(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    conditions: Sequence[Column],
    column: str,
    expected: object,
    suite: str = "validation",
) -> DataFrame:
    """Left join; among the rows meeting all conditions (on left columns) some row has the expected value.

    Only counts are needed, so the right side is counted per key first and no
    key can multiply rows.
    """
    for condition in conditions:
        left = left.where(condition)
    counted = right.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(F.col(column) == F.lit(expected)).alias("_matching")
    )
    per_key = materialize(counted, "per-key")  # so that a hot key of the left side can be split
    measured = left.join(per_key, list(on), "left").agg(
        F.coalesce(F.sum(F.coalesce(F.col("_rows"), F.lit(1))), F.lit(0)).alias("eligible"),
        F.coalesce(F.sum("_matching"), F.lit(0)).alias("matching"),
    )
    return _result(
        measured,
        suite,
        "expected_value",
        F.col("matching") > 0,
        _facts(eligible=F.col("eligible"), matching=F.col("matching")),
    )


def disallowed_rows(df: DataFrame, column: str, allowed: Sequence[object]) -> DataFrame:
    """Rows whose value is not in the list: the evidence of a failed check."""
    return df.where(~F.col(column).isin(list(allowed)))


def broken_implication_rows(df: DataFrame, column: str, allowed: Sequence[object], then: Column) -> DataFrame:
    """Rows whose value is in the list although ``then`` does not hold."""
    return df.where(F.col(column).isin(list(allowed)) & ~F.coalesce(then, F.lit(False)))


def allowed_values_check(df: DataFrame, column: str, allowed: Sequence[object], suite: str = "validation") -> DataFrame:
    bad = F.count_if(~F.col(column).isin(list(allowed)))
    measured = df.agg(F.count(F.lit(1)).alias("rows"), bad.alias("bad"))
    return _result(measured, suite, "allowed_values", F.col("bad") == 0, _facts(bad=F.col("bad"), rows=F.col("rows")))


def implication_check(
    df: DataFrame, column: str, allowed: Sequence[object], then: Column, suite: str = "validation"
) -> DataFrame:
    """Every row whose value is in the list also meets ``then``."""
    broken = F.count_if(F.col(column).isin(list(allowed)) & ~F.coalesce(then, F.lit(False)))
    measured = df.agg(F.count(F.lit(1)).alias("rows"), broken.alias("bad"))
    return _result(measured, suite, "implication", F.col("bad") == 0, _facts(bad=F.col("bad"), rows=F.col("rows")))


def non_empty_check(df: DataFrame, name: str, suite: str = "tables") -> DataFrame:
    measured = df.agg(F.count(F.lit(1)).alias("rows"))
    return _result(measured, suite, f"non_empty:{name}", F.col("rows") > 0, _facts(rows=F.col("rows")))


def evidence_sample(df: DataFrame, key: Sequence[str], fraction: float = 0.1, salt: str = "evidence") -> DataFrame:
    """About ``fraction`` of the rows; a row's key alone decides, so a rerun picks the same rows."""
    return df.where(uniform(salt, *key) < fraction)


def check_results(*results: DataFrame) -> DataFrame:
    """All result rows as one table."""
    first, *rest = results
    for result in rest:
        first = first.unionByName(result)
    return first


def check_totals(results: DataFrame) -> DataFrame:
    return results.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
