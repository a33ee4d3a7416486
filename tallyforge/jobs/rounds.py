"""Generate, process and keep what is new: several rounds of scrambled input as one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..operators.datagen import KNOWN_SCENARIOS, generated_rounds, rounds_report


def run_rounds(
    df: DataFrame,
    keys: Sequence[str],
    process: Callable[[DataFrame], DataFrame],
    target: str,
    scenario: str = "scenario_id",
    known: Sequence[str] = KNOWN_SCENARIOS,
    rounds: int = 10,
    salt: str = "rounds",
) -> DataFrame:
    """Write each round's rows with new scenario ids to ``target/round=n``; returns ids and rows per round."""
    found = generated_rounds(df, keys, process, scenario, known, rounds, salt)
    found.write.partitionBy("round").parquet(target)
    return rounds_report(df.sparkSession.read.schema(found.schema).parquet(target), scenario)
