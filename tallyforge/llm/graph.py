"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


# Rows that one task takes of an edge table; small tables need few tasks, whatever the session's setting.
ROWS_PER_TASK = 200_000


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have about ``rows`` rows at most, in as many tasks as that is worth."""
    return df.coalesce(rows // ROWS_PER_TASK + 1)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b): root is the component's smallest node.

    Large and small stars take turns until nothing changes, about log n times. Every step combines by node before its
    shuffle and is written, so a node with many neighbours costs rows, not memory, and lost executors cost one step.
    """
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("of"), F.least("a", "low").alias("low"))
        large = both.where("b > a").join(lowest, F.col("a") == F.col("of")).select(F.col("low").alias("a"), "b").distinct()
        large = materialize(in_tasks(large, state[0]), "large-stars")
        lowest = large.groupBy("b").agg(F.min("a").alias("low")).select(F.col("b").alias("of"), "low")
        met = large.join(lowest, F.col("b") == F.col("of"))
        small = met.where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b")).unionByName(met.select(F.col("low").alias("a"), "b"))
        now = materialize(in_tasks(small.distinct(), state[0]), "small-stars")
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
