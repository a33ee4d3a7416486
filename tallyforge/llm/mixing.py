"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected ``target / source size`` times. The expected copies are summed in the
order of the documents' sizes, one offset per source is added, and a document comes out once for each whole number
that its own share crosses. Ordered by size, the words taken miss the target by about one document at most.

Scale: rows are range-partitioned by (source, size, id), sorted and written once with their place; a place is an
offset of the partition's share of the source plus the row's place in it, so that a source with a third of all rows
is numbered by many tasks. What is joined back has one row per source and range partition.

Defined results: NULL text has size 0; a NULL source is a source of its own, ordered last; sources of size 0 have
target 0 and give nothing; an empty table gives an empty table. Rows that agree in id, source and text are
interchangeable. Columns of the input keep their names; the added ones take a trailing underscore if the name is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uniform import uniform
from ..scratch import materialize
from .words import SPACES, spare

_PLACE_BITS = 33
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    """Number of words, from the length of what is left when each word is one letter."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> with ``target``: weights repeat by the source's code points, NULL last.

    All sizes together are shared by weight; no target exceeds ``most`` times its source, and what is over goes to
    the others by weight until none is above. Ordered by size per weight, the limited sources come first, so running
    sums find them in one pass. One row per source passes through this window: a mix names its sources.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(in_order) - 1) % len(weights)))
    room = F.col("source_size") * F.lit(float(most))
    filling = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    found = (
        ranked.withColumn("room", room)
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("limited", F.col("room") * F.col("weight_left") <= F.col("left") * F.col("weight"))
        .withColumn("level", F.max(F.when(~F.col("limited"), F.col("left") / F.col("weight_left"))).over(everything))
    )
    share = F.when(F.col("limited"), F.col("room")).otherwise(F.least(F.col("room"), F.col("level") * F.col("weight")))
    return found.select("source", "source_size", share.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    seed: str = "mix",
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    size_column: str | None = None,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``; a row each, also if not taken.

    ``size_column`` names a column that already holds the number of words; else it is counted from ``text``.
    """
    n_size, n_total, n_target, n_copies, n_taken, place, tie, drawn = spare(
        docs, "size", "source_size", "target", "copies", "taken", "_place", "_tie", "_drawn"
    )
    f_source, f_part, shift, total, target, rate, offset = spare(
        docs, "_source", "_part", "_shift", "_total", "_target", "_rate", "_offset"
    )
    counted = docs.withColumn(n_size, word_count(F.col(text)) if size_column is None else F.col(size_column).cast("bigint"))
    if text in docs.columns:
        counted = counted.withColumn(tie, F.xxhash64(text))
    else:
        counted = counted.withColumn(tie, F.lit(0).cast("bigint"))
    order = [F.col(source).asc_nulls_last(), F.col(n_size), F.col(key), F.col(tie)]
    placed = materialize(
        counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()),
        "mix",
    )
    part = F.shiftright(place, _PLACE_BITS)
    pieces = materialize(
        placed.groupBy(F.col(source).alias("source"), part.alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), F.sum(n_size).alias("words")
        ),
        "mix-pieces",
    )
    targets = source_targets(pieces.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    facts = materialize(
        pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(
            F.col("source").alias(f_source),
            F.col("part").alias(f_part),
            (F.col("before") - F.col("first")).alias(shift),
            F.col("source_size").alias(total),
            F.col("target").alias(target),
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate),
            uniform(seed, F.col("source")).alias(offset),
        ),
        "mix-facts",
    )
    joined = placed.join(facts, (part == F.col(f_part)) & F.col(source).eqNullSafe(F.col(f_source)))
    rank = F.col(place) + F.col(shift)
    crossed = F.floor((rank + 1) * F.col(rate) + F.col(offset)) - F.floor(rank * F.col(rate) + F.col(offset))
    return joined.withColumn(drawn, crossed).select(
        *docs.columns,
        n_size,
        F.col(total).alias(n_total),
        F.col(target).alias(n_target),
        F.col(drawn).alias(n_copies),
        (F.col(drawn) * F.col(n_size)).alias(n_taken),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it was drawn, with the columns of ``docs``."""
    drawn = mix(docs, **options)
    copies = drawn.columns[len(docs.columns) + 3]
    again = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
    (each,) = spare(drawn, "_each")
    return drawn.where(F.col(copies) > 0).withColumn(each, again).select(*docs.columns)
