"""Benchmark decontamination: test items found inside documents by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle sets, in powers of two. Of each set the smallest hashes are kept,
as many as the partition needs: with at most ``u`` shingles, of which a share ``t`` must be found, at most
``u - ceil(t u)`` are missing, so that one more of the smallest hashes always has a hit. Documents are searched with
those of their hashes that are no larger than any kept one. No item is missed, whatever a document's length, where
banded signatures of very unequal sets would miss most. Candidates are then verified on the words of all shingles.

Scale: a document's hashes are made inside its row; those that may match meet the sketch, a written table whose size
Spark knows, by broadcast if it is small and by a join on the hash that adaptive execution can split if not.
Candidates are pairs of text hashes, so that copies of a document are one candidate.

Defined results: texts are lower-cased (A-Z); shingles have ``size`` words. An item of fewer words is one shingle of its
own length, and documents are cut into windows of that length too, for each such length that occurs. NULL or
empty texts and items match nothing; repeated documents or items give repeated rows; with either table empty the
result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .words import let, lowered, shingles, spare, windows, words

PERCENT = 80
SHINGLE = 5


def item_sketches(items: DataFrame, text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(item, n, h): the smallest hashes of each item's shingles, as many as its size partition asks for."""
    sets = items.select(F.xxhash64(text).alias("item"), shingles(F.col(text), size).alias("set")).distinct()
    n = F.size("set")
    upper = F.pow(F.lit(2), F.floor(F.log2(n)) + 1) - 1
    keep = (upper - F.ceil(upper * percent / 100) + 1).cast("int")
    return sets.where(n > 0).select("item", n.alias("n"), F.explode(F.slice(F.sort_array("set"), 1, keep)).alias("h"))


def short_lengths(items: DataFrame, text: str = "text", size: int = SHINGLE) -> list[int]:
    """Numbers of words, below ``size``, that items have: at most ``size`` - 1 rows."""
    found = items.select(F.size(words(F.col(text))).alias("n")).where((F.col("n") > 0) & (F.col("n") < size)).distinct()
    return sorted(row["n"] for row in found.collect())


def _windows_of(text: Column, lengths: list[int], size: int) -> Column:
    """Distinct hashes of a text's shingles, and of its windows of each of ``lengths`` words."""
    if not lengths:
        return shingles(text, size)
    none = F.array().cast("array<bigint>")
    each = lambda found: F.concat(*[F.coalesce(windows(found, n, lambda *w: F.xxhash64(*w)), none) for n in lengths])
    return F.array_union(shingles(text, size), let(words(lowered(text)), each))


def _phrases(text: Column, n: int) -> Column:
    """Distinct windows of ``n`` words, as text."""
    return F.array_distinct(let(words(lowered(text)), lambda found: windows(found, n, lambda *w: F.concat_ws(" ", *w))))


def candidates(docs: DataFrame, items: DataFrame, text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """Distinct (doc, item) hashes of texts that share a sketch hash and whose sizes allow the containment."""
    sketch = materialize(item_sketches(items, "text", percent, size), "sketch")
    largest = sketch.agg(F.max("h")).first()[0]
    lengths = short_lengths(items, "text", size)
    sets = docs.select(F.xxhash64(text).alias("doc"), _windows_of(F.col(text), lengths, size).alias("set"))
    low = sets.select("doc", F.size("set").alias("n_doc"), F.filter("set", lambda h: h <= F.lit(largest)).alias("low"))
    probes = low.where(F.lit(largest is not None)).select("doc", "n_doc", F.explode("low").alias("h"))
    fits = F.col("n_doc") * 100 >= F.col("n") * percent
    return probes.join(sketch, "h").where(fits).select("doc", "item").distinct()


def find(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    percent: int = PERCENT,
    size: int = SHINGLE,
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, doc): items of which a document holds ``percent`` of the shingles.

    ``doc`` is the hash of the document's text, for joining back.
    """
    pairs = materialize(candidates(docs, items.select(F.col(text).alias("text")), text, percent, size), "candidates")
    named = items.select(
        F.xxhash64(text).alias("item"), F.col(item_key).alias("item_id"), F.col(text).alias("_item_text")
    )
    held = docs.select(F.xxhash64(text).alias("doc"), F.col(key).alias("doc_id"), F.col(text).alias("_doc_text"))
    met = held.join(pairs, "doc").join(named, "item")
    n_words, held_set = F.size(words(F.col("_item_text"))), shingles(F.col("_doc_text"), size, joined=True)
    for n in short_lengths(items, text, size):
        held_set = F.when(n_words == n, _phrases(F.col("_doc_text"), n)).otherwise(held_set)
    sets = met.select(
        "doc_id",
        "item_id",
        "doc",
        shingles(F.col("_item_text"), size, joined=True).alias("_wanted"),
        held_set.alias("_held"),
    )
    counted = sets.select(
        "doc_id",
        "item_id",
        F.size("_wanted").cast("bigint").alias("n_item"),
        F.size(F.array_intersect("_wanted", "_held")).cast("bigint").alias("n_shared"),
        "doc",
    )
    return counted.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    keyed = docs.select(F.lit(0).alias("k"), F.col(text).alias("text"))
    named = items.select(F.lit(0).alias("i"), F.col(text).alias("text"))
    found = find(keyed, named, "k", "i", "text", percent, size)
    (hit,) = spare(docs, "_hit")
    hits = materialize(found.select(F.col("doc").alias(hit)).distinct(), "hits")
    return docs.join(hits, F.xxhash64(text) == F.col(hit), "left_anti")
