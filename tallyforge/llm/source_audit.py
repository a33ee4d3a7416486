"""How far the sources of a language differ in their words, and by which words.

Each language keeps the terms found in at least ``min_docs`` of its documents. A group is a source within a language;
a term with ``count`` occurrences in a group of ``N`` has the share ``1 + floor(ONE * (count + ADD) / (N + ADD * V))``,
``V`` being the language's kept terms. :meth:`Audit.pairs` gives the summed share differences of any two groups of a
language, :meth:`Audit.terms` what each group uses more than its language does. All arithmetic is on whole numbers.

Pairs are priced on hash-consed segment trees over term ids. A language's terms are dealt into blocks and numbered
there from the rarest on, so that the many small counts of a block stand together. A group's tree over a block has its
counts as leaves; equal subtrees of all groups are one node, whatever their place. Two trees are traversed together
from the roots, level by level: a pair of nodes met more than once in a level is followed and priced once, since the
price of a pair depends only on its two subtrees and the two groups. Blocks are the upper part of the tree: their
prices are summed by Spark.

Scale: words are counted in tasks, in maps that are passed on at ``FLUSH`` entries, so that what is shuffled are
counts and not words; they combine by (language, term, source) before the sums by (language, term), of a row a source
at most. A task of the pricing holds ``BLOCK`` terms of two tiles of ``TILE`` sources; larger languages have more
blocks and more sources more tiles. The result has a row for each ordered pair, as asked for.

Defined results: NULL text, language or source are empty; a document without terms still makes its group; a language
without kept terms has distance 0 between all its groups and no term rows; repeated documents count each; other columns
are not used, and an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize_at, release, scratch_path

MIN_DOCS, TOP = 30, 50
# Shares are parts of ONE, each term is given ADD occurrences more.
ONE, ADD = 1_000_000_000, 5

BLOCK, TILE, FLUSH = 4096, 128, 300_000

# Bytes up to 0x40, 0x5B-0x60 and 0x7B-0x7F part the terms; only A-Z are lower-cased.
TERM_BYTES = bytes(
    32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b <= 0x5A else b for b in range(256)
)
COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by group and term; the empty term counts a group's documents."""
    seen: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    held = 0

    def rows() -> pa.RecordBatch:
        langs, sources, terms, n, docs = [], [], [], [], []
        for (lang, source), (occurs, holds) in seen.items():
            langs += [lang] * len(holds)
            sources += [source] * len(holds)
            terms += holds.keys()
            n += [occurs[t] for t in holds]
            docs += holds.values()
        columns = [pa.array(c, pa.binary()).cast(pa.string()) for c in (langs, sources, terms)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in batch.columns]):
            occurs, holds = seen[lang, source]
            held -= len(holds)
            words = text.translate(TERM_BYTES).split()
            occurs.update(words)
            holds.update(set(words))
            holds[b""] += 1
            held += len(holds)
            if held > FLUSH:
                yield rows()
                seen.clear()
                held = 0
    if seen:
        yield rows()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences, and documents with the term; the empty term has all documents."""
    held = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(f"c{i}") for i, c in enumerate((lang, source, text))])
    found = held.mapInArrow(_counted, COUNTED)
    return found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, n: Column, terms: Column) -> Column:
    """Share of a term; the product is formed in 38 digits."""
    top = (count + F.lit(ADD)).cast("decimal(28,0)") * F.lit(ONE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, (n + F.lit(ADD) * terms).cast("decimal(28,0)"))


def shares(counts: np.ndarray, n: int, terms: int) -> np.ndarray:
    """Shares of whole-number counts, in Python's integers where 64 bits could overflow."""
    if len(counts) and int(counts.max()) > 2**62 // ONE:
        return np.array([1 + ONE * (int(c) + ADD) // (n + ADD * terms) for c in counts], np.int64)
    return 1 + ONE * (counts + ADD) // (n + ADD * terms)


@dataclass
class Forest:
    """Trees of one block: ``roots[group]``, nodes of each level as child pairs, and the counts of the leaves.

    ``levels[0]`` are the nodes just above the leaves. A block of m terms has the next power of two as leaves; those
    past m are the leaf after the last count and cost nothing.
    """

    counts: np.ndarray
    levels: list[np.ndarray]
    roots: np.ndarray


def grow(matrix: np.ndarray) -> Forest:
    """Hash-consed trees of the rows of ``matrix`` (group, term)."""
    groups, width = matrix.shape
    size = 1 << max(width - 1, 0).bit_length()
    counts, leaf = np.unique(matrix, return_inverse=True)
    ids = np.full((groups, size), len(counts), np.int64)
    ids[:, :width] = leaf.reshape(matrix.shape)
    levels = []
    kinds = len(counts) + 1
    while ids.shape[1] > 1:
        both = ids[:, ::2] * kinds + ids[:, 1::2]
        nodes, ids = np.unique(both, return_inverse=True)
        ids = ids.reshape(both.shape)
        levels.append(np.stack([nodes // kinds, nodes % kinds], axis=1))
        kinds = len(nodes)
    return Forest(counts, levels, ids[:, 0])


def price(forest: Forest, a: int, b: int, share_a: np.ndarray, share_b: np.ndarray) -> int:
    """Summed differences of two trees' leaves; ``share_x`` are the shares of the leaves' counts in group x."""
    pairs = np.array([[forest.roots[a], forest.roots[b]]])
    back = []
    for nodes in reversed(forest.levels):
        children = np.concatenate([np.stack([nodes[pairs[:, 0], side], nodes[pairs[:, 1], side]], axis=1) for side in (0, 1)])
        span = int(children.max()) + 1
        codes, where = np.unique(children[:, 0] * span + children[:, 1], return_inverse=True)
        back.append(where)
        pairs = np.stack([codes // span, codes % span], axis=1)
    last = len(forest.counts)
    real = pairs[:, 0] < last  # both trees end at the same place
    cost = np.zeros(len(pairs), np.int64)
    cost[real] = np.abs(share_a[pairs[real, 0]] - share_b[pairs[real, 1]])
    for where in reversed(back):
        both = cost[where]
        cost = both[: len(both) // 2] + both[len(both) // 2 :]
    return int(cost[0])


PRICED = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])


def _priced(key: tuple, rows: pa.Table) -> pa.Table:
    """Partial distances between the groups of tile i and those of tile j on one block."""
    i, j = key[2].as_py(), key[3].as_py()
    group, tile = rows["g"].to_numpy(), rows["tile"].to_numpy()
    terms, width = rows["n_terms"][0].as_py(), rows["width"][0].as_py()
    first, second, value = [], [], []
    if width:
        matrix = np.zeros((len(rows), width), np.int64)
        for at in range(len(rows)):
            places = rows["places"][at].values
            if places is not None:
                matrix[at, places.to_numpy()] = rows["counts"][at].values.to_numpy()
        forest = grow(matrix)
        held = [shares(forest.counts, n, terms) for n in rows["total"].to_pylist()]
    for x in np.flatnonzero(tile == i):
        for y in np.flatnonzero((tile == j) & ((group > group[x]) | (i != j))):
            first.append(min(group[x], group[y]))
            second.append(max(group[x], group[y]))
            value.append(price(forest, x, y, held[x], held[y]) if width else 0)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(([key[0].as_py()] * len(value), first, second, value), PRICED)], schema=PRICED)


@dataclass
class Audit:
    """Counts of kept terms and groups, written below the scratch folder until :meth:`release`."""

    counts: DataFrame  # lang, term, source, n, all_n: kept terms that occur in the group
    groups: DataFrame  # lang, source, g, total, n_terms, all_total
    blocks: DataFrame  # lang, term, block, place
    widths: DataFrame  # lang, block, width
    paths: list[str]

    def release(self) -> None:
        for path in self.paths:
            release(self.groups.sparkSession, path)

    def distances(self, tile: int = TILE) -> DataFrame:
        """``lang, source, other, value`` for each unordered pair of a language's groups, the smaller number first."""
        groups = self.groups.withColumn("tile", F.floor((F.col("g") - 1) / tile).cast("int"))
        placed = self.counts.join(self.blocks, ["lang", "term"]).join(groups.select("lang", "source", "g"), ["lang", "source"])
        # At most a block's terms in a list.
        held = placed.groupBy("lang", "block", "g").agg(F.collect_list(F.struct("place", "n")).alias("held"))
        members = groups.join(self.widths, "lang").join(held, ["lang", "block", "g"], "left")
        tiles = groups.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"))
        dealt = members.join(tiles, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        rows = dealt.select(
            "lang", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"),
            "tile", "g", "total", "n_terms", "width", F.col("held.place").alias("places"), F.col("held.n").alias("counts"),
        )
        parts = rows.groupBy("lang", "block", "i", "j").applyInArrow(_priced, "lang string, a int, b int, value bigint")
        summed = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        first = self.groups.select("lang", F.col("g").alias("a"), "source")
        second = self.groups.select("lang", F.col("g").alias("b"), F.col("source").alias("other"))
        return summed.join(first, ["lang", "a"]).join(second, ["lang", "b"]).select("lang", "source", "other", "value")

    def pairs(self, tile: int = TILE) -> DataFrame:
        """``lang, source, item, value, rank``: every other source of the language, most different first."""
        found = self.distances(tile)
        both = found.select(
            "lang", "value",
            F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("other").alias("b")), F.struct(F.col("other").alias("a"), F.col("source").alias("b")))).alias("way"),
        )
        ranked = both.select("lang", F.col("way.a").alias("source"), F.col("way.b").alias("item"), "value")
        by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        return ranked.withColumn("rank", F.row_number().over(by))

    def terms(self, top: int = TOP) -> DataFrame:
        """``lang, source, item, value, rank``: terms whose share is above the language's, first ``top`` of each group."""
        met = self.counts.join(self.groups, ["lang", "source"])
        own, whole = share(F.col("n"), F.col("total"), F.col("n_terms")), share(F.col("all_n"), F.col("all_total"), F.col("n_terms"))
        over = met.where("n > 0").select("lang", "source", F.col("term").alias("item"), (own - whole).alias("value")).where("value > 0")
        by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        return over.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, block: int = BLOCK
) -> Audit:
    """Count, keep and number the terms; jobs run and what both results read is written when this is called."""
    spark = docs.sparkSession
    paths: list[str] = []

    def write(df: DataFrame, label: str) -> DataFrame:
        paths.append(scratch_path(spark, label))
        return materialize_at(df, paths[-1])

    counted = write(term_counts(docs, text, lang, source), "term-counts")
    words = counted.where("term <> ''")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    # Blocks are as many as their terms need, by the term's hash, so that no task sees a whole language.
    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("all_n").alias("all_total"))
    every = counted.where("term = ''").select("lang").distinct()
    langs = write(every.join(per_lang, "lang", "left").fillna(0, ["n_terms", "all_total"]), "langs")
    dealt = kept.join(langs.select("lang", "n_terms"), "lang").withColumn(
        "block", F.pmod(F.xxhash64("term"), F.ceil(F.col("n_terms") / block)).cast("int")
    )
    by = Window.partitionBy("lang", "block").orderBy("all_n", "term")
    blocks = write(dealt.select("lang", "term", "block", (F.row_number().over(by) - 1).alias("place"), "all_n"), "term-blocks")
    widths = blocks.groupBy("lang", "block").agg(F.count(F.lit(1)).cast("int").alias("width"))
    none = langs.where("n_terms = 0").select("lang", F.lit(0).alias("block"), F.lit(0).alias("width"))
    counts = write(words.select("lang", "term", "source", "n").join(blocks.select("lang", "term", "all_n"), ["lang", "term"]), "kept-counts")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = counted.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").fillna(0, ["total"])
    groups = write(groups.join(langs, "lang").withColumn("g", F.row_number().over(by_source)), "groups")
    return Audit(counts, groups, blocks.select("lang", "term", "block", "place"), widths.unionByName(none), paths)
