"""N-gram Jaccard join by PartEnum signatures, down to groups of linked documents.

Sets fall into size bands; sets that are similar enough are in the same or in neighbouring bands, and differ in at
most ``k`` elements, known from the larger band. For each of its two bands a set is dealt by hash into ``k // 2 + m``
parts, and each part into three; the signatures of a part are its three subsets of two thirds. Of similar sets' parts
at least ``m`` differ in one element or none, and share a signature. A signature of no elements tells nothing: sets
with ``m`` or more parts that have one, for which all shared signatures could be empty, get a signature for each
choice of ``m`` such parts (three if ``m`` is more) instead, and all others may leave theirs out. No pair is lost.
``m`` grows with the number of such parts that the smallest sets must expect, so that few sets have as many; a band in
which the choices of three could pass a million takes two or one instead, so that a set's signatures are bounded.

Screening: a set can only be similar to another one if all but a known share of its elements occur elsewhere. The
elements below a fixed value, a sample that is the same for all sets, are counted; sets that have too many of them for
themselves alone cannot be linked to anything, and make no signatures. This drops no link.

Work on pairs: equal sets are one node. Nodes that share signatures of three elements or more form clusters, and a
cluster is compared as a whole in one task, each text travelling once. Signatures of one or two elements, which
frequent passages share with many, would tie unrelated clusters together. Their buckets compare parity bitmaps of the
sets, whose difference is never more than the sets': pairs of different clusters that stay within the bound are few,
and are verified on their texts. Clusters too large for a task are compared bucket by bucket. Buckets come in blocks of
bounded size and pairs of blocks. A comparison counts common
elements of all its texts by matrix products, and returns a spanning forest of the links and each node's number of
links, so that rows do not grow with the square of a group. A pair that several buckets share is counted in the
smallest.

Memory: a task takes a few megabytes of texts at a time, and of the counts of a comparison one matrix of whole numbers.

Scale: signatures are 64-bit numbers, about 0.4 (90 %) to 0.9 (80 %) a word, made once a task for equal sets; buckets
stream by in sorted order. Copies only meet their node in a plain join at the end. Nodes are 64-bit fingerprints of
sets; links are decided by counting.

Defined results: A-Z are lower-cased; a text with fewer words than a shingle is one shingle; NULL, empty and wordless
texts have no set and no links; rows that repeat are copies; a component's id is its smallest document id, NULL if
all are NULL; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, materialize_at, release, scratch_path
from .graph import components, in_tasks
from .hashing import mix, shingle_sets
from .words import spare

_U = np.uint64
STRONG = 3
TOGETHER = 3
MOST_CHOICES = 1_000_000
# Bytes of a batch that are taken at once, cells of a block of a membership matrix, and rows of counts.
PART, BLOCK_CELLS, STRIPE = 4 << 20, 1 << 22, 128


@dataclass(frozen=True)
class Limits:
    """What one task compares at once, in elements and in texts."""

    elements: int = 1_000_000
    texts: int = 3000


class Signatures:
    """PartEnum signatures for ``percent`` Jaccard similarity."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows, self.highs = [1], [100 // percent]
        self.plans: dict[int, tuple[int, int, int]] = {}
        self._grow(64)

    def _grow(self, n: int) -> None:
        while self.highs[-1] < n:
            self.lows.append(self.highs[-1] + 1)
            self.highs.append(self.lows[-1] * 100 // self.percent)

    def plan(self, band: int) -> tuple[int, int, int]:
        """(k, m, parts) for pairs whose larger set is in ``band``."""
        if band not in self.plans:
            self.plans[band] = self._planned(band)
        return self.plans[band]

    def _planned(self, band: int) -> tuple[int, int, int]:
        self._grow(self.highs[min(band, len(self.highs) - 1)] + 1)
        while band >= len(self.highs):
            self._grow(self.highs[-1] + 1)
        k = 2 * self.highs[band] * (100 - self.percent) // (100 + self.percent)
        if k < 6:
            return k, 1, k // 2 + 1
        # Below a similarity of about 80 % more parts only make more of them empty, and no share is enough.
        for share in (24, 20, 16, 14, 12, 10, 8, 6):
            m = 3 + k // share
            parts = k // 2 + m
            often = self._often_empty(self.lows[max(band - 1, 0)], parts)
            few = together(m, parts) == TOGETHER and math.comb(often, TOGETHER) <= 3 * parts
            if often < m or few:
                return k, m, parts
        return k, 3 + k // 24, k // 2 + 3 + k // 24

    @staticmethod
    def _often_empty(n: int, parts: int) -> int:
        """Parts with an empty two-thirds that few sets of ``n`` elements exceed: two deviations above the mean."""
        share = 3 * math.exp(-2 * n / (3 * parts)) - 2 * math.exp(-n / parts)
        return int(parts * share + 2 * math.sqrt(parts * share))

    def of(self, elements: np.ndarray) -> np.ndarray:
        """Signatures of a set; the lowest bit is set for weak ones. Equal sets need none."""
        if not len(elements):
            return elements
        self._grow(len(elements))
        band = int(np.searchsorted(self.highs, len(elements)))
        made = [self._of_band(elements, b) for b in (band, band + 1)]
        return np.unique(np.concatenate(made))

    def _of_band(self, elements: np.ndarray, band: int) -> np.ndarray:
        k, m, parts = self.plan(band)
        if not k:
            return elements[:0]
        dealt = mix(elements + _U(band))
        cell = (dealt >> _U(40)) % _U(parts) * _U(3) + (dealt & _U(0xFFFF)) % _U(3)
        cell = cell.astype(np.int64)
        size = np.bincount(cell, minlength=3 * parts).reshape(-1, 3)
        low = np.bincount(cell, (elements & _U(0xFFFFFFFF)).astype(np.float64), 3 * parts)
        high = np.bincount(cell, (elements >> _U(32)).astype(np.float64), 3 * parts)
        total = (low.astype(_U) + (high.astype(_U) << _U(32))).reshape(-1, 3)
        kept = size.sum(1)[:, None] - size
        value = total.sum(1, dtype=_U)[:, None] - total
        tag = np.arange(3 * parts, dtype=_U).reshape(-1, 3) + _U(band << 32)
        made = mix(mix(value) + mix(tag)) & ~_U(511) | _U(band << 1) | (kept < STRONG).astype(_U)
        made = made[kept > 0]
        empty = np.flatnonzero((kept == 0).any(1)).tolist()
        if len(empty) >= m:
            width = together(m, parts)
            chosen = itertools.chain.from_iterable(itertools.combinations(empty, width))
            choices = np.fromiter(chosen, _U).reshape(-1, width)
            code = np.full(len(choices), mix(np.array([band << 32 | 1 << 31], _U))[0])
            for column in choices.T:
                code = mix(code + column)
            made = np.concatenate([made, code & ~_U(511) | _U(band << 1 | 1)])
        return made

    def bitmap(self, elements: np.ndarray, band: int) -> bytes:
        """For each of some four bits per element that may differ, whether the set has an odd number of elements there."""
        bits = max(128, 1 << (4 * self.plan(band)[0]).bit_length())
        return np.packbits(np.bincount((mix(elements) % _U(bits)).astype(np.int64), minlength=bits) & 1).tobytes()

    def bitmaps(self, elements: np.ndarray) -> list[tuple[int, bytes]]:
        self._grow(len(elements))
        band = int(np.searchsorted(self.highs, len(elements)))
        return [(b, self.bitmap(elements, b)) for b in (band, band + 1)]


def together(m: int, parts: int) -> int:
    """How many empty parts make one signature, the same for all sets of a band."""
    return next(t for t in range(min(m, TOGETHER), 0, -1) if t == 1 or math.comb(parts, t) <= MOST_CHOICES)


def node_of(elements: np.ndarray) -> int | None:
    return int(np.array([xxhash.xxh64_intdigest(elements.tobytes())], _U).view(np.int64)[0]) if len(elements) else None


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in column]


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about ``PART`` bytes, so that what is made of one does not grow with a batch's texts."""
    for batch in batches:
        rows = max(1, batch.num_rows * PART // max(batch.nbytes, 1))
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


def sample_bound(percent: int) -> np.uint64:
    """Elements up to this value are screened: half as many again as may be missing from a similar set."""
    return _U(min(1.0, 1.5 * (100 - percent) / 100) * 2.0**63) * _U(2)


def documents(docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """(row, doc_id, node, n, sampled): each document's set; ``row`` is the hash of its id and text."""
    bound = sample_bound(percent)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            sets = shingle_sets(_bytes(batch.column(2)), size)
            nodes = pa.array([node_of(s) for s in sets], pa.int64())
            counts = pa.array([len(s) for s in sets], pa.int64())
            sampled = pa.array([int(np.searchsorted(s, bound)) for s in sets], pa.int64())
            columns = [batch.column(0), batch.column(1), nodes, counts, sampled]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "node", "n", "sampled"])

    chosen = docs.select(F.xxhash64(key, text).alias("row"), F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return materialize(chosen.mapInArrow(measure, "row bigint, doc_id bigint, node bigint, n bigint, sampled bigint"), "sets")


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (element, node): (node, common), the number of elements that several nodes have."""
    last = (None, None, True)  # element, node, already counted
    for batch in batches:
        if not batch.num_rows:
            continue
        element, node = (c.to_numpy() for c in batch.columns)
        fresh = np.ones(len(element), bool)
        fresh[1:] = (element[1:] != element[:-1]) | (node[1:] != node[:-1])
        fresh[0] = (element[0], node[0]) != last[:2]
        element, node = element[fresh], node[fresh]
        if not len(element):
            continue
        follows = np.zeros(len(element), bool)
        follows[1:] = element[1:] == element[:-1]
        follows[0] = element[0] == last[0]
        met = follows.copy()
        met[:-1] |= follows[1:]
        found = node[met]
        if follows[0] and not last[2]:
            found = np.append(found, last[1])
        last = (element[-1], node[-1], bool(met[-1]))
        nodes, counts = np.unique(found, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(counts)], ["node", "common"])


def linkable(docs: DataFrame, nodes: DataFrame, size: int, percent: int, text: str) -> DataFrame:
    """The ``nodes`` whose sampled elements occur elsewhere often enough for a link."""
    bound = sample_bound(percent)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in _in_parts(batches):
            elements, owners = [np.empty(0, _U)], [np.empty(0, np.int64)]
            for s in shingle_sets(_bytes(batch.column(0)), size):
                node = node_of(s)
                if node is not None and node not in seen:
                    seen.add(node)
                    elements.append(s[: np.searchsorted(s, bound)])
                    owners.append(np.full(len(elements[-1]), node, np.int64))
            columns = [pa.array(np.concatenate(elements).view(np.int64)), pa.array(np.concatenate(owners))]
            yield pa.RecordBatch.from_arrays(columns, ["element", "node"])

    rows = docs.select(text).mapInArrow(sample, "element bigint, node bigint")
    ordered = rows.repartition("element").sortWithinPartitions("element", "node")
    counted = ordered.mapInArrow(_common, "node bigint, common bigint").groupBy("node").agg(F.sum("common").alias("common"))
    counted = materialize(counted.select(F.col("node").alias("_node"), "common"), "common")
    missing = F.floor(F.col("n") * (100 - percent) / 100)
    enough = F.coalesce("common", F.lit(0)) >= F.col("sampled") - missing
    return nodes.join(counted, F.col("node") == F.col("_node"), "left").where(enough).select(*nodes.columns)


def signature_rows(docs: DataFrame, size: int, percent: int, text: str) -> DataFrame:
    """(sig, node), a node once a task."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Signatures(percent), set()
        for batch in _in_parts(batches):
            sigs, nodes = [np.empty(0, _U)], [np.empty(0, np.int64)]
            for s in shingle_sets(_bytes(batch.column(0)), size):
                node = node_of(s)
                if node is not None and node not in seen:
                    seen.add(node)
                    sigs.append(make.of(s))
                    nodes.append(np.full(len(sigs[-1]), node, np.int64))
            columns = [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))]
            yield pa.RecordBatch.from_arrays(columns, ["sig", "node"])

    return docs.select(text).mapInArrow(sign, "sig bigint, node bigint")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, node): (sig, first, node) for every node but a signature's first, and for the first of
    a weak one that is shared. The last row's signature and first node are all that is held."""
    held = None  # (sig, first node, last node, told)
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node = (c.to_numpy() for c in batch.columns)
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        if held is not None:
            fresh[0] = (sig[0], node[0]) != (held[0], held[2])
        sig, node = sig[fresh], node[fresh]
        if not len(sig):
            continue
        opens = np.ones(len(sig), bool)
        opens[1:] = sig[1:] != sig[:-1]
        first = node[np.maximum.accumulate(np.where(opens, np.arange(len(sig)), 0))]
        if held is not None and sig[0] == held[0]:
            run = int(np.argmax(opens[1:])) + 1 if opens[1:].any() else len(sig)
            opens[0] = False
            first[:run] = held[1]
        follows = ~opens
        rows = [(sig[follows], first[follows], node[follows])]
        second = follows.copy()
        second[1:] &= opens[:-1]
        if held is not None and follows[0]:
            second[0] = not held[3]
        else:
            second[0] = False
        weak = second & ((sig & 1) == 1)
        rows.append((sig[weak], first[weak], first[weak]))
        told = bool(follows[-1])
        held = (sig[-1], first[-1], node[-1], told)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["sig", "first", "node"])


def linked(sets: list[np.ndarray], percent: int, left: int | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i < j, of linked sets; with ``left``, only pairs of one of the first ``left`` and one of the rest.

    Beside one matrix of counts only stripes of ``STRIPE`` rows of it are held, and only their pairs.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    top, low = (m, 0) if left is None else (left, left)
    common = np.zeros((top, m - low), np.int32)
    if m == 2:
        common[0, -1] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        every = np.concatenate(sets)
        _, ids, counts = np.unique(every, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), sizes)
        again = counts[ids] > 1
        ids, owner = ids[again], owner[again]
        _, ids = np.unique(ids, return_inverse=True)
        order = np.argsort(ids, kind="stable")
        ids, owner = ids[order], owner[order]
        width = max(256, min(8192, BLOCK_CELLS // m))
        for start in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
            a, b = np.searchsorted(ids, [start, start + width])
            block = np.zeros((m, width), np.float32)
            block[owner[a:b], ids[a:b] - start] = 1
            for at in range(0, top, STRIPE):
                common[at : at + STRIPE] += (block[at : min(at + STRIPE, top)] @ block[low:].T).astype(np.int32)
    for at in range(0, top, STRIPE):
        some = common[at : at + STRIPE].astype(np.int64)
        i, j = np.nonzero(100 * some >= percent * (sizes[at : at + len(some), None] + sizes[None, low:] - some))
        i, j = i + at, j + low
        yield from zip(i[i < j].tolist(), j[i < j].tolist())


class Forest:
    """Links as a spanning forest, and the number of linked documents of each text."""

    def __init__(self, copies: list[int]):
        self.root = list(range(len(copies)))
        self.copies = copies
        self.links = [0] * len(copies)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def link(self, i: int, j: int, counted: bool = True) -> None:
        if counted:
            self.links[i] += self.copies[j]
            self.links[j] += self.copies[i]
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def rows(self, nodes: list[int]) -> list[tuple[int, int, int]]:
        return [(nodes[self.find(i)], nodes[i], n) for i, n in enumerate(self.links) if n or self.find(i) != i]


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows that agree in their first ``width`` columns, which come sorted."""
    held: list[tuple] = []
    for batch in _in_parts(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:width] != held[0][:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


LINKS = "a bigint, b bigint, links bigint"


def _link_batches(found: Iterator[list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, int, int]] = []
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "links")])
    for more in found:
        rows += more
        if len(rows) > 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)


def compare_clusters(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links inside whole clusters, from (cluster, node, copies, text) in partitions by cluster."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for group in _grouped(batches, 1):
                group = list({r[1]: r for r in group}.values())
                if len(group) > 1:
                    forest = Forest([r[2] for r in group])
                    for i, j in linked(shingle_sets([r[3].encode() for r in group], size), percent):
                        forest.link(i, j)
                    yield forest.rows([r[1] for r in group])

        yield from _link_batches(found())

    spread = rows.select("cluster", "node", "copies", "text").repartition("cluster").sortWithinPartitions("cluster", "node")
    return spread.mapInArrow(compare, LINKS)


def compare_buckets(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links inside pairs of blocks of a bucket, from (sig, low, high, block, node, copies, whole, text).

    Pairs of one cluster (``whole``) are compared; those of different ones are left to the bitmaps.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Signatures(percent)

        def found():
            for group in _grouped(batches, 3):
                group = sorted({r[4]: r for r in group}.values(), key=lambda r: (r[3], r[4]))
                sig, low, high = group[0][:3]
                left = None if low == high else sum(r[3] == low for r in group)
                if len(group) < 2 or left in (0, len(group)):
                    continue
                sets = shingle_sets([r[7].encode() for r in group], size)
                forest = Forest([r[5] for r in group])
                signed: dict[int, np.ndarray] = {}
                for i, j in linked(sets, percent, left):
                    if group[i][6] == group[j][6]:
                        a, b = (signed.setdefault(x, make.of(sets[x]).view(np.int64)) for x in (i, j))
                        common = np.intersect1d(a, b, assume_unique=True)
                        forest.link(i, j, counted=int(common[0]) == sig)
                yield forest.rows([r[4] for r in group])

        yield from _link_batches(found())

    columns = ["sig", "low", "high", "block", "node", "copies", "whole", "text"]
    spread = rows.select(*columns).repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high")
    return spread.mapInArrow(compare, LINKS)


def close_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different clusters whose bitmaps allow a link, from (sig, low, high, block, node, cluster, bits)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Signatures(percent)
        for group in _grouped(batches, 3):
            group = sorted({r[4]: r for r in group}.values(), key=lambda r: (r[3], r[4]))
            sig, low, high = group[0][:3]
            left = len(group) if low == high else sum(r[3] == low for r in group)
            k = make.plan(sig >> 1 & 255)[0]
            maps = np.frombuffer(b"".join(r[6] for r in group), _U).reshape(len(group), -1)
            node = np.array([r[4] for r in group])
            cluster = np.array([r[4] if r[5] is None else r[5] for r in group])
            for i in range(min(left, len(group) - 1)):
                rest = slice(i + 1 if low == high else left, None)
                close = np.bitwise_count(maps[rest] ^ maps[i]).sum(1) <= k
                found = node[rest][close & (cluster[rest] != cluster[i])]
                if len(found):
                    pair = np.minimum(found, node[i]), np.maximum(found, node[i])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["a", "b"])

    columns = ["sig", "low", "high", "block", "node", "cluster", "bits"]
    spread = rows.select(*columns).repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high")
    return materialize(spread.mapInArrow(compare, "a bigint, b bigint").distinct(), "close-pairs")


def node_bitmaps(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, band, bits) of each node of (node, text)."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Signatures(percent)
        for batch in _in_parts(batches):
            rows = [
                (node, band, bits)
                for node, s in zip(batch.column(0).to_pylist(), shingle_sets(_bytes(batch.column(1)), size))
                for band, bits in make.bitmaps(s)
            ]
            if rows:
                kinds = pa.int64(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["node", "band", "bits"])

    drawn = texts.select("node", "text").mapInArrow(draw, "node bigint, band bigint, bits binary")
    return drawn.dropDuplicates(["node", "band"])


def verify_pairs(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among the given pairs (a, b), each pair once, from (node, copies, text)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in _in_parts(batches):
                a, b, n, m, s, t = (c.to_pylist() for c in batch.columns)
                sets = shingle_sets([x.encode() for x in s + t], size)
                for i in range(len(a)):
                    if next(iter(linked([sets[i], sets[len(a) + i]], percent)), None):
                        # An edge with the links of b, and the links of a as a row of its own.
                        yield [(a[i], b[i], n[i]), (a[i], a[i], m[i])]

        yield from _link_batches(found())

    one = texts.select(F.col("node").alias("a"), F.col("copies").alias("n"), F.col("text").alias("s"))
    two = texts.select(F.col("node").alias("b"), F.col("copies").alias("m"), F.col("text").alias("t"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "s", "t")
    return met.mapInArrow(verify, LINKS)


def in_blocks(buckets: DataFrame, limits: Limits) -> DataFrame:
    """(sig, low, high, block, node): the pairs of blocks of each bucket of (sig, node, n) that has two nodes or more."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig = None
        number = elements = texts = 0
        for batch in batches:
            blocks = []
            for s, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if s != sig:
                    sig, number, elements, texts = s, 0, 0, 0
                if texts and (elements + n > limits.elements // 2 or texts + 1 > limits.texts // 2):
                    number, elements, texts = number + 1, 0, 0
                elements += n
                texts += 1
                blocks.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blocks, pa.int64())], ["sig", "node", "block"])

    spread = buckets.select("sig", "node", "n").repartition("sig").sortWithinPartitions("sig", "node")
    placed = materialize(spread.mapInArrow(block, "sig bigint, node bigint, block bigint"), "blocks")
    most = placed.groupBy("sig").agg(F.max("block").alias("most"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("most"))).alias("other")
    met = placed.join(materialize(most, "bucket-sizes"), "sig").select("sig", "node", "block", other)
    return met.select("sig", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node")


def find_links(docs: DataFrame, nodes: DataFrame, size: int, percent: int, text: str, limits: Limits) -> DataFrame:
    """(a, b, links) of linked nodes: a spanning forest of edges, and the numbers of linked documents of each b."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in _in_parts(batches):
            found = [node_of(s) for s in shingle_sets(_bytes(batch.column(0)), size)]
            keep = []
            for node in found:
                keep.append(node is not None and node not in seen)
                seen.add(node)
            made = pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), batch.column(0)], ["node", "text"])
            yield made.filter(pa.array(keep, pa.bool_()))

    n_nodes = nodes.count()
    chosen = materialize(linkable(docs, nodes, size, percent, text).select("node"), "linkable")
    texts = docs.select(text).mapInArrow(once, "node bigint, text string").join(chosen.hint("shuffle_hash"), "node")
    paths = [scratch_path(docs.sparkSession, label) for label in ("linkable-texts", "compared-texts")]
    texts = materialize_at(texts, paths[0])
    rows = signature_rows(texts, size, percent, "text")
    sorted_rows = rows.repartition("sig").sortWithinPartitions("sig", "node")
    shared = materialize(sorted_rows.mapInArrow(_shared, "sig bigint, first bigint, node bigint"), "shared")
    weak = F.col("sig").bitwiseAND(F.lit(1)) == 1
    clusters = components(shared.where(~weak).select(F.col("first").alias("a"), F.col("node").alias("b")))
    sized = clusters.join(nodes, "node").select("node", F.col("root").alias("cluster"), "n", "copies")
    sized = materialize(in_tasks(sized, n_nodes), "clusters")
    totals = sized.groupBy("cluster").agg(F.sum("n").alias("elements"), F.count(F.lit(1)).alias("texts"))
    large = totals.where((F.col("elements") > limits.elements) | (F.col("texts") > limits.texts))
    large = materialize(in_tasks(large.select(F.col("cluster").alias("_large")), n_nodes), "large-clusters")
    loose = shared.where(weak).select("sig", "node").distinct()
    placed = (
        nodes.join(sized.select("node", "cluster"), "node", "left")
        .join(loose.select("node").distinct().withColumn("loose", F.lit(True)), "node", "left")
        .where("cluster is not null or loose")
        .join(large, F.col("cluster") == F.col("_large"), "left")
        .select("node", "n", "copies", "cluster", F.col("_large").isNotNull().alias("large"))
    )
    placed = materialize(in_tasks(placed, n_nodes), "compared")
    texts = materialize_at(texts.join(placed.hint("shuffle_hash"), "node"), paths[1])
    links = compare_clusters(texts.where("cluster is not null and not large"), size, percent)
    held = texts.select("node", "copies", "cluster", "text", "large").dropDuplicates(["node"])
    if not loose.isEmpty():
        blocks = in_blocks(loose.join(nodes.select("node", "n"), "node"), limits)
        band = F.shiftright("sig", 1).bitwiseAND(F.lit(255))
        maps = node_bitmaps(texts.join(loose.select("node").distinct(), "node", "left_semi"), size, percent)
        drawn = blocks.withColumn("band", band).join(maps, ["node", "band"]).join(placed.select("node", "cluster"), "node")
        close = close_pairs(drawn, percent)
        if not close.isEmpty():
            links = links.unionByName(verify_pairs(close, held, size, percent))
    if not large.isEmpty():
        buckets = materialize(signature_rows(texts.where("large"), size, percent, "text").distinct(), "buckets")
        blocks = in_blocks(buckets.join(nodes.select("node", "n"), "node"), limits)
        whole = held.where("large").select("node", "copies", F.col("cluster").alias("whole"), "text")
        links = links.unionByName(compare_buckets(blocks.join(whole, "node"), size, percent))
    links = materialize(links, "links")
    for path in paths:  # the texts are not needed beyond the written links
        release(docs.sparkSession, path)
    return links


def join(
    docs: DataFrame, size: int, percent: int, key: str = "doc_id", text: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """(row, doc_id, node, n_shingles, component_id, n_links, root) of each document.

    ``root`` names the component (NULL without a set), ``row`` the document by a hash of its id and text.
    """
    measured = documents(docs, size, percent, key, text)
    nodes = materialize(
        measured.where("node is not null")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.max("n").alias("n"),
            F.max("sampled").alias("sampled"),
            F.count(F.lit(1)).alias("copies"),
        ),
        "nodes",
    )
    links = find_links(docs, nodes, size, percent, text, limits)
    roots = components(links.select("a", "b"))
    counted = links.groupBy(F.col("b").alias("node")).agg(F.sum("links").alias("links"))
    named = nodes.join(roots, "node", "left").join(counted, "node", "left")
    named = named.select("node", "doc_id", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    n_nodes = nodes.count()
    named = materialize(in_tasks(named, n_nodes), "named")
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    others = (F.col("links") + F.col("copies") - 1).alias("n_links")
    told = named.join(smallest, "root").select(F.col("node").alias("_node"), "root", "component_id", others)
    told = materialize(in_tasks(told, n_nodes), "told")
    return measured.join(told, F.col("node") == F.col("_node"), "left").select(
        "row",
        "doc_id",
        "node",
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        "root",
    )


def one_of_each(docs: DataFrame, size: int, percent: int, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with one document of each component: the smallest (id, text hash), NULL ids last; one of equal rows.

    Documents without a set stay.
    """
    found = join(docs, size, percent, key, text, limits).where("root is not null")
    joined = materialize(found.select("row", "doc_id", "root"), "joined")
    place = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("row"))
    best = materialize(joined.groupBy(F.col("root").alias("_root")).agg(F.min(place)["row"].alias("_best")), "best")
    ranked = joined.join(best, F.col("root") == F.col("_root"))
    (named,) = spare(docs, "_row")
    losers = materialize(ranked.where("row <> _best").select(F.col("row").alias(named)).distinct(), "losers")
    equal = materialize(joined.groupBy(F.col("row").alias(named)).count().where("count > 1").select(named), "equal-rows")
    row = F.xxhash64(key, text)
    kept = docs.join(losers.hint("shuffle_hash"), row == F.col(named), "left_anti")
    if equal.isEmpty():
        return kept
    alone = kept.join(equal, row == F.col(named), "left_anti")
    single = kept.join(equal, row == F.col(named), "left_semi").withColumn(named, row).dropDuplicates([named]).drop(named)
    return alone.unionByName(single)
