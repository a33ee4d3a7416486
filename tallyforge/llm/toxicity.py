"""Toxicity of texts as labels mark it, scored on texts with their disguises undone.

A character language model of the whole corpus (:mod:`char_model`) decodes leetspeak, spaced-out and stretched words.
The restored words' pieces (words with their edges marked, and their substrings of 4 to 7 characters) are weighed by a
logistic regression on how often they occur and how much of the text they make up. Labels of the documents that
``held_out`` picks are never learnt from; only the text goes into a score.

Scale: the language model counts every document, in tasks; 28^4 sums reach the driver. The classifier is fitted on a
bounded sample: at most ``sample`` labelled documents of either class, by the hash of their id, weighted back to what
all labels say. Their ids, a table of proven size, are broadcast to find their texts. Pieces are counted by task into
a fixed number of hash buckets; those in the best buckets are counted again by themselves, and the ``pieces`` that tell the
classes apart best are kept. Scoring is
one pass without a shuffle; the model of some megabytes is a broadcast variable. Each task remembers at most
``KNOWN`` pieces of text.

Defined results: NULL text is empty; an empty text gets the score of a text without any kept piece. A document labelled
twice is toxic if one label says so; NULL labels and labels without a document are not used. A NULL id is not held out.
Where labels have one class only, or none, every score is the share of toxic labels (0 without labels). Repeated
documents are scored each and learnt from once. Added columns take a trailing underscore if the name is taken.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize_at, release, scratch_path
from . import char_model
from .words import spare

SAMPLE = 4_000
PIECES = 400
BUCKETS = 1 << 20
KNOWN = 400_000
SHORTEST, LONGEST = 4, 7
LONG_WORD = 64
RIDGE = 3.0

WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def pieces_of(word: str) -> set[str]:
    """The word with its edges marked, and its substrings; of very long words those of each stretch of 64."""
    whole = f"<{word}>"
    out = {whole}
    for at in range(0, len(whole), LONG_WORD):
        part = whole[max(at - LONGEST + 1, 0) : at + LONG_WORD]
        out.update(part[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(part) - n + 1))
    return out


def bucket(piece: str) -> int:
    return xxhash.xxh64_intdigest(piece) % BUCKETS


class Reader:
    """Counts of a text's pieces; remembers what it has decoded and cut.

    Places are buckets of the pieces' hashes, or the indexes of ``pieces`` where these are given.
    """

    def __init__(self, chances: np.ndarray, pieces: tuple[str, ...] | None = None):
        self.chances = chances
        self.search = None
        if pieces is not None:
            self.search = ahocorasick.Automaton()
            for place, piece in enumerate(pieces):
                self.search.add_word(piece, place)
            if pieces:
                self.search.make_automaton()
        self.known: dict[str, tuple[int, tuple[int, ...]]] = {}

    def _cut(self, token: str) -> tuple[int, tuple[int, ...]]:
        """(number of words, places of their pieces) of a token, a piece once a word."""
        words = WORD.findall(char_model.restored(token, self.chances))
        found: list[int] = []
        for word in words:
            if self.search is None:
                found += {bucket(p) for p in pieces_of(word)}
            elif len(self.search):
                found += {place for _, place in self.search.iter(f"<{word}>")}
        return len(words), tuple(found)

    def cut(self, token: str) -> tuple[int, tuple[int, ...]]:
        known = self.known.get(token)
        if known is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            known = self._cut(token)
            if len(token) <= LONG_WORD:
                self.known[token] = known
        return known

    def tokens(self, text: str) -> Counter:
        text = text.lower()
        if char_model.SPACED.search(text):
            text = char_model.SPACED.sub(lambda m: char_model.decode(re.sub(" +", " ", m.group()), self.chances), text)
        return Counter(text.split())

    def read(self, text: str) -> tuple[int, Counter]:
        """(number of words, times of each place)."""
        n, times = 0, Counter()
        for token, many in self.tokens(text).items():
            words, places = self.cut(token)
            n += words * many
            for place in places:
                times[place] += many
        return n, times


def values(n: int, places: np.ndarray, times: np.ndarray, pieces: int) -> np.ndarray:
    """A text's features: how often each kept piece occurs, and how much of the words it makes up."""
    out = np.zeros(2 * pieces)
    out[places] = np.log1p(times)
    out[pieces + places] = np.sqrt(100.0 * times / max(n, 1))
    return out


def chance(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


@dataclass(frozen=True)
class Model:
    """``chances`` of the language model, kept ``pieces`` and their weights; the last weight is the constant."""

    chances: np.ndarray
    pieces: tuple[str, ...]
    weights: np.ndarray

    def score(self, n: int, times: Counter) -> float:
        places = np.fromiter(times.keys(), np.int64, len(times))
        many = np.fromiter(times.values(), np.float64, len(times))
        z = values(n, places, many, len(self.pieces)) @ self.weights[:-1] + self.weights[-1]
        return float(chance(z))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    """Weights (the constant last, unpenalised) by Newton's method with halved steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum())

    w = np.zeros(x.shape[1])
    last = loss(w)
    for _ in range(steps):
        p = chance(x @ w)
        slope = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > last:
            size /= 2
        w = w - size * step
        now = loss(w)
        if last - now < 1e-6 * max(1.0, last):
            break
        last = now
    return w


def information(with_toxic: np.ndarray, with_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Bits that seeing a piece in a document tells about its class, both classes weighing the same."""

    def entropy(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return -(p * np.log2(p) + (1 - p) * np.log2(1 - p))

    a, b = with_toxic / toxic, with_clean / clean
    seen, unseen = a + b, 2 - a - b
    return 1 - 0.5 * (seen * entropy(a / np.maximum(seen, 1e-12)) + unseen * entropy((1 - a) / np.maximum(unseen, 1e-12)))


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, sample: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """(id, text, toxic) of the documents learnt from, and by class (all labels, sampled documents' labels)."""
    usable = labels.where(F.col(doc_id).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(doc_id)))
    marked = usable.groupBy(F.col(doc_id).alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64(F.lit("toxicity"), "id"), F.col("id")]
    picked = marked.where("toxic = 1").orderBy(*order).limit(sample).unionByName(marked.where("toxic = 0").orderBy(*order).limit(sample))
    # At most ``sample`` ids of either class: bounded whatever the tables.
    met = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    return met.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), total


def _best_pieces(learnt: DataFrame, lm: Broadcast, pieces: int, size: dict[int, int]) -> tuple[str, ...]:
    """The pieces that tell the classes apart best, those seen in fewer than three documents left out.

    All pieces are counted by bucket first, then those of the best buckets one by one.
    """

    def best(rows: pa.Table, name: str, many: int) -> list:
        clean, toxic = (rows[c].to_numpy().astype(np.int64) for c in ("clean", "toxic"))
        told = information(toxic, clean, size[1], size[0]).round(12)
        order = sorted(zip((-told).tolist(), rows[name].to_pylist()))
        return [x for _, x in order[:many]]

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm.value)
        seen = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                _, times = reader.read(text.as_py())
                seen[toxic, np.fromiter(times.keys(), np.int64, len(times))] += 1
        some = np.flatnonzero(seen.any(axis=0))
        columns = [pa.array(some), pa.array(seen[0, some], pa.int64()), pa.array(seen[1, some], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "clean", "toxic"])

    def counts(found: DataFrame, name: str) -> pa.Table:
        sums = found.groupBy(name).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        return sums.where("clean + toxic >= 3").toArrow()

    texts = learnt.select("text", "toxic")
    buckets = frozenset(best(counts(texts.mapInArrow(by_bucket, "bucket bigint, clean bigint, toxic bigint"), "bucket"), "bucket", 2 * pieces))

    def by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm.value)
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                found = set()
                for token in reader.tokens(text.as_py()):
                    if not buckets.isdisjoint(reader.cut(token)[1]):
                        for word in WORD.findall(char_model.restored(token, lm.value)):
                            found.update(p for p in pieces_of(word) if bucket(p) in buckets)
                seen[toxic].update(found)
        names = [*(seen[0].keys() | seen[1].keys())]
        columns = [pa.array(names, pa.string()), *[pa.array([c[n] for n in names], pa.int64()) for c in seen]]
        yield pa.RecordBatch.from_arrays(columns, names=["piece", "clean", "toxic"])

    found = counts(texts.mapInArrow(by_piece, "piece string, clean bigint, toxic bigint"), "piece")
    return tuple(best(found, "piece", pieces))


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, pieces: int = PIECES
) -> Model:
    """The language model of all documents, and the classifier of a bounded sample of the labelled ones."""
    spark = docs.sparkSession
    chances = char_model.log_chances(char_model.sequence_counts(F.col(text), docs))
    path = scratch_path(spark, "toxicity-sample")
    found, total = _sample(docs, labels, doc_id, text, sample)
    learnt = materialize_at(found, path)
    size = {r["toxic"]: r["n"] for r in learnt.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        share = total.get(1, 0) / max(sum(total.values()), 1)
        release(spark, path)
        constant = np.log(share / (1 - share)) if 0 < share < 1 else np.inf if share else -np.inf
        return Model(chances, (), np.array([constant]))
    lm = spark.sparkContext.broadcast(chances)
    kept = _best_pieces(learnt, lm, pieces, size)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm.value, kept)
        for batch in batches:
            texts = [reader.read(t.as_py()) for t in batch.column(1)]
            columns = [
                batch.column(0), batch.column(2), pa.array([n for n, _ in texts], pa.int64()),
                pa.array([list(t.keys()) for _, t in texts], pa.list_(pa.int64())),
                pa.array([list(t.values()) for _, t in texts], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "toxic", "n", "places", "times"])

    kind = learnt.schema["id"].dataType.simpleString()
    # At most ``sample`` rows of a class with ``pieces`` numbers.
    rows = learnt.select("id", "text", "toxic").mapInArrow(read, f"id {kind}, toxic int, n bigint, places array<bigint>, times array<bigint>")
    held = sorted(rows.collect(), key=lambda r: (r["toxic"], str(r["id"])))
    x = np.stack([values(r["n"], np.array(r["places"], np.int64), np.array(r["times"], np.float64), len(kept)) for r in held])
    y = np.array([r["toxic"] for r in held], np.float64)
    weight = np.array([total[r["toxic"]] / size[r["toxic"]] for r in held])
    weights = logistic(x, y, weight * len(held) / weight.sum())
    release(spark, path)
    return Model(chances, kept, weights)


def score(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, restore: bool = False
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; without its text unless ``keep_text``.

    With ``restore`` also the lower-cased text with its disguises undone, as ``restored``.
    """
    spark = docs.sparkSession
    n_held, n_score, n_predicted, n_restored = spare(docs, "held_out", "score", "predicted", "restored")
    rest = [f for f in docs.schema.fields if keep_text or f.name != text]
    added = [T.StructField(n_score, T.DoubleType())] + ([T.StructField(n_restored, T.StringType())] if restore else [])
    sent = spark.sparkContext.broadcast(model)
    (n_text,) = spare(docs, "_text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        reader = Reader(held.chances, held.pieces)
        known: dict[str, str] = {}
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            columns = [*batch.columns[:-1], pa.array([held.score(*reader.read(t.as_py())) for t in texts], pa.float64())]
            if restore:
                if len(known) > KNOWN:
                    known.clear()
                columns.append(pa.array([char_model.restored_text(t.as_py().lower(), held.chances, known) for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in [*rest, *added]])

    whole = F.coalesce(F.col(text), F.lit("")).alias(n_text)
    found = docs.select(*[F.col(f.name) for f in rest], whole).mapInArrow(scored, T.StructType([*rest, *added]))
    return found.withColumns(
        {n_held: held_out(F.col(doc_id)), n_predicted: (F.col(n_score) >= 0.5).cast("int")}
    )
