"""Repeated byte strings of a corpus by bucket-pointer refinement of sampled suffixes.

Every byte covered by a ``LENGTH``-byte string that also starts somewhere else is removed. Suffixes are bucketed by
their first ``Q`` bytes. Of all suffixes, those are kept that open the smallest bucket among the starts inside some
``LENGTH``-byte string (the leftmost on a tie); equal strings keep the same place, so no repeat is missed. A kept
suffix stands for the run of strings that chose it. Buckets are then refined by the identifiers of later offsets:
``id(128) = (id(64) here, id(64) 64 bytes on)``, ``id(200) = (id(128) here, id(128) 72 bytes on)``, and a run's by the
``id(200)`` of its first and last string, each step reusing what the one before has made. A bucket of one drops out;
equal runs are repeats as a whole; what still shares a bucket after that differs somewhere near, and is refined down
to single strings.

Identifiers are 64-bit fingerprints of the bytes, compared only inside a bucket of another 64 bits; no documents are
ordered by the driver, and identifiers need no rounds of renaming. Texts are known by a 64-bit hash.

Scale: a text is cut into pieces with an overlap, so that memory does not grow with it. About 1.5 suffixes per 100
bytes are shuffled by bucket, equal ones of a batch of texts as one; buckets stream by in sorted order, so that a hot
one needs no memory. Copies of a text
are worked on once a task, and their rows meet the result by a plain join on the text's hash, which adaptive
execution can split. Runs of one bucket that differ travel with the bytes around them; buckets with more than
``HOT_RUNS`` such runs are counted string by string, pre-aggregated. The text is shuffled once, for both later passes.

Defined results: NULL text is empty; texts shorter than ``LENGTH`` bytes keep everything; rows that repeat are copies
of each other; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

LENGTH, Q = 200, 64
STARTS = LENGTH - Q + 1
PIECE = 2 << 20
HOT_RUNS = 20_000

_U = np.uint64
_PLACE = 24
_BASE = _U(0x9E3779B97F4A7C15)
_LETTER = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=_U)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & ((1 << 64) - 1), _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Prints:
    """Fingerprints of all ``Q``-grams of a run of bytes, and of longer strings made of them."""

    _up = _down = np.empty(0, _U)

    def __init__(self, data: np.ndarray):
        if len(data) + 1 > len(Prints._up):
            n = max(len(data) + 1, PIECE + LENGTH + 1)
            Prints._up, Prints._down = _powers(int(_BASE), n), _powers(pow(int(_BASE), -1, 1 << 64), n)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_LETTER[data] * Prints._up[: len(data)], out=sums[1:])
        self.first = self._mix((sums[Q:] - sums[:-Q]) * Prints._down[: len(sums) - Q])

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(32))

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._mix(self._mix(a) * _U(0xA0761D6478BD642F) + b)

    def double(self, at: np.ndarray) -> np.ndarray:
        return self._pair(self.first[at], self.first[at + Q])

    def whole(self, at: np.ndarray) -> np.ndarray:
        return self._pair(self.double(at), self.double(at + (LENGTH - 2 * Q)))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by running minima over blocks from both sides."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, ~_U(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bucket, refined, suffix, first, last): the runs of starts of valid strings that chose one suffix."""
    prints = Prints(data)
    place = np.arange(len(prints.first), dtype=_U)
    chosen = _sliding_min((prints.first >> _U(_PLACE) << _U(_PLACE)) | place, STARTS) & _U((1 << _PLACE) - 1)
    starts = np.flatnonzero(valid)
    picked = chosen[starts].astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (starts[1:] != starts[:-1] + 1)
    opens = np.flatnonzero(new)
    first, suffix = starts[opens], picked[opens]
    last = starts[np.append(opens[1:], len(starts)) - 1]
    shape = ((suffix - first) << 8 | (suffix - last)).astype(_U)
    refined = prints._pair(prints._pair(prints.whole(first), prints.whole(last)), shape)
    return prints.first[suffix], refined, suffix, first, last


def pieces(keys: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of bytes with, for each start of a string in them, whether it is inside one text; (data, valid, key, base).

    Short texts are laid side by side, long ones cut with an overlap; every string of a text is valid in one piece.
    """
    held, size = [], 0
    for key, text in zip(keys, texts):
        if len(text) < LENGTH:
            continue
        for cut in range(0, len(text) - LENGTH + 1, PIECE):
            part = text[cut : cut + PIECE + LENGTH - 1]
            if size and size + len(part) > PIECE + LENGTH:
                yield _laid(held)
                held, size = [], 0
            held.append((key, cut, part))
            size += len(part)
    if held:
        yield _laid(held)


def _laid(held: list[tuple[int, int, bytes]]):
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    lengths = np.array([len(p) for _, _, p in held])
    ends = np.cumsum(lengths)
    valid = np.ones(len(data), bool)
    for end in ends.tolist():
        valid[max(0, end - LENGTH + 1) : end] = False
    owner = np.repeat(np.arange(len(held)), lengths)
    keys = np.array([k for k, _, _ in held], np.int64)
    bases = np.array([c for _, c, _ in held], np.int64) - (ends - lengths)
    return data, valid[: len(data) - LENGTH + 1], keys[owner], bases[owner]


OPEN, ALIKE, UNLIKE = 0, 1, 2


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, bucket, refined, key, run) of each run, a text once a task.

    Runs of one batch that are equal are repeats already: they go out as ``ALIKE``, under a number of their own instead
    of their bucket, and one of them goes to the bucket. A frequent passage thus sends a row a batch, not one a text.
    """
    seen: set[int] = set()
    names = ["kind", "bucket", "refined", "key", "run"]
    for batch in batches:
        keys, texts = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if key not in seen:
                seen.add(key)
                keys.append(key)
                texts.append((text.as_py() or "").encode())
        found = []
        for data, valid, key, base in pieces(keys, texts):
            bucket, refined, suffix, first, last = runs(data, valid)
            packed = (base[first] + first) << 16 | (last - first) << 8 | (suffix - first)
            found.append((bucket, refined, key[first], packed))
        if found:
            bucket, refined, key, run = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((refined, bucket))
            same = (bucket[order][1:] == bucket[order][:-1]) & (refined[order][1:] == refined[order][:-1])
            later, alike = np.zeros(len(order), bool), np.zeros(len(order), bool)
            later[order[1:][same]] = True
            alike[order[1:][same]] = True
            alike[order[:-1][same]] = True
            own = Prints._mix(key.view(_U) + run.astype(_U))
            parts = [(OPEN, bucket, ~later), (ALIKE, own, alike)]
            columns = [
                np.concatenate([np.full(m.sum(), k, np.int32) for k, _, m in parts]),
                np.concatenate([c[m] for _, c, m in parts]).view(np.int64),
                *(np.concatenate([c[m] for _, _, m in parts]) for c in (refined.view(np.int64), key, run)),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (bucket, refined, key, run): those that share both (``ALIKE``), and for each bucket with
    several refined ones the first row of each (``UNLIKE``). Rows that are ``ALIKE`` already pass through.

    Two rows are held from batch to batch: the last one, which may equal the next, and the one that opened the
    bucket, which counts once another refined one follows.
    """
    names = ["kind", "bucket", "key", "run"]
    last: tuple[int, ...] | None = None
    last_equals = False
    opener: tuple[int, ...] | None = None
    for batch in batches:
        kind, *cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        done = kind == ALIKE
        if done.any():
            passed = [kind[done], cols[0][done], cols[2][done], cols[3][done]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in passed], names)
            cols = [c[~done] for c in cols]
        if not len(cols[0]):
            continue
        # A text met by several tasks gives equal rows, of which one counts.
        fresh = np.ones(len(cols[0]), bool)
        fresh[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        fresh[0] = last is None or any(c[0] != x for c, x in zip(cols, last))
        bucket, refined, key, run = cols = [c[fresh] for c in cols]
        n = len(bucket)
        if not n:
            continue
        in_bucket, equal = np.zeros(n, bool), np.zeros(n, bool)
        in_bucket[1:] = bucket[1:] == bucket[:-1]
        equal[1:] = in_bucket[1:] & (refined[1:] == refined[:-1])
        in_bucket[0] = last is not None and last[0] == bucket[0]
        equal[0] = in_bucket[0] and last[1] == refined[0]
        rows = []

        def tell(kind: int, *values) -> None:
            rows.append([np.full(len(values[0]), kind, np.int32), *values])

        if last is not None and (last_equals or equal[0]):
            tell(ALIKE, *(np.array([last[i]]) for i in (0, 2, 3)))
        alike = equal[:-1] | equal[1:]
        tell(ALIKE, *(c[:-1][alike] for c in (bucket, key, run)))
        kinds = np.flatnonzero(~equal)
        if len(kinds):
            if opener is not None and in_bucket[kinds[0]]:
                tell(UNLIKE, *(np.array([x]) for x in opener))
            unlike = in_bucket[kinds].copy()
            unlike[:-1] |= in_bucket[kinds[1:]]
            chosen = kinds[unlike]
            tell(UNLIKE, bucket[chosen], key[chosen], run[chosen])
            i = kinds[-1]
            opener = None if in_bucket[i] else (bucket[i], key[i], run[i])
        last, last_equals = tuple(c[-1] for c in cols), bool(equal[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names)
    if last is not None and last_equals:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((ALIKE, last[0], last[2], last[3]), (pa.int32(), *[pa.int64()] * 3))], names)


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, key, start, bytes): the bytes that the strings of each unlike run cover."""
    seen: set[int] = set()
    for batch in batches:
        rows: dict[str, list] = {"bucket": [], "key": [], "start": [], "bytes": []}
        for key, text, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            if key in seen:
                continue
            seen.add(key)
            data = (text.as_py() or "").encode()
            for mark in marks:
                start, more = mark["run"] >> 16, mark["run"] >> 8 & 255
                for column, value in zip(rows.values(), (mark["bucket"], key, start, data[start : start + more + LENGTH])):
                    column.append(value)
        schema = pa.schema([("bucket", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])
        yield pa.RecordBatch.from_pydict(rows, schema)


def _strings(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, fingerprint) of every string of the given runs of bytes."""
    joined = np.frombuffer(b"".join(data), np.uint8)
    lengths = np.array([len(x) for x in data])
    counts = lengths - LENGTH + 1
    row = np.repeat(np.arange(len(data)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offset + np.repeat(np.cumsum(lengths) - lengths, counts)
    return row, offset, Prints(joined).whole(at)


def _spans(key: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Neighbouring starts of repeated strings, sorted, as (key, start, end)."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1)
    opens = np.flatnonzero(new)
    ends = start[np.append(opens[1:], len(start)) - 1] + LENGTH if len(start) else start
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (key[opens], start[opens], ends)], ["key", "start", "end"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated strings among the unlike runs of each bucket; rows come sorted by bucket, whole buckets at a time."""
    held: list[tuple[int, int, int, bytes]] = []

    def decide(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        bucket, key, start, data = zip(*rows)
        row, offset, prints = _strings(data)
        of = np.array(bucket, np.int64)[row]
        order = np.lexsort((prints, of))
        same = (prints[order][1:] == prints[order][:-1]) & (of[order][1:] == of[order][:-1])
        again = np.zeros(len(order), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        return _spans(np.array(key, np.int64)[row[again]], np.array(start, np.int64)[row[again]] + offset[again])

    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        if len(held) > 4000:
            ends = next((i for i in range(len(held) - 1, 0, -1) if held[i][0] != held[i - 1][0]), 0)
            if ends:
                yield decide(held[:ends])
                held = held[ends:]
    if held:
        yield decide(held)


def _single_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, string, key, start) of every string of hot buckets' runs."""
    for batch in batches:
        if batch.num_rows:
            bucket, key, start, data = (c.to_pylist() for c in batch.columns)
            row, offset, prints = _strings(data)
            columns = np.array(bucket)[row], prints.view(np.int64), np.array(key)[row], np.array(start)[row] + offset
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "string", "key", "start"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each text from its repeated spans."""
    for batch in batches:
        rows: dict[str, list] = {"key": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = (text.as_py() or "").encode()
            left, removed, found, at = hashlib.sha256(), 0, 0, 0
            for start, end in joined_spans(spans or []):
                left.update(data[at:start])
                removed += end - start
                found += 1
                at = end
            left.update(data[at:])
            for column, value in zip(rows.values(), (key, len(data), removed, found, left.hexdigest())):
                column.append(value)
        yield pa.RecordBatch.from_pydict(rows)


def joined_spans(spans: list[dict]) -> Iterator[tuple[int, int]]:
    """Overlapping or touching spans as one, in order."""
    start = end = -1
    for span in sorted(spans, key=lambda s: s["start"]):
        if span["start"] > end:
            if end >= 0:
                yield start, end
            start, end = span["start"], span["end"]
        else:
            end = max(end, span["end"])
    if end >= 0:
        yield start, end


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        keep = []
        for key in batch.column(0).to_pylist():
            keep.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(keep, pa.bool_()))


def repeated_spans(texts: DataFrame, hot_runs: int = HOT_RUNS) -> tuple[DataFrame, DataFrame]:
    """Of (key, text): each text once with its key as the hash partition, and (key, start, end) of repeated strings."""
    once = texts.mapInArrow(_first_of_task, "key bigint, text string").repartition("key")
    order = ["bucket", "refined", "key", "run"]
    suffixes = texts.mapInArrow(_suffixes, "kind int, bucket bigint, refined bigint, key bigint, run bigint")
    marked = materialize(
        suffixes.repartition("bucket").sortWithinPartitions(*order).mapInArrow(_refined, "kind int, bucket bigint, key bigint, run bigint"),
        "suffixes",
    )
    unlike = marked.where(F.col("kind") == UNLIKE)
    hot = materialize(unlike.groupBy("bucket").count().where(F.col("count") > hot_runs).select("bucket"), "hot-buckets")
    marks = unlike.groupBy("key").agg(F.collect_list(F.struct("bucket", "run")).alias("marks"))
    around = once.join(marks.hint("shuffle_hash"), "key").select("key", "text", "marks")
    shape = "bucket bigint, key bigint, start bigint, bytes binary"
    surroundings = around.mapInArrow(_surroundings, shape)
    few, many = surroundings, None
    if hot.count():
        surroundings = materialize(surroundings, "surroundings")
        few = surroundings.join(hot, "bucket", "left_anti").select("bucket", "key", "start", "bytes")
        many = surroundings.join(hot, "bucket", "left_semi").select("bucket", "key", "start", "bytes")
    found = few.repartition("bucket").sortWithinPartitions("bucket", "key", "start").mapInArrow(_compared, "key bigint, start bigint, end bigint")
    if many is not None:
        strings = materialize(many.mapInArrow(_single_strings, "bucket bigint, string bigint, key bigint, start bigint"), "strings")
        again = materialize(strings.groupBy("bucket", "string").count().where("count > 1").drop("count"), "strings-again")
        repeated = strings.join(again, ["bucket", "string"])
        found = found.unionByName(repeated.select("key", "start", (F.col("start") + LENGTH).alias("end")))
    start = F.shiftright("run", 16)
    alike = marked.where(F.col("kind") == ALIKE).select(
        "key", start.alias("start"), (start + F.shiftright("run", 8).bitwiseAND(F.lit(255)) + LENGTH).alias("end")
    )
    return once, alike.unionByName(found)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.xxhash64(whole).alias("key"), whole.alias("text"))
    once, spans = repeated_spans(texts, hot_runs)
    gathered = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    cut = once.join(gathered.hint("shuffle_hash"), "key", "left").select("key", "text", "spans")
    results = materialize(
        cut.mapInArrow(_cut, "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").dropDuplicates(["key"]),
        "cut-texts",
    )
    named = docs.select(F.col(key).alias(key), F.xxhash64(whole).alias("_key"))
    copies = named.groupBy("_key").count().where("count > 1").select(F.col("_key").alias("_copied"))
    told = materialize(results.join(copies, F.col("key") == F.col("_copied"), "left"), "cut-results")
    gone = F.col("_copied").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return named.join(told, F.col("_key") == F.col("key")).select(
        F.col(key),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1).cast("bigint")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
