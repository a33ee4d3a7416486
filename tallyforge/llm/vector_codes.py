"""Vectors as short codes: a codebook for each part of the vector, found by Lloyd rounds in whole numbers.

Components become ``floor(scale * x)``, vectors are cut into ``parts`` equal consecutive parts, and each part position
has a codebook of up to ``entries`` entries. It starts as that part of the vectors of smallest id; each round assigns
every part to the nearest entry (squared Euclidean distance, ties to the lower index) and replaces each used entry by
its parts' componentwise ``floor(sum / count)``. All arithmetic is on integers, so no order of tasks changes a result.

The nearest entry is found by equal-average search. Entries are sorted by the sum of their components. A part begins
at its own sum and looks outward on both sides, the smaller sum gap first; a gap whose square over the dimension is
strictly greater than the best distance so far rules out every entry beyond it (Cauchy-Schwarz), and ends that side.
An entry at exactly that bound is still looked at, as it could tie with a lower index. All parts of a batch take their
steps together in numpy.

Scale: the whole numbers are written once, each round is one pass over them. A task returns at most a row of sums for
each part and entry, which combine before a shuffle of a few hundred rows; the codebooks, of bounded size, go to the
driver and out with the next round's tasks.

Defined results: a row is kept if its vector has no NULL and no non-finite component, has a length that ``parts``
divides, and is as long as the first such vector by id (NULL ids last; equal ids in order of their components).
Repeated rows count each. Fewer vectors than ``entries`` make smaller codebooks; no vector, no codebooks and no rows.
Whole numbers saturate at ``2 ** bound_bits(width, length)`` (components beyond 32,768 in vectors of 64, eight
parts, at a scale of 4096), which keeps every distance within 64 bits. All columns of the input but the vector stay;
``codes`` and ``error`` take a trailing underscore if the name is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize_at, release, scratch_path
from .words import spare

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def bound_bits(width: int, length: int) -> int:
    """Bits of the largest whole number for which a part's squared sum and a vector's distance fit into 64 bits."""
    return min(30 - (width - 1).bit_length(), (63 - (length - 1).bit_length()) // 2 - 1)


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry]`` is a vector of ``width`` whole numbers."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[2]


def nearest(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each row of ``values``, ties to the lower index."""
    n, width = values.shape
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    ranked = sums[order]
    own = values.sum(axis=1)
    right = np.searchsorted(ranked, own)
    left = right - 1
    index = np.full(n, len(entries), np.int64)
    best = np.full(n, np.iinfo(np.int64).max, np.int64)
    far = np.iinfo(np.int64).max
    active = np.arange(n)
    while len(active):
        lo, hi, mine = left[active], right[active], own[active]
        gap_lo = np.where(lo >= 0, mine - ranked[np.maximum(lo, 0)], far)
        gap_hi = np.where(hi < len(ranked), ranked[np.minimum(hi, len(ranked) - 1)] - mine, far)
        down = gap_lo <= gap_hi
        gap = np.where(down, gap_lo, gap_hi)
        # The other side's gap is no smaller, so a gap past the bound ends both sides.
        found = gap != far
        met = best[active] != far
        square = np.where(found, gap, 0) ** 2
        beyond = met & (square > width * np.where(met, best[active], 0))
        go = found & ~beyond
        active, down, lo, hi = active[go], down[go], lo[go], hi[go]
        if not len(active):
            break
        entry = order[np.where(down, lo, hi)]
        distance = ((values[active] - entries[entry]) ** 2).sum(axis=1)
        better = (distance < best[active]) | ((distance == best[active]) & (entry < index[active]))
        best[active[better]] = distance[better]
        index[active[better]] = entry[better]
        left[active[down]] -= 1
        right[active[~down]] += 1
    return index, best


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Rows of whole numbers as an array [row, part, component]."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def whole_numbers(vector: Column, scale: int, top: int) -> Column:
    """``floor(scale * x)`` within ``top``; the first bound is applied before there are integers, which 1e300 is not."""

    def whole(x: Column) -> Column:
        tame = F.greatest(F.least(x.cast("double"), F.lit(2.0**31)), F.lit(-(2.0**31)))
        return F.greatest(F.least(F.floor(tame * scale), F.lit(top)), F.lit(-top)).cast("int")

    return F.transform(vector, whole)


def _usable(vector: Column, parts: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & ~bad


def kept_vectors(df: DataFrame, vec_id: str, vector: str, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """The rows that are kept, with whole numbers for the vector, and the vectors' length (0 without any)."""
    usable = df.where(_usable(F.col(vector), parts))
    first = usable.select(F.size(vector).alias("length"), vec_id, vector)
    found = first.orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(1).select("length").collect()
    if not found:
        return df.limit(0).withColumn(vector, F.lit(None).cast("array<int>")), 0
    length = found[0]["length"]
    top = 1 << bound_bits(length // parts, length)
    return usable.where(F.size(vector) == length).withColumn(vector, whole_numbers(F.col(vector), scale, top)), length


def fit(whole: DataFrame, length: int, vec_id: str, vector: str, parts: int, entries: int, rounds: int) -> Codebooks:
    """Codebooks of ``rounds`` Lloyd rounds over all rows of ``whole``, integers as :func:`kept_vectors` makes them."""
    width = length // parts
    seeds = whole.select(vec_id, vector).orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries)
    start = np.array([row[vector] for row in seeds.collect()], np.int64).reshape(-1, parts, width)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    for _ in range(rounds):
        books = Codebooks(_next(whole, vector, books))
    return books


def _next(whole: DataFrame, vector: str, books: Codebooks) -> np.ndarray:
    parts, size, width = books.entries.shape
    names = [f"s{i}" for i in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, size, width), np.int64)
        count = np.zeros((parts, size), np.int64)
        for batch in batches:
            values = _matrix(batch.column(0), parts)
            for p in range(parts):
                index, _ = nearest(values[:, p], books.entries[p])
                count[p] += np.bincount(index, minlength=size)
                np.add.at(total[p], index, values[:, p])
        part, entry = np.nonzero(count)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry])]
        columns += [pa.array(total[part, entry, i]) for i in range(width)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", *names])

    schema = "part int, entry int, n bigint, " + ", ".join(f"{c} bigint" for c in names)
    found = whole.select(vector).mapInArrow(sums, schema).groupBy("part", "entry")
    after = books.entries.copy()
    # At most a row for each part and entry; sums of many tasks may pass 64 bits.
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]
    for row in found.agg(F.sum("n").alias("n"), *exact).collect():
        after[row["part"], row["entry"]] = [int(row[c]) // row["n"] for c in names]
    return after


def encode(whole: DataFrame, vector: str, books: Codebooks, codes: str = "codes", error: str = "error") -> DataFrame:
    """``whole`` without its vector, with the nearest entries' indexes and the squared distances summed over parts."""
    parts = books.entries.shape[0]
    rest = [f for f in whole.schema.fields if f.name != vector]
    schema = T.StructType([*rest, T.StructField(codes, T.ArrayType(T.IntegerType())), T.StructField(error, T.LongType())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column(batch.num_columns - 1), parts)
            found = [nearest(values[:, p], books.entries[p]) for p in range(parts)]
            index = np.stack([i for i, _ in found], axis=1).astype(np.int32)
            offsets = np.arange(0, index.size + 1, parts, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(index.ravel()))
            total = sum((d for _, d in found), np.zeros(len(batch), np.int64))
            columns = [*batch.columns[:-1], lists, pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return whole.select(*[F.col(f.name) for f in rest], vector).mapInArrow(encoded, schema)


def compress(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks | None]:
    """(kept rows with ``codes`` and ``error``, codebooks); rounds run as jobs when this is called.

    The coded rows are written, and the whole numbers that all rounds read are removed again.
    """
    spark = df.sparkSession
    codes, error = spare(df, "codes", "error")
    kept, length = kept_vectors(df, vec_id, vector, parts, scale)
    if not length:
        return kept.drop(vector).withColumn(codes, F.lit(None).cast("array<int>")).withColumn(error, F.lit(None).cast("bigint")), None
    path = scratch_path(spark, "whole-vectors")
    whole = materialize_at(kept, path)
    books = fit(whole, length, vec_id, vector, parts, entries, rounds)
    coded = materialize_at(encode(whole, vector, books, codes, error), scratch_path(spark, "coded-vectors"))
    release(spark, path)
    return coded, books


def decode(coded: DataFrame, books: Codebooks, codes: str = "codes", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``coded`` with the vector its codes stand for, as doubles."""
    table = F.lit([[[float(x) / scale for x in entry] for entry in part] for part in books.entries.tolist()])
    picked = F.transform(codes, lambda code, part: F.get(F.get(table, part), code))
    return coded.withColumn(vector, F.flatten(picked))
