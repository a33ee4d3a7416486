"""Token counts of documents in flat token files by scanning for the end-of-document identifier.

A flat file is a run of little-endian 16-bit ids: every document's ids and the end id, with no index. Files are cut
into blocks of bytes; each task searches its blocks with one vectorised comparison and keeps the places of the end
ids. Where a document began before its block, a prefix scan over the blocks' last places gives its start, and a
prefix sum over their numbers of end ids gives its ordinal in the file.

Scale: blocks are read side by side, whatever a file's size; what the scan joins is one row per block and file. A
document longer than a block is only a gap between two places. Places are written once, and blocks are joined back
on (file, block), which no hot key can own.

Defined results: a document without ids counts 0; ids after the last end id are an unfinished document and no row;
empty files and an empty table give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize, scratch_path
from .encode import worker_encoder

BLOCK_BYTES = 8 << 20
ID = np.dtype("<u2")


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode documents into flat files, one a partition; rows (file, place, key) name the documents in their order.

    Texts that hold a special token's string are encoded as ordinary text, so that the end id stands at ends only.
    A file carries its attempt's own name; files of failed attempts are in no row.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "flat")
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    chosen = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer, special=False)
        end = np.array([end_id], ID).tobytes()
        store, at = fs.FileSystem.from_uri(folder)
        file, out, place = "", None, 0
        for batch in batches:
            if batch.num_rows and out is None:
                file = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
                out = store.open_output_stream(f"{at}/{file}", compression=None)
            for text in batch.column(1):
                ids = np.frombuffer(encoder.ids(text.as_py() or ""), "<u4")
                if len(ids) and (ids.max() > 0xFFFF or (ids == end_id).any()):
                    raise ValueError("a document's ids exceed 16 bits or hold the end id")
                out.write(ids.astype(ID).tobytes())
                out.write(end)
            places = pa.array(range(place, place + batch.num_rows), pa.int64())
            place += batch.num_rows
            files = pa.array([f"{folder}/{file}"] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([files, places, batch.column(0)], ["file", "place", "key"])
        if out:
            out.close()

    return materialize(chosen.mapInArrow(write_part, "file string, place bigint, key bigint"), "flat-names")


def file_blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, start, length) of all blocks; sizes are asked by tasks, not by the driver."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            found = []
            for path in paths:
                store, at = fs.FileSystem.from_uri(path)
                found.append(store.get_file_info(at).size)
            yield pa.RecordBatch.from_pydict({"file": paths, "size": found})

    step = block_bytes - block_bytes % ID.itemsize
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(step).cast("bigint"))).alias("start")
    sized = files.select("file").mapInArrow(sizes, "file string, size bigint").where(F.col("size") > 0)
    cut = sized.select("file", "size", starts)
    return cut.select("file", (F.col("start") / step).cast("bigint").alias("block"), "start", F.least(F.lit(step), F.col("size") - F.col("start")).alias("length"))


def end_places(blocks: DataFrame, end_id: int, slices: int) -> DataFrame:
    """(file, block, at): the places of end ids in each block, counted from the file's first id."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = fs.FileSystem.from_uri(file)
                with store.open_input_file(at) as source:
                    source.seek(start)
                    ids = np.frombuffer(source.read(length), ID)
                places = np.flatnonzero(ids == end_id) + start // ID.itemsize
                yield pa.RecordBatch.from_pydict(
                    {"file": [file], "block": [block], "at": pa.array([places], pa.list_(pa.int64()))}
                )

    spread = blocks.repartition(slices, "file", "block")
    return spread.mapInArrow(search, "file string, block bigint, at array<bigint>")


def count(files: DataFrame, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, place, n_tokens) of each document in the distinct flat ``files``, without its end id."""
    spark = files.sparkSession
    blocks = materialize(file_blocks(files, block_bytes), "flat-blocks")
    slices = max(1, min(blocks.count(), 10 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = materialize(end_places(blocks, end_id, slices), "flat-ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "block", F.size("at").alias("n"), F.array_max("at").alias("last"))
    carried = materialize(
        summary.select(
            F.col("file").alias("_file"),
            F.col("block").alias("_block"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("first"),
            F.coalesce(F.max("last").over(before), F.lit(-1)).cast("bigint").alias("start"),
        ),
        "flat-carried",
    )
    joined = found.join(carried, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    ends = F.concat(F.array("start"), F.col("at"))
    gaps = F.transform(F.col("at"), lambda x, i: F.struct(i.cast("bigint").alias("i"), (x - F.get(F.col("ends"), i) - 1).alias("n")))
    each = joined.select("file", "first", "at", ends.alias("ends")).select("file", "first", F.explode(gaps).alias("gap"))
    return each.select("file", (F.col("first") + F.col("gap")["i"]).alias("place"), F.col("gap")["n"].alias("n_tokens"))


def count_documents(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of all documents, by way of flat files."""
    names = write_flat(docs, tokenizer, end_id, key, text)
    counted = count(names.select("file").distinct(), end_id)
    same = (F.col("file") == F.col("_file")) & (F.col("place") == F.col("_place"))
    named = names.select(F.col("file").alias("_file"), F.col("place").alias("_place"), F.col("key").alias(key))
    return counted.join(named, same).select(key, "n_tokens")
