"""Token-ID files: independent zstandard frames, a document index, and a trailing seek table with checksums.

A file holds the little-endian unsigned 32-bit ids of whole documents. Frames end where documents end and hold up to
``FRAME_TOKENS`` ids, more only for a longer document. After the frames come two skippable frames, so that any
zstandard tool reads the ids alone: the index (for each document its key, whether it has one, its number of ids and
its frame) and the seek table of the public seekable format (compressed size, decompressed size and checksum of each
frame). A reader fetches the tail, then only the frames that it needs.

Scale: documents are range-partitioned by key, one file a partition, each written by one task as its rows stream by.
A file's name holds its task attempt's own id, and only files in the returned manifest count, so that a task that is
run again leaves nothing wrong behind. Files lie below the shared folder, through any file system that Arrow knows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize, scratch_path
from .encode import worker_encoder

FRAME_TOKENS = 65536
# Fixed values of the public zstandard seekable format, and the skippable frame next to it for the index.
SKIPPABLE_SEEK = 0x184D2A5E
SKIPPABLE_INDEX = 0x184D2A5D
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class Writer:
    """Streams documents into one file."""

    def __init__(self, out):
        self.out = out
        self.pending: list[bytes] = []
        self.waiting = 0
        self.frames: list[tuple[int, int, int]] = []
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self.frame_of: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        if self.waiting and self.waiting + len(ids) > 4 * FRAME_TOKENS:
            self.flush()
        self.keys.append(key)
        self.lengths.append(len(ids) // 4)
        self.frame_of.append(len(self.frames))
        self.pending.append(ids)
        self.waiting += len(ids)

    def flush(self) -> None:
        if self.pending:
            data = b"".join(self.pending)
            packed = zstandard.ZstdCompressor(level=3).compress(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.pending, self.waiting = [], 0

    def close(self) -> None:
        self.flush()
        known = np.array([k is not None for k in self.keys], np.uint8)
        keys = np.array([k or 0 for k in self.keys], np.int64)
        index = keys.tobytes() + known.tobytes() + np.array(self.lengths, "<u8").tobytes() + np.array(self.frame_of, "<u4").tobytes()
        index = zstandard.ZstdCompressor(level=3).compress(index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index) + 8) + struct.pack("<Q", len(self.keys)) + index)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class Reader:
    """Reads single documents, or all, checking each frame that it decompresses."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        frames, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        table = size - 9 - 12 * frames
        self.frames = np.frombuffer(self._at(table, 12 * frames), "<u4").reshape(-1, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        start = int(self.offsets[-1])
        tag, length = struct.unpack("<II", self._at(start, 8))
        if tag != SKIPPABLE_INDEX:
            raise ValueError("no document index behind the frames")
        body = self._at(start + 8, length)
        (n,) = struct.unpack("<Q", body[:8])
        index = zstandard.ZstdDecompressor().decompress(body[8:], max_output_size=max(1, 21 * n))
        self.keys = np.frombuffer(index, "<i8", n)
        self.known = np.frombuffer(index, np.uint8, n, 8 * n).astype(bool)
        self.lengths = np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64)
        self.frame_of = np.frombuffer(index, "<u4", n, 17 * n)

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        packed, size, check = (int(x) for x in self.frames[k])
        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), packed), max_output_size=size)
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} does not match its checksum")
        return data

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
        """(place in the file, key, ids) of the documents at the ``wanted`` places, or of all."""
        at, held, data = 0, -1, b""
        for place, (frame, length) in enumerate(zip(self.frame_of.tolist(), self.lengths.tolist())):
            if place == 0 or frame != self.frame_of[place - 1]:
                at = 0
            if wanted is None or place in wanted:
                if held != frame:
                    held, data = frame, self.frame(frame)
                key = int(self.keys[place]) if self.known[place] else None
                yield place, key, np.frombuffer(data, "<u4", length, 4 * at)
            at += length


def write(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write all documents in ascending key order; a manifest row (part, file, n_docs, n_tokens) per file.

    NULL keys come first, NULL text is empty text, and documents of one key lie next to each other.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    place, name = open_folder(folder)
    place.create_dir(name, recursive=True)
    ordered = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    by = [F.col("key").asc_nulls_first(), F.xxhash64("text")]

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        store, at = open_folder(folder)
        file, writer, n = "", None, 0
        for batch in batches:
            if batch.num_rows and writer is None:
                file = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
                writer = Writer(store.open_output_stream(f"{at}/{file}", compression=None))
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(t.as_py() or "") + end
                writer.add(k, ids)
                n += len(ids) // 4
        if writer:
            writer.close()
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "file": [f"{folder}/{file}"], "n_docs": [len(writer.keys)], "n_tokens": [n]}
            )

    ranged = ordered.repartitionByRange(*by).sortWithinPartitions(*by)
    schema = "part bigint, file string, n_docs bigint, n_tokens bigint"
    return materialize(ranged.mapInArrow(write_part, schema), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Each document of the files: doc_id, start (ids of all documents before it), n_tokens and ids_crc32.

    The offsets are running sums over the manifest, one row per file; files are read side by side.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("file", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).cast("bigint").alias("base"))

    def read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = open_folder(file)
                rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                with store.open_input_file(at) as source:
                    for _, key, ids in Reader(source).documents():
                        values = key, base, len(ids), zlib.crc32(ids.tobytes())
                        for column, value in zip(rows.values(), values):
                            column.append(value)
                        base += len(ids)
                        if len(rows["start"]) == 10_000:
                            yield pa.RecordBatch.from_pydict(rows, schema)
                            rows = {c: [] for c in rows}
                yield pa.RecordBatch.from_pydict(rows, schema)

    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
    files = max(1, manifest.count())
    spread = based.repartitionByRange(files, "base")
    return spread.mapInArrow(read_files, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
