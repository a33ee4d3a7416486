"""Records of documents that are no lines: JSON arrays and XML, read in splits.

A reader of whole documents gives a file to one task. Here the text source cuts the file at the string that every
record ends with (``}``, or the end tag), so that a file is read by as many tasks as it has splits. What such a
string means depends on all that went before: it may stand in quoted text, or close something inside a record.

So a first pass finds, for each split and each state it could begin in, the state it ends in and how much deeper; the
summaries, a row a split, are chained file by file; and a second pass, now knowing where each split begins, puts
pieces together to records. Records that cross splits are joined from their parts, at most two a split. A file
that doesn't end in the state it should is an error, and so is a second pass that meets other splits than the first.

Neither pass shuffles or writes the text; the rows of the splits' states are broadcast, of which the driver has
planned each split anyway.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tasks import travel_by_value

SPLIT = ["file", "block", "length"]
OUTSIDE = 0
COMPRESSED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst")


class JsonArrays:
    """Objects of JSON documents that are one array, or one object.

    States are outside (0) and inside (1) of quoted text. A piece never begins within an escape: the brace that ended
    the piece before would have ended that too.
    """

    end = "}"
    states = 2
    _escape = re.compile(r"\\.", re.S)
    _before = re.compile(r"[\s,\[﻿]*")
    _between = re.compile(r"[\s,\]]*")

    def step(self, piece: str, state: int) -> tuple[int, int]:
        """(state, change of depth) after a piece and the brace that ends it."""
        parts = (self._escape.sub("", piece) if "\\" in piece else piece).split('"')
        outside = "".join(parts[state::2]) if len(parts) > 1 else "" if state else parts[0]
        after = (state + len(parts) - 1) % 2
        return after, outside.count("{") + outside.count("[") - outside.count("]") - (after == OUTSIDE)

    def floor(self, first: str) -> int:
        """Depth between records, by the file's first piece."""
        start = first.lstrip(" \t\r\n﻿")[:1]
        if start not in ("[", "{", ""):
            raise ValueError("neither an array nor an object")
        return int(start == "[")

    def whole(self, text: str) -> Iterator[str]:
        record = text[self._before.match(text).end() :]
        if not record.startswith("{"):
            raise ValueError(f"not an object: {record[:60]!r}")
        yield record

    def rest(self, text: str) -> Iterator[str]:
        """Nothing may stand after the last record but the array's end."""
        if not self._between.fullmatch(text.lstrip("[\ufeff \t\r\n")):
            raise ValueError(f"not an object, or one without an end: {text.strip()[:60]!r}")
        return iter(())

    def complete(self, depth: int, floor: int, rest: bool) -> bool:
        """Whether a document may end at this depth; an array has its ``]`` in the rest, an empty one all of it."""
        return (depth == floor and rest >= floor) or (depth == 0 and rest)


class XmlRecords:
    """Elements of one tag that don't hold another of the same tag. States: markup (0), CDATA (1) and comments (2)."""

    states = 3
    _marks = re.compile(r"<!\[CDATA\[|\]\]>|<!--|-->")
    _opens = {"<![CDATA[": 1, "<!--": 2}
    _closes = {"]]>": 1, "-->": 2}

    def __init__(self, tag: str):
        self.tag, self.end = tag, f"</{tag}>"
        quoted = r"""(?:[^<>"'/]|"[^"]*"|'[^']*'|/(?!>))*"""
        self._loose = re.compile(rf"</{re.escape(tag)}\s+>")
        self._token = re.compile(rf"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<{re.escape(tag)}(?=[\s/>]){quoted}(/?)>", re.S)

    def step(self, piece: str, state: int) -> tuple[int, int]:
        for mark in self._marks.findall(piece):
            if state == OUTSIDE:
                state = self._opens.get(mark, OUTSIDE)
            elif self._closes.get(mark) == state:
                state = OUTSIDE
        return state, 0

    def floor(self, first: str) -> int:
        return 0

    def _elements(self, text: str) -> Iterator[str]:
        """Empty elements before the record, and the record, if one begins."""
        at = 0
        while found := self._token.search(text, at):
            if found.group(1) == "":
                yield text[found.start() :]
                return
            if found.group(1):
                yield found.group()
            at = found.end()
        return

    def whole(self, text: str) -> Iterator[str]:
        found = list(self._elements(text))
        if not found or not found[-1].endswith(self.end):
            raise ValueError(f"an end tag without its start: {text[-60:]!r}")
        if self._loose.search(found[-1]):
            raise ValueError(f"white space within an end tag: {found[-1][:60]!r}")
        return iter(found)

    def rest(self, text: str) -> Iterator[str]:
        for element in self._elements(text):
            if self._token.fullmatch(element) is None or not element.endswith("/>"):
                raise ValueError(f"an element without an end: {element[:60]!r}")
            yield element

    def complete(self, depth: int, floor: int, rest: bool) -> bool:
        return True


Format = JsonArrays | XmlRecords


def pieces(spark: SparkSession, paths: Sequence[str], end: str) -> DataFrame:
    """``file, block, length, value``: text up to each ``end``, in the order of the file within a split."""
    found = spark.read.option("lineSep", end).text(list(paths))
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in zip(("file_path", "file_block_start", "file_block_length"), SPLIT)]
    return found.select(*meta, F.col("_metadata.file_size").alias("size"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(values of all columns but the last, the last column's values) of each run of rows of one split."""

    def runs() -> Iterator[tuple[tuple, list[str]]]:
        for batch in batches:
            file, block = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
            for a, b in zip([0, *starts.tolist()], [*starts.tolist(), len(batch)]):
                if b > a:
                    yield tuple(c[a].as_py() for c in batch.columns[:-1]), batch.column(batch.num_columns - 1).slice(a, b - a).to_pylist()

    for key, group in groupby(runs(), key=lambda run: run[0]):
        yield key, (value for _, values in group for value in values)


def _last_apart(values: Iterator[str]) -> Iterator[tuple[str, bool]]:
    """Each value, and whether it is the last one."""
    held = next(values)
    for value in values:
        yield held, False
        held = value
    yield held, True


def split_states(found: DataFrame, kind: Format) -> DataFrame:
    """``file, block, length, state, depth, floor, rest``: how each split begins, from one pass over the pieces.

    ``rest``: the split's last piece is what follows the file's last record, and no end follows that piece.
    """
    names = [f"{n}{s}" for s in range(kind.states) for n in ("end", "depth", "end_less", "depth_less")]

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block, length, size), values in _by_split(batches):
            now, depth, n_bytes, floor = list(range(kind.states)), [0] * kind.states, 0, None
            less = None
            for value, last in _last_apart(values):
                if block == 0 and floor is None:
                    floor = kind.floor(value)
                n_bytes += len(kind.end) + (len(value) if value.isascii() else len(value.encode("utf-8", "replace")))
                if last:
                    less = now, depth
                steps = [kind.step(value, s) for s in range(kind.states)]
                depth = [d + steps[s][1] for d, s in zip(depth, now)]
                now = [steps[s][0] for s in now]
            states = [(now[s], depth[s], less[0][s], less[1][s]) for s in range(kind.states)]
            row = [file, block, length, size, n_bytes, floor, *[x for four in states for x in four]]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if k == 0 else pa.int64()) for k, x in enumerate(row)], names=columns)

    columns = [*SPLIT, "size", "bytes", "floor", *names]
    ddl = "file string, " + ", ".join(f"{c} bigint" for c in columns[1:])
    starts_ddl = "file string, block bigint, length bigint, state bigint, depth bigint, floor bigint, rest boolean"
    kinds = [pa.string(), *[pa.int64()] * 5, pa.bool_()]

    def chained(rows: pa.Table) -> pa.Table:
        splits = sorted(rows.to_pylist(), key=lambda r: r["block"])
        file, size, floor = splits[0]["file"], splits[0]["size"], splits[0]["floor"] or 0
        state, depth, starts = OUTSIDE, 0, []
        for row in splits:
            starts.append([file, row["block"], row["length"], state, depth, floor])
            less = row[f"end_less{state}"], depth + row[f"depth_less{state}"]
            state, depth = row[f"end{state}"], depth + row[f"depth{state}"]
        # Each piece was counted with an end, so bytes tell whether the last one has it; a byte-order mark isn't read.
        # A compressed file's size says nothing: there the last piece is the rest if nothing is open before it.
        over = sum(r["bytes"] for r in splits) - size
        told = over in (0, len(kind.end)) and not file.endswith(COMPRESSED)
        rest = over > 0 if told else less == (OUTSIDE, floor)
        state, depth = less if rest else (state, depth)
        if state != OUTSIDE or not kind.complete(depth, floor, rest):
            raise ValueError(f"{file}: the document doesn't end where it should")
        # The last split with any piece, which need not be the file's last one.
        marked = [[*s, rest and s is starts[-1]] for s in starts]
        names = [*SPLIT, "state", "depth", "floor", "rest"]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*marked), kinds)], names=names)

    return found.mapInArrow(summaries, ddl).groupBy("file").applyInArrow(chained, starts_ddl)


def records(spark: SparkSession, paths: Sequence[str], kind: Format) -> DataFrame:
    """``file, record``: the text of every record below ``paths``."""
    found = pieces(spark, paths, kind.end)
    starts = split_states(found, kind).select(*[F.col(c).alias(f"_{c}") for c in SPLIT], "state", "depth", "floor", "rest")
    same = [F.col(c) == F.col(f"_{c}") for c in SPLIT]
    # A row a split; a broadcast join keeps the pieces in order.
    known = found.join(F.broadcast(starts), same, "left").select(*SPLIT, "state", "depth", "floor", "rest", "value")
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("nth", pa.int32()), ("ends", pa.bool_()), ("record", pa.string())])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return batch

        for (file, block, _, state, depth, floor, rest), values in _by_split(batches):
            if state is None:
                raise RuntimeError(f"{file} was split in another way by the second pass; read it again")
            held: list[str] = []
            # Until its first record has ended, a split may be within one that began before.
            within = block > 0
            for value, last in _last_apart(values):
                if last and rest:
                    held.append(value)
                    break
                state, change = kind.step(value, state)
                depth += change
                held += [value, kind.end]
                if state == OUTSIDE and depth == floor:
                    text = "".join(held)
                    rows += [(file, block, 0, True, text)] if within else [(file, None, None, None, r) for r in kind.whole(text)]
                    held, within = [], False
                    if len(rows) >= 1000:
                        yield made()
            if held:
                rows.append((file, block, 1, False, "".join(held)))
        if rows:
            yield made()

    ddl = "file string, block bigint, nth int, ends boolean, record string"
    placed = known.mapInArrow(put_together, ddl)
    inner = placed.where("block IS NULL").select("file", "record")
    return inner.unionByName(_stitched(placed.where("block IS NOT NULL"), kind))


def _stitched(parts: DataFrame, kind: Format) -> DataFrame:
    """Records from their parts: a record ends with a part that says so, and a file with what follows its last one."""
    before = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    numbered = parts.withColumn("n", F.coalesce(F.sum(F.col("ends").cast("int")).over(before), F.lit(0)))
    whole = numbered.groupBy("file", "n").agg(
        F.array_sort(F.collect_list(F.struct("block", "nth", "record"))).alias("parts"), F.max("ends").alias("ends")
    )
    texts = whole.select("file", F.array_join(F.transform("parts", lambda p: p["record"]), "").alias("record"), "ends")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text, ends in zip(*[c.to_pylist() for c in batch.columns]):
                rows += [(file, r) for r in (kind.whole(text) if ends else kind.rest(text))]
            columns = list(zip(*rows)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["file", "record"])

    return texts.mapInArrow(cut, "file string, record string")


travel_by_value(__name__)
