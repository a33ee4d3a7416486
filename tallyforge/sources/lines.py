"""Text as numbered lines.

Spark reads a large text file in splits, in parallel. A line's place is the
split's start in the file and the order inside the split; line numbers add the
line counts of the splits before. A log may be one file, or a folder of part
files whose names sort in write order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from ..tasks import travel_by_value


def log_name(per: str, path: Column | None = None) -> Column:
    """The log a line belongs to: its file, or the folder its part file is in."""
    path = F.col("_metadata.file_path") if path is None else path
    if per == "file":
        # The reader's file index and its rows write a local path with three slashes and with one.
        return F.regexp_replace(path, "^file:/+", "file:/")
    if per == "folder":
        return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    raise ValueError("per is 'file' or 'folder'")


def placed_lines(spark: SparkSession, path: str, per: str = "file", recursive: bool = True) -> DataFrame:
    """``log, place, value``: ``place`` is a struct that sorts a log's lines in written order."""
    lines = spark.read.option("recursiveFileLookup", recursive).text(path)
    return lines.select(
        log_name(per).alias("log"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seq"),
        ).alias("place"),
        "value",
    )


def listed_logs(spark: SparkSession, path: str, per: str = "file", recursive: bool = True) -> DataFrame:
    """``log``: every log of a folder, also those without any line.

    Scans leave out files of no bytes, so the names come from the reader's file index, which the driver holds for
    every read of the folder.
    """
    names = spark.read.option("recursiveFileLookup", recursive).text(path)._jdf.inputFiles()
    # The names stay in the JVM, which holds the index: one literal array of them.
    every = Column(spark._jvm.org.apache.spark.sql.functions.lit(names))
    files = spark.range(1).select(F.explode(every).alias("value"))
    return files.select(log_name(per, F.col("value")).alias("log")).distinct()


SPLIT = ["file", "block", "length"]


def _split_columns() -> list[Column]:
    names = ("file_path", "file_block_start", "file_block_length")
    return [F.col(f"_metadata.{name}").alias(c) for name, c in zip(names, SPLIT)]


def line_index(spark: SparkSession, path: str, per: str = "file", recursive: bool = True) -> DataFrame:
    """``log, file, block, length, lines, before, total``: a row a split, from one pass that counts lines only.

    ``before`` are the log's lines in earlier splits. The rows are written, so that their size is known.
    """
    lines = spark.read.option("recursiveFileLookup", recursive).text(path)
    counts = lines.select(log_name(per).alias("log"), *_split_columns()).groupBy("log", *SPLIT).agg(F.count(F.lit(1)).alias("lines"))
    by_log = Window.partitionBy("log")
    before = by_log.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    return materialize(placed.withColumn("total", F.sum("lines").over(by_log)), "line-index")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line numbers from each split's ``before``; the rows of a split come one after the other."""
    last, seen = None, 0
    for batch in batches:
        file, block = batch.column(0), batch.column(1)
        codes = file.dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(block.to_numpy()) != 0)) + 1
        place = np.zeros(len(batch), np.int64)
        for a, b in zip([0, *starts.tolist()], [*starts.tolist(), len(batch)]):
            if b > a:
                key = file[a].as_py(), block[a].as_py()
                seen = seen if key == last else 0
                place[a:b] = np.arange(seen + 1, seen + b - a + 1)
                last, seen = key, seen + b - a
        number = pa.array(batch.column(3).to_numpy() + place)
        yield pa.RecordBatch.from_arrays([batch.column(2), number, batch.column(4)], names=["log", "line_no", "value"])


def lines_within(
    spark: SparkSession, path: str, first: Column | int, last: Column | int, per: str = "file", recursive: bool = True
) -> DataFrame:
    """``log, line_no, value`` of lines ``first`` to ``last`` of each log; the bounds may use ``total``, the log's lines.

    A pass counts the lines of each split, and a second one numbers the lines of splits that hold any that are wanted.
    The text is neither written nor shuffled. A second pass that meets other splits than the first fails.
    """
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    index = line_index(spark, path, per, recursive).select(
        *[F.col(c).alias(f"_{c}") for c in SPLIT], "log", "before", first.alias("first"), last.alias("last"),
        ((F.col("before") < last) & (F.col("before") + F.col("lines") >= first)).alias("wanted"),
    )
    lines = spark.read.option("recursiveFileLookup", recursive).text(path).select(*_split_columns(), "value")
    same = [F.col(c) == F.col(f"_{c}") for c in SPLIT]
    # A row a split, of which the driver plans each; the join keeps the lines in order.
    met = lines.join(F.broadcast(index), same, "left")
    wanted = F.coalesce("wanted", F.raise_error(F.concat("file", F.lit(" was split in another way by the second pass"))).cast("boolean"))
    kept = met.where(wanted)
    bounds = index.groupBy(F.col("log").alias("_log")).agg(F.max("first").alias("first"), F.max("last").alias("last"))
    numbered = kept.select("file", "block", "log", "before", "value").mapInArrow(_number, "log string, line_no bigint, value string")
    within = numbered.join(F.broadcast(bounds), F.col("log") == F.col("_log")).where(F.col("line_no").between(F.col("first"), F.col("last")))
    return within.select("log", "line_no", "value")


def numbered_lines(spark: SparkSession, path: str, per: str = "file", recursive: bool = True) -> DataFrame:
    """``log, line_no, lines_from_end, value``; both numbers count from 1.

    Only the splits' line counts are put in order (one row per split); lines
    themselves are not sorted. They are written once first, since a rerun may
    cut the splits elsewhere.
    """
    lines = materialize(placed_lines(spark, path, per, recursive), "lines")
    split = [F.col("place.file").alias("file"), F.col("place.block").alias("block")]
    counts = lines.groupBy("log", *split).agg(
        F.count(F.lit(1)).alias("_lines"), F.min("place.seq").alias("_first")
    )
    by_log = Window.partitionBy("log")
    before = by_log.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("log").alias("_log"),
        "file",
        "block",
        "_first",
        F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"),
        F.sum("_lines").over(by_log).alias("_total"),
    )
    here = (
        (F.col("log") == F.col("_log"))
        & (F.col("place.file") == F.col("file"))
        & (F.col("place.block") == F.col("block"))
    )
    line_no = F.col("_before") + F.col("place.seq") - F.col("_first") + F.lit(1)
    return lines.join(offsets, here).select(
        "log", line_no.alias("line_no"), (F.col("_total") - line_no + 1).alias("lines_from_end"), "value"
    )


travel_by_value(__name__)
