"""Files as rows. Contents are not read: Spark prunes the content column."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import listed_logs, placed_lines


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """``path, name, modified, length`` of every file below a folder that holds anything; scans leave out empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("modificationTime").alias("modified"),
        "length",
    )


def files_between(
    files: DataFrame, start: str | dt.datetime, end: str | dt.datetime, include_start: bool = True
) -> DataFrame:
    """Files modified in ``[start, end]``, or ``(start, end]`` without the start."""
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    after = F.col("modified") >= first if include_start else F.col("modified") > first
    return files.where(after & (F.col("modified") <= last))


def newest_file(files: DataFrame) -> DataFrame:
    return files.orderBy(F.col("modified").desc(), "path").limit(1)


def line_counts(spark: SparkSession, folder: str, per: str = "file") -> DataFrame:
    """``log, line_count`` per file or folder, 0 for an empty one."""
    counted = placed_lines(spark, folder, per).groupBy("log").agg(F.count(F.lit(1)).alias("_n"))
    found = listed_logs(spark, folder, per).join(counted, "log", "left")
    return found.select("log", F.coalesce("_n", F.lit(0)).alias("line_count"))


def line_count_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("line_count")
    )


def last_lines(spark: SparkSession, folder: str, per: str = "file") -> DataFrame:
    """``log, last_line`` per file or folder, NULL for an empty one; a closing newline is not counted as a line."""
    lines = placed_lines(spark, folder, per)
    last = lines.groupBy("log").agg(F.max_by("value", "place").alias("last_line"))
    return listed_logs(spark, folder, per).join(last, "log", "left")


def matching_folders(files: DataFrame, suffix: str, prefix: str) -> DataFrame:
    """``folder``: the distinct folders of files whose own name ends in ``suffix`` and starts with ``prefix``."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    name = F.element_at(F.split(parent, "/"), -1)
    return files.where(name.endswith(suffix) & name.startswith(prefix)).select(parent.alias("folder")).distinct()


def select_folder(files: DataFrame, suffix: str, prefix: str) -> str:
    """The one folder holding files whose name ends in ``suffix`` and starts with ``prefix``.

    Only distinct matching folder paths reach the driver, two at most.
    """
    found = matching_folders(files, suffix, prefix).limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"{prefix}*{suffix} names more than one folder")
    if not found:
        raise ValueError(f"no folder is named {prefix}*{suffix}")
    return found[0]["folder"]
