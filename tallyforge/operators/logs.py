"""Log text: metrics, run status, line slices and file-name checks, for whole folders of logs at once."""

from __future__ import annotations

import operator
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import filename_dmy_date
from ..sources.lines import lines_within

# Texts looked for in logs.
LOG_METRICS = {
    "total_processed": "Total Processed",
    "total_success": "Total Success",
    "total_error": "Total Error",
}
COMPLETE_MARK = "+++++COMPLETE+++++"
LAST_LINE_MARK = "command successful"


def _of_all(found: DataFrame, logs: DataFrame | None) -> DataFrame:
    """``found`` for all ``logs``, also those without lines; without a list, for the logs that have lines."""
    return found if logs is None else logs.select("log").distinct().join(found, "log", "left")


def log_metrics(
    lines: DataFrame, metrics: Mapping[str, str] = LOG_METRICS, logs: DataFrame | None = None
) -> DataFrame:
    """Per log the last value of each metric: the text between the first and second ':' of its last line.

    Only lines with a metric's text are aggregated; ``logs`` (or all lines' logs) name the logs.
    """

    def last_value(text: str) -> Column:
        value = F.trim(F.get(F.split("value", ":"), F.lit(1)))
        hit = F.col("value").contains(text)
        return F.max_by(F.when(hit, value), F.when(hit, F.col("place")))

    hits = lines.where(reduce(operator.or_, [F.col("value").contains(text) for text in metrics.values()]))
    found = hits.groupBy("log").agg(*[last_value(text).alias(name) for name, text in metrics.items()])
    return _of_all(found, lines.select("log") if logs is None else logs)


def log_metric_lines(
    lines: DataFrame, metrics: Mapping[str, str] = LOG_METRICS, logs: DataFrame | None = None
) -> DataFrame:
    """Per log the number of lines that contain each metric's text, 0 for a log without lines."""
    counts = [F.count_if(F.col("value").contains(text)).alias(name) for name, text in metrics.items()]
    return _of_all(lines.groupBy("log").agg(*counts), logs).fillna(0, list(metrics))


def run_status(
    lines: DataFrame, mark: str = COMPLETE_MARK, last_mark: str = LAST_LINE_MARK, logs: DataFrame | None = None
) -> DataFrame:
    """``log, status``: success when a line has the mark or the last line has the last-line mark.

    With ``logs``, a log without any line has failed. Only places and two flags are aggregated, not the lines.
    """
    flagged = lines.select(
        "log", "place", F.col("value").contains(mark).alias("_mark"), F.col("value").contains(last_mark).alias("_end")
    )
    seen = flagged.groupBy("log").agg(F.max("_mark").alias("_marked"), F.max(F.struct("place", "_end"))["_end"].alias("_ended"))
    good = F.coalesce(F.col("_marked") | F.col("_ended"), F.lit(False))
    return _of_all(seen, logs).select("log", F.when(good, F.lit("success")).otherwise(F.lit("failed")).alias("status"))


def status_totals(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def line_slice(numbered: DataFrame, first: int, last: int) -> DataFrame:
    """Lines of a log that is numbered already; :func:`lines_within` numbers only what it needs."""
    return numbered.where(F.col("line_no").between(first, last)).drop("lines_from_end")


def last_n_lines(numbered: DataFrame, n: int = 20) -> DataFrame:
    return numbered.where(F.col("lines_from_end") <= n).drop("lines_from_end")


def log_slice(spark: SparkSession, path: str, first: int, last: int, per: str = "file") -> DataFrame:
    """``log, line_no, value`` of lines ``first`` to ``last`` of each log, without a copy of the logs."""
    return lines_within(spark, path, first, last, per)


def log_tail(spark: SparkSession, path: str, n: int = 20, per: str = "file") -> DataFrame:
    """The last ``n`` lines of each log; only splits that hold any of them are numbered."""
    return lines_within(spark, path, F.col("total") - n + 1, F.col("total"), per)


def file_date_check(listing: DataFrame, package: str, name: str, packages: DataFrame) -> DataFrame:
    """``package, name, outcome`` for expected packages dated ``dd-MM-yyyy`` and the file names listed in them.

    Each name must carry its package's date; a package without any listed file
    is one error row.
    """
    expected = packages.select(package).distinct()
    listed = listing.select(package, name).join(packages.select(package), package, "left_semi")
    good = filename_dmy_date(F.col(name)) == filename_dmy_date(F.col(package))
    checked = listed.withColumn(
        "outcome", F.when(good, F.lit("ok")).otherwise(F.lit("error: wrong or missing date"))
    )
    missing = expected.join(listing.select(package), package, "left_anti").select(
        package, F.lit(None).cast("string").alias(name), F.lit("error: package not found").alias("outcome")
    )
    return checked.unionByName(missing)
