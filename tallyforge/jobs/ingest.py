"""Metadata-driven ingest: checked files become partitions of Parquet tables."""

from __future__ import annotations

import argparse
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.catalog import run_script_files
from ..sinks.writers import write_partitioned
from ..sources.readers import inline_rows, read_by_extension, read_csv_text, table_schema

# Text of Spark's own header check.
HEADER_MISMATCH = "CSV header does not conform to the schema"

STATUS_SCHEMA = "file string, table string, status string, reason string, n_rows bigint, n_partitions bigint"


class Refused(Exception):
    """The file fails a check; nothing is written for it."""


def check_file(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows and partitions of a file fit to be written, from one pass; raises :class:`Refused` otherwise."""
    if column not in df.columns:
        raise Refused(f"no column {column} to partition by")
    filled = [F.count(F.col(f"`{c}`")).alias(f"_f{i}") for i, c in enumerate(df.columns)]
    seen = df.groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"), *filled)
    facts = seen.agg(
        F.sum("_rows").alias("rows"),
        F.count("_value").alias("partitions"),
        F.sum(F.when(F.col("_value").isNull(), F.col("_rows"))).alias("nulls"),
        *[F.sum(f"_f{i}").alias(f"_f{i}") for i in range(len(df.columns))],
    ).first()
    if facts["nulls"]:
        raise Refused(f"NULL in {column}, the column to partition by")
    if not any(facts[f"_f{i}"] for i in range(len(df.columns))):
        raise Refused("nothing but NULL")
    return facts["rows"], facts["partitions"]


def check_header(spark: SparkSession, path: str, names: list[str]) -> None:
    """Refuse a CSV whose first file has other columns than the table; the read itself checks every file."""
    if not path.rstrip("/").endswith(".csv"):
        return
    found = read_csv_text(spark, path).columns
    if [c.lower() for c in found] != [c.lower() for c in names]:
        raise Refused(f"{HEADER_MISMATCH}: {', '.join(found)}")


def load_entries(spark: SparkSession, metadata_path: str) -> list[dict]:
    """Entries of a metadata file ``{"files": [{csv_file_path, table_name, ...}]}``: job control, small."""
    files = spark.read.option("multiLine", True).json(metadata_path).select(F.explode("files").alias("f"))
    return [row.asDict() for row in files.select("f.*").collect()]


def ingest_file(spark: SparkSession, entry: Mapping[str, str]) -> tuple:
    """One entry's status row; whatever goes wrong with it stays with it."""
    path = entry["csv_file_path"]
    table = f"{entry['database_name']}.{entry['table_name']}"
    try:
        schema = table_schema(spark, entry["database_name"], entry["table_name"])
        check_header(spark, path, schema.fieldNames())
        df = read_by_extension(spark, path, schema)
        rows, partitions = check_file(df, entry["partition_column"])
        write_partitioned(df, entry["hdfs_base_path"], entry["partition_column"])
    except Refused as reason:
        return (path, table, "refused", str(reason), None, None)
    except Exception as error:  # a bad file must not end the batch
        if HEADER_MISMATCH in str(error):
            return (path, table, "refused", HEADER_MISMATCH, None, None)
        return (path, table, "error", str(error).splitlines()[0], None, None)
    return (path, table, "ok", None, rows, partitions)


def below(base: str | None, path: str) -> str:
    """``path`` below the base folder, unless it is absolute or names a file system itself."""
    if not base or path.startswith("/") or "://" in path or path.startswith("file:"):
        return path
    return f"{base.rstrip('/')}/{path}"


def ingest(spark: SparkSession, metadata_path: str, base: str | None = None, at_once: int = 4) -> DataFrame:
    """Ingest every file the metadata names; one status row per file, in the metadata's order.

    ``base`` is put before relative paths. Up to ``at_once`` entries run side by side, so that small files do not
    leave a cluster idle; their jobs share it as its scheduler decides.
    """
    entries = [
        {**e, **{k: below(base, e[k]) for k in ("csv_file_path", "hdfs_base_path")}} for e in load_entries(spark, metadata_path)
    ]
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        report = list(pool.map(lambda entry: ingest_file(spark, entry), entries))
    return inline_rows(spark, report, STATUS_SCHEMA)


def main(arguments: list[str] | None = None) -> None:
    """``python -m tallyforge.jobs.ingest --select metadata.json [--scripts folder] [--base folder]`` under spark-submit."""
    parser = argparse.ArgumentParser(description="Ingest the CSV and JSON files that a metadata file names.")
    parser.add_argument("--select", required=True, help="path of the metadata JSON file")
    parser.add_argument("--scripts", help="folder whose .hql files are run first, in name order")
    parser.add_argument("--base", help="folder put before relative paths of the metadata")
    chosen = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("ingest").getOrCreate()
    if chosen.scripts:
        run_script_files(spark, chosen.scripts)
    ingest(spark, chosen.select, chosen.base).show(truncate=False)


if __name__ == "__main__":
    main()
