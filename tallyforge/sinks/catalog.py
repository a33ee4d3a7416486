"""Catalog upkeep: scripts, partitions, clones, copies and inventory."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import list_files

# A statement is a run of quoted texts, comments and anything but ';'.
_STATEMENT = re.compile(
    r"(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[^;'\"`])+", re.DOTALL
)
_COMMENT = re.compile(r"\s*(?:--[^\n]*(?:\n|$)|/\*.*?\*/)", re.DOTALL)

# Partitions named in one ALTER TABLE statement.
PARTITIONS_PER_STATEMENT = 500


def split_statements(script: str) -> Iterator[str]:
    """Statements of a script; a ';' inside quotes or comments does not end one."""
    for match in _STATEMENT.finditer(script):
        statement = match[0].strip()
        if _COMMENT.sub("", statement).strip():
            yield statement


def run_script(spark: SparkSession, script: str, name: str = "script") -> DataFrame | None:
    """Run a script's statements in order; the first failure stops it and is named. Returns the last result."""
    result = None
    for number, statement in enumerate(split_statements(script), start=1):
        try:
            result = spark.sql(statement)
        except Exception as cause:
            raise RuntimeError(f"{name}: statement {number} failed: {statement}") from cause
    return result


def run_script_files(spark: SparkSession, folder: str, suffix: str = ".hql") -> list[str]:
    """Run every script file of a folder in name order; returns the names that ran."""
    scripts = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    rows = scripts.select(F.col("_metadata.file_name").alias("name"), "value").orderBy("name").collect()
    for row in rows:
        run_script(spark, row["value"], row["name"])
    return [row["name"] for row in rows]


def _partition_spec(path: str) -> str:
    """``a=1/b=x%3Ay`` -> ``a='1', b='x:y'``."""
    pairs = [part.split("=", 1) for part in path.split("/")]
    return ", ".join(f"`{unquote(key)}`='{_quoted(unquote(value))}'" for key, value in pairs)


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def drop_all_partitions(spark: SparkSession, table: str) -> int:
    """Drop every partition of a table; returns how many there were."""
    specs = [_partition_spec(row[0]) for row in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    for i in range(0, len(specs), PARTITIONS_PER_STATEMENT):
        listed = ", ".join(f"PARTITION ({spec})" for spec in specs[i : i + PARTITIONS_PER_STATEMENT])
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {listed}")
    return len(specs)


def clone_empty(spark: SparkSession, source: str, clone: str) -> None:
    """Empty table with the columns and layout of another, in its own location."""
    if not spark.catalog.tableExists(source):
        raise ValueError(f"table {source} does not exist")
    if spark.catalog.tableExists(clone):
        raise ValueError(f"table {clone} exists already")
    spark.sql(f"CREATE TABLE {clone} LIKE {source}")


def copy_partition(spark: SparkSession, tables: Sequence[str], column: str, value: str, target: str) -> None:
    """Copy one partition of each table below ``target/<table>/``; other partitions there stay."""
    for table in tables:
        (
            spark.table(table)
            .where(F.col(column) == F.lit(value))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(column)
            .parquet(f"{target.rstrip('/')}/{table.split('.')[-1]}")
        )


def table_columns(spark: SparkSession, database: str) -> dict[str, list[str]]:
    """Column names of every table of a database, from the catalog."""
    names = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
    return {n: [c.name for c in spark.catalog.listColumns(f"`{database}`.`{n}`")] for n in names}


def table_inventory(spark: SparkSession, database: str) -> DataFrame:
    """``table_name, column_names, n_rows`` for a database, all row counts in one job."""
    columns = table_columns(spark, database)
    if not columns:
        raise ValueError(f"no tables in {database}")
    counts = [
        spark.table(f"`{database}`.`{name}`")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(name).alias("table_name"), F.lit(", ".join(cols)).alias("column_names"), "n_rows")
        for name, cols in columns.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def table_location(spark: SparkSession, table: str) -> str:
    details = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").collect()
    if not details:
        raise ValueError(f"{table} has no location")
    return details[0]["data_type"]


def table_sizes(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """``table_name, location, n_files, n_bytes``: file lengths summed in Spark, no content read."""

    def size(table: str) -> DataFrame:
        location = table_location(spark, table)
        files = list_files(spark, location)
        return files.agg(
            F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes")
        ).select(F.lit(table).alias("table_name"), F.lit(location).alias("location"), "n_files", "n_bytes")

    return reduce(DataFrame.unionByName, [size(t) for t in tables])
