"""File sinks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tasks import travel_by_value

# Messages of a compressed document, which one task reads: some 100 MB of text.
FILE_ROWS = 100_000


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error", header: bool = True, separator: str = ",") -> None:
    df.write.mode(mode).option("header", header).option("sep", separator).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_json_arrays(df: DataFrame, path: str, mode: str = "error") -> None:
    """Each part file as one JSON array with a record a line; a part without rows is an empty array."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = "["
        for batch in batches:
            if len(batch):
                lines = pc.binary_join_element_wise(pa.array([sign] + [","] * (len(batch) - 1)), batch.column(0), "")
                sign = ","
                yield pa.RecordBatch.from_arrays([lines], names=["value"])
        yield pa.RecordBatch.from_pydict({"value": ["[]" if sign == "[" else "]"]})

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(framed, "value string").write.mode(mode).text(path)


def write_json_at(df: DataFrame, folder: str, moment: str) -> str:
    """JSON below a name made of the caller's time text (``yyyy-MM-dd_HH-mm-ss``); returns the path."""
    path = f"{folder.rstrip('/')}/{moment}.json"
    df.write.json(path)
    return path


def write_message_lines(df: DataFrame, path: str, mode: str = "error", row_tag: str = "Message") -> None:
    """Each row as one line of XML; line breaks inside fields become character references."""
    message = F.rtrim(F.to_xml(F.struct(*df.columns), {"rowTag": row_tag, "indent": ""}), F.lit("\n"))
    one_line = F.replace(F.replace(message, F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("&#10;"))
    df.select(one_line.alias("value")).write.mode(mode).text(path)


def write_messages(df: DataFrame, path: str, row_tag: str = "Message", root_tag: str = "Messages", file_rows: int = FILE_ROWS) -> None:
    """XML documents of rows, without indentation and compressed: tags are most of their text.

    A compressed file is read by one task, so none holds more than ``file_rows`` rows.
    """
    df.write.option("indent", "").option("compression", "gzip").option("maxRecordsPerFile", file_rows).xml(path, rowTag=row_tag, rootTag=root_tag)


def write_partitioned(df: DataFrame, base: str, column: str) -> None:
    """Overwrite only the partitions that occur in ``df``, in one job.

    ``rebalance`` groups rows by partition value but lets adaptive execution
    split a value that is much larger than the others over several tasks.
    """
    (
        df.hint("rebalance", column)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .parquet(base)
    )


def convert(
    spark: SparkSession,
    source: str,
    source_format: str,
    target: str,
    target_format: str,
    schema: T.StructType | str | None = None,
    source_options: Mapping[str, object] | None = None,
    target_options: Mapping[str, object] | None = None,
    mode: str = "error",
) -> None:
    """Read one format and write another; CSV without a schema keeps every value as text."""
    reader = spark.read.format(source_format).options(**dict(source_options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    reader.load(source).write.format(target_format).options(**dict(target_options or {})).mode(mode).save(target)


def table_set_to_parquet(
    spark: SparkSession,
    frames: Mapping[str, DataFrame],
    schemas: Mapping[str, T.StructType],
    paths: Mapping[str, str],
    partition_columns: Mapping[str, str] | None = None,
    mode: str = "error",
) -> DataFrame:
    """Write each named table with its declared schema, without its partition column.

    Returns ``name, outcome``; a table without a path is skipped.
    """
    report = []
    for name, df in frames.items():
        if name not in paths:
            report.append((name, "skipped: no path"))
            continue
        typed = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schemas[name].fields])
        drop = (partition_columns or {}).get(name)
        write_parquet(typed.drop(drop) if drop else typed, paths[name], mode)
        report.append((name, "written"))
    return spark.createDataFrame(report, "name string, outcome string")


def query_report(spark: SparkSession, sql: str, folder: str) -> DataFrame:
    """Write a query's rows to ``folder/result`` and one row about the query to ``folder/query``; return that row.

    The row count is taken from the written files, not from a second run.
    """
    result = spark.sql(sql)
    result.write.parquet(f"{folder}/result")
    written = spark.read.schema(result.schema).parquet(f"{folder}/result")
    about = written.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(sql).alias("query"), "row_count", F.lit(", ".join(result.columns)).alias("columns")
    )
    about.write.parquet(f"{folder}/query")
    return spark.read.parquet(f"{folder}/query")


def unload(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> Sequence[str]:
    """Write many tables (database readers, catalog tables, files) below one folder, one Parquet table each."""
    written = []
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        written.append(name)
    return written


travel_by_value(__name__)
