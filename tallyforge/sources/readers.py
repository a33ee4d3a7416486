"""Readers. A schema given by the caller is never silently bound to reordered columns."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lines import lines_within
from .records import JsonArrays, XmlRecords, records

Schema = T.StructType | str
Paths = str | Sequence[str]

# Fields of the two all-text message records.
HEADER_FIELDS = (
    "DestinationID",
    "SenderID",
    "OperationOrganizationID",
    "MessageType",
    "DateSent",
    "TimeSent",
    "MessageID",
)
SUBHEADER_FIELDS = (
    "InstrumentID",
    "ActivityType",
    "ActivitySequenceNumber",
    "DocumentType",
    "WorkItemNumber",
    "DocumentName",
    "FaxPrintorData",
    "ReceiverFax",
    "FaxSubject",
    "FaxComments",
    "OnlineorTemporal",
    "DistributeIndicator",
    "FinalorDraftorCopy",
    "FileType",
    "UserID",
    "Product",
    "ProductType",
    "NumberofPages",
    "NumberofPrints",
)


def _paths(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_csv_with_schema(spark: SparkSession, paths: Paths, schema: Schema, **options: object) -> DataFrame:
    """CSV with header. Each file's header must name the schema's columns in order, or the read fails."""
    return spark.read.schema(schema).csv(_paths(paths), header=True, enforceSchema=False, **options)


def read_csv_text(spark: SparkSession, paths: Paths, **options: object) -> DataFrame:
    """CSV with header, every column as text."""
    return spark.read.csv(_paths(paths), header=True, **options)


def read_csv_inferred(spark: SparkSession, paths: Paths, **options: object) -> DataFrame:
    """CSV with header and inferred types (one extra pass over the files)."""
    return spark.read.csv(_paths(paths), header=True, inferSchema=True, **options)


def read_delimited(
    spark: SparkSession, paths: Paths, separator: str, schema: Schema | None = None, header: bool = False
) -> DataFrame:
    """Delimited text; the separator (tab, ``|``, ``|^``, ...) is taken literally."""
    reader = spark.read.option("sep", separator).option("header", header)
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", not header)
    return reader.csv(_paths(paths))


def read_json(spark: SparkSession, paths: Paths, schema: Schema | None = None, array_file: bool = True) -> DataFrame:
    """JSON records; ``array_file`` for files holding one array of objects, otherwise one record per line.

    Both are read in splits. An array file that is no array of objects, or ends early, is an error.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if not array_file:
        return reader.json(_paths(paths))
    texts = records(spark, _paths(paths), JsonArrays()).select("record")
    # The reader takes texts only as a dataset of the JVM, which a DataFrame of one text column is.
    strings = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(reader._jreader.json(strings), spark)


def read_parquet(spark: SparkSession, paths: Paths, schema: Schema | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*_paths(paths))


def table_schema(spark: SparkSession, database: str, table: str) -> T.StructType:
    """Schema of a catalog table, for use as a read schema; the current database is left alone."""
    return spark.table(f"`{database}`.`{table}`").schema


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: Schema) -> DataFrame:
    """Literal rows. Handed over as an Arrow table, they become a local relation of known size,
    which Spark may broadcast after its own size check."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) if rows else [[] for _ in kind.fields]
    return spark.createDataFrame(pa.table(dict(zip(kind.fieldNames(), map(list, columns)))), kind)


def read_by_extension(
    spark: SparkSession, path: str, schema: Schema | None = None, array_file: bool = False
) -> DataFrame:
    """``.csv`` or ``.json`` by the path's extension."""
    extension = posixpath.splitext(path.rstrip("/"))[1]
    if extension == ".csv":
        return read_csv_text(spark, path) if schema is None else read_csv_with_schema(spark, path, schema)
    if extension == ".json":
        return read_json(spark, path, schema, array_file)
    raise ValueError(f"{extension} files cannot be read here, only .csv and .json")


def read_csv_files(spark: SparkSession, paths: Sequence[str], schema: Schema | None = None) -> DataFrame:
    """Several ``.csv`` files as one table, each with its own header, with the file of each row."""
    wrong = [p for p in paths if not p.endswith(".csv")]
    if wrong:
        raise ValueError(f"not .csv files: {wrong}")
    df = read_csv_text(spark, paths) if schema is None else read_csv_with_schema(spark, paths, schema)
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def read_matching(spark: SparkSession, folder: str, pattern: str, fmt: str = "csv", **options: object) -> DataFrame:
    """All files below a folder whose name matches a glob."""
    reader = spark.read.format(fmt).options(pathGlobFilter=pattern, recursiveFileLookup=True, **options)
    return reader.load(folder)


def read_csv_skipping(
    spark: SparkSession, path: str, skip: int, schema: str, per: str = "file", options: dict | None = None
) -> DataFrame:
    """CSV records without the first ``skip`` lines of each file, by an index of the lines: the files aren't copied."""
    kept = lines_within(spark, path, skip + 1, F.col("total"), per)
    return kept.select("log", "line_no", F.from_csv("value", F.lit(schema), options or {}).alias("_r")).select(
        "log", "line_no", "_r.*"
    )


def message_schema() -> T.StructType:
    """Header and SubHeader records as structs of text."""

    def record(names: Sequence[str]) -> T.StructType:
        return T.StructType([T.StructField(n, T.StringType()) for n in names])

    return T.StructType(
        [T.StructField("Header", record(HEADER_FIELDS)), T.StructField("SubHeader", record(SUBHEADER_FIELDS))]
    )


def read_xml(spark: SparkSession, paths: Paths, schema: T.StructType, row_tag: str) -> DataFrame:
    """Elements of one tag, over any number of lines, read in splits; an element that cannot be parsed is an error."""
    texts = records(spark, _paths(paths), XmlRecords(row_tag))
    parsed = texts.select(F.from_xml("record", schema, {"rowTag": row_tag, "mode": "FAILFAST"}).alias("_r"))
    return parsed.select("_r.*")


def read_messages(spark: SparkSession, paths: Paths, row_tag: str = "Message") -> DataFrame:
    """XML messages with a Header and a SubHeader element."""
    return read_xml(spark, paths, message_schema(), row_tag)


def read_message_lines(spark: SparkSession, paths: Paths, row_tag: str = "Message") -> DataFrame:
    """Messages one to a line: such files are split among tasks, which an XML document is not.

    A line that is no message is an error.
    """
    text = spark.read.text(_paths(paths)).where(F.trim("value") != "")
    parsed = text.select(F.from_xml("value", message_schema(), {"rowTag": row_tag, "mode": "FAILFAST"}).alias("_m"))
    return parsed.select("_m.*")


def parse_messages(df: DataFrame, column: str, name: str = "message") -> DataFrame:
    """XML message text in a column -> struct of Header and SubHeader."""
    return df.withColumn(name, F.from_xml(F.col(column), message_schema()))


def jdbc_options(
    url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1
) -> dict[str, str]:
    """Reader options for one database table, split on a numeric key where one is given."""
    options = {"url": url, "dbtable": table}
    if key is not None:
        if bounds is None:
            raise ValueError("a partitioned read needs the key's lower and upper bound")
        options |= {
            "partitionColumn": key,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_database_table(
    spark: SparkSession,
    url: str,
    table: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """One database table, read by ``partitions`` tasks over ranges of its key."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, key, bounds, partitions), **options).load()
