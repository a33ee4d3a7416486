"""Files written from a table and read back by the matching reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scratch import scratch_path
from ..sinks import writers
from ..sources import readers
from .registry import query, table

_ORDER_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _orders(spark, sf):
    return table(spark, sf, "orders").select(*_ORDER_COLUMNS)


@query("read_csv_schema", _ORDERS)
def read_csv_schema(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_csv(_orders(spark, sf), path)
    return readers.read_csv_with_schema(spark, path, _ORDER_SCHEMA)


@query(
    "read_csv_text",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus FROM orders",
)
def read_csv_text(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_csv(_orders(spark, sf).drop("o_totalprice", "o_orderpriority"), path)
    return readers.read_csv_text(spark, path)


@query("read_csv_inferred", "SELECT o_orderkey + 1 AS next_key, o_totalprice * 2 AS doubled, o_orderstatus FROM orders")
def read_csv_inferred(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_csv(_orders(spark, sf), path)
    orders = readers.read_csv_inferred(spark, path)
    return orders.select(
        (F.col("o_orderkey") + F.lit(1).cast("bigint")).alias("next_key"),
        (F.col("o_totalprice") * 2).alias("doubled"),
        "o_orderstatus",
    )


@query("read_delimited", _ORDERS)
def read_delimited(spark, sf):
    path = scratch_path(spark, "text")
    writers.write_csv(_orders(spark, sf), path, separator="|^")
    return readers.read_delimited(spark, path, "|^", _ORDER_SCHEMA, header=True)


@query("read_tab_text", "SELECT CAST(o_orderkey AS VARCHAR) AS _c0, o_orderstatus AS _c1 FROM orders")
def read_tab_text(spark, sf):
    path = scratch_path(spark, "text")
    writers.write_csv(_orders(spark, sf).select("o_orderkey", "o_orderstatus"), path, header=False, separator="\t")
    return readers.read_delimited(spark, path, "\t")


@query(
    "row_score_pipe_file",
    "SELECT l_orderkey + l_partkey + l_suppkey + l_linenumber + 1 + 2 + 3 AS score FROM lineitem",
)
def row_score_pipe_file(spark, sf):
    """Seven integers a..g per line of a pipe file with a header."""
    from ..operators.shape import row_score

    path = scratch_path(spark, "text")
    keys = [F.col(c).alias(n) for c, n in zip(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), "abcd")]
    rows = table(spark, sf, "lineitem").select(*keys, F.lit(1).alias("e"), F.lit(2).alias("f"), F.lit(3).alias("g"))
    writers.write_csv(rows, path, separator="|")
    schema = ", ".join(f"{c} bigint" for c in "abcdefg")
    return readers.read_delimited(spark, path, "|", schema, header=True).select(row_score(list("abcdefg")).alias("score"))


@query("read_json", _ORDERS)
def read_json(spark, sf):
    path = scratch_path(spark, "json")
    writers.write_json(_orders(spark, sf), path)
    return readers.read_json(spark, path, _ORDER_SCHEMA, array_file=False)


@query("read_json_array", _ORDERS)
def read_json_array(spark, sf):
    """Array files with a record a line, cut into splits at the records' ends."""
    path = scratch_path(spark, "json")
    writers.write_json_arrays(_orders(spark, sf), path)
    return readers.read_json(spark, path, _ORDER_SCHEMA)


@query("read_json_array_inferred", _ORDERS)
def read_json_array_inferred(spark, sf):
    path = scratch_path(spark, "json")
    writers.write_json_arrays(_orders(spark, sf), path)
    return readers.read_json(spark, path).select(*_ORDER_COLUMNS)


@query("read_json_inferred", _ORDERS)
def read_json_inferred(spark, sf):
    folder = scratch_path(spark, "json")
    path = writers.write_json_at(_orders(spark, sf), folder, "2024-09-10_12-30-00")
    return readers.read_json(spark, path, array_file=False).select(*_ORDER_COLUMNS)


@query("read_parquet", "SELECT o_orderkey, o_totalprice FROM orders")
def read_parquet(spark, sf):
    path = scratch_path(spark, "parquet")
    writers.write_parquet(_orders(spark, sf), path)
    return readers.read_parquet(spark, path, "o_orderkey bigint, o_totalprice double")


@query(
    "read_by_extension",
    f"SELECT 'csv' AS kind, * FROM ({_ORDERS}) UNION ALL SELECT 'json', * FROM ({_ORDERS})",
)
def read_by_extension(spark, sf):
    folder = scratch_path(spark, "mixed")
    writers.write_csv(_orders(spark, sf), f"{folder}/orders.csv")
    writers.write_json(_orders(spark, sf), f"{folder}/orders.json")
    parts = [
        readers.read_by_extension(spark, f"{folder}/orders.{kind}", _ORDER_SCHEMA).select(F.lit(kind).alias("kind"), "*")
        for kind in ("csv", "json")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "read_many_files",
    f"SELECT *, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS folder FROM ({_ORDERS})",
)
def read_many_files(spark, sf):
    folder = scratch_path(spark, "many")
    orders = _orders(spark, sf)
    writers.write_csv(orders.where("o_orderstatus = 'F'"), f"{folder}/done.csv")
    writers.write_csv(orders.where("o_orderstatus <> 'F'"), f"{folder}/open.csv")
    both = readers.read_csv_files(spark, [f"{folder}/done.csv", f"{folder}/open.csv"], _ORDER_SCHEMA)
    name = F.regexp_extract("source_file", r"([a-z]+)\.csv/[^/]+$", 1)
    return both.select(*_ORDER_COLUMNS, name.alias("folder"))


@query("read_matching_files", f"SELECT * FROM ({_ORDERS}) WHERE o_orderstatus = 'F'")
def read_matching_files(spark, sf):
    """CSV and JSON parts lie below one folder; the name pattern picks the CSV ones."""
    folder = scratch_path(spark, "matching")
    orders = _orders(spark, sf)
    writers.write_csv(orders.where("o_orderstatus = 'F'"), f"{folder}/a")
    writers.write_json(orders.where("o_orderstatus <> 'F'"), f"{folder}/b")
    return readers.read_matching(spark, folder, "part-*.csv", header=True).select(
        *[F.col(c).cast(t).alias(c) for c, t in zip(_ORDER_COLUMNS, ("bigint", "bigint", "string", "double", "string"))]
    )


@query(
    "write_modes",
    "SELECT 'append' AS mode, 2 * count(*) AS n FROM orders UNION ALL SELECT 'ignore', 2 * count(*) FROM orders UNION ALL SELECT 'overwrite', count(*) FROM orders",
)
def write_modes(spark, sf):
    orders = _orders(spark, sf)
    counts = []
    path = scratch_path(spark, "modes")
    writers.write_parquet(orders, path)
    for mode in ("append", "ignore", "overwrite"):
        target = path if mode != "overwrite" else scratch_path(spark, "modes")
        if mode == "overwrite":
            writers.write_parquet(orders, target)
        writers.write_parquet(orders, target, mode)
        rows = spark.read.parquet(target).agg(F.count(F.lit(1)).alias("n"))
        counts.append(rows.select(F.lit(mode).alias("mode"), "n"))
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_MESSAGES = """
    SELECT 'D' || o_custkey AS DestinationID, o_orderstatus AS MessageType, CAST(o_orderkey AS VARCHAR) AS MessageID,
           o_orderpriority AS Product, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_custkey AS VARCHAR) END AS UserID FROM orders
"""


def _messages(spark, sf):
    given = {
        "DestinationID": F.concat(F.lit("D"), "o_custkey"),
        "MessageType": F.col("o_orderstatus"),
        "MessageID": F.col("o_orderkey").cast("string"),
        "Product": F.col("o_orderpriority"),
        "UserID": F.when(F.col("o_orderstatus") != "F", F.col("o_custkey").cast("string")),
    }

    def record(name, fields):
        return F.struct(*[given.get(f, F.lit(f.lower())).alias(f) for f in fields]).alias(name)

    return table(spark, sf, "orders").select(
        record("Header", readers.HEADER_FIELDS), record("SubHeader", readers.SUBHEADER_FIELDS)
    )


def _shown(messages):
    return messages.select(
        "Header.DestinationID", "Header.MessageType", "Header.MessageID", "SubHeader.Product", "SubHeader.UserID"
    )


@query("xml_records", _MESSAGES)
def xml_records(spark, sf):
    path = scratch_path(spark, "xml")
    writers.write_messages(_messages(spark, sf), path)
    return _shown(readers.read_messages(spark, path))


@query("xml_message_lines", _MESSAGES)
def xml_message_lines(spark, sf):
    path = scratch_path(spark, "xml")
    writers.write_message_lines(_messages(spark, sf), path)
    return _shown(readers.read_message_lines(spark, path))


@query(
    "convert_csv_json",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM orders",
)
def convert_csv_json(spark, sf):
    folder = scratch_path(spark, "convert")
    writers.write_csv(_orders(spark, sf), f"{folder}/csv")
    writers.convert(spark, f"{folder}/csv", "csv", f"{folder}/json", "json", source_options={"header": True})
    return readers.read_json(spark, f"{folder}/json", array_file=False).select("o_orderkey", "o_orderstatus")


@query("convert_json_parquet", _ORDERS)
def convert_json_parquet(spark, sf):
    folder = scratch_path(spark, "convert")
    writers.write_json(_orders(spark, sf), f"{folder}/json")
    writers.convert(spark, f"{folder}/json", "json", f"{folder}/parquet", "parquet", schema=_ORDER_SCHEMA)
    return readers.read_parquet(spark, f"{folder}/parquet")


@query("convert_delimited_csv", _ORDERS)
def convert_delimited_csv(spark, sf):
    folder = scratch_path(spark, "convert")
    writers.write_csv(_orders(spark, sf), f"{folder}/text", separator="|^")
    writers.convert(
        spark, f"{folder}/text", "csv", f"{folder}/csv", "csv",
        source_options={"header": True, "sep": "|^"}, target_options={"header": True},
    )
    return readers.read_csv_with_schema(spark, f"{folder}/csv", _ORDER_SCHEMA)
