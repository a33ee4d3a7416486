"""Catalog tables, partitions and the ingest job, each in a database of its own below the scratch folder."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.nested import update_by_predicate
from ..jobs import ingest as ingest_job
from ..scratch import scratch_path
from ..sinks import catalog, writers
from ..sources import readers
from .registry import query, table

_ORDER_DDL = "o_orderkey BIGINT, o_custkey BIGINT, o_orderpriority STRING, o_orderstatus STRING"
_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"]
_ORDERS = "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders"


def _database(spark) -> str:
    path = scratch_path(spark, "db")
    name = "tf_" + path.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    return name


def _orders(spark, sf):
    return table(spark, sf, "orders").select(*_ORDER_COLUMNS)


def _partitioned_orders(spark, sf, database: str, name: str = "orders") -> str:
    spark.sql(f"CREATE TABLE {database}.{name} ({_ORDER_DDL}) USING parquet PARTITIONED BY (o_orderstatus)")
    _orders(spark, sf).hint("rebalance", "o_orderstatus").write.mode("append").insertInto(f"{database}.{name}")
    return f"{database}.{name}"


@query("read_table", f"SELECT * FROM ({_ORDERS})")
def read_table(spark, sf):
    """The schema of a catalog table read from files of another folder."""
    database = _database(spark)
    _partitioned_orders(spark, sf, database)
    path = scratch_path(spark, "csv")
    writers.write_csv(_orders(spark, sf), path)
    return readers.read_csv_with_schema(spark, path, readers.table_schema(spark, database, "orders"))


@query(
    "write_partitioned",
    """
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'rewritten' ELSE o_orderpriority END AS o_orderpriority,
           o_orderstatus FROM orders
    """,
)
def write_partitioned(spark, sf):
    """A second write of one status replaces that partition and leaves the others."""
    base = scratch_path(spark, "partitioned")
    orders = _orders(spark, sf)
    writers.write_partitioned(orders, base, "o_orderstatus")
    again = orders.where("o_orderstatus = 'F'").withColumn("o_orderpriority", F.lit("rewritten"))
    writers.write_partitioned(again, base, "o_orderstatus")
    return spark.read.schema(_ORDER_DDL).parquet(base)


@query(
    "sql_script",
    "SELECT o_orderstatus, count(*) AS n, 'a;b' AS mark FROM orders WHERE o_orderstatus <> ';' GROUP BY 1",
)
def sql_script(spark, sf):
    database = _database(spark)
    script = f"""
        -- the statement below holds a quoted ; and this comment another one ;
        CREATE TABLE {database}.marked USING parquet AS
          SELECT *, 'a;b' AS mark FROM parquet.`{sf}/orders.parquet` WHERE o_orderstatus <> ';';
        /* last ; */
        SELECT o_orderstatus, count(*) AS n, mark FROM {database}.marked GROUP BY o_orderstatus, mark;
    """
    return catalog.run_script(spark, script, "marked.hql")


@query("drop_partitions", "SELECT count(DISTINCT o_orderstatus) AS dropped, 0 AS rows_left FROM orders")
def drop_partitions(spark, sf):
    name = _partitioned_orders(spark, sf, _database(spark))
    dropped = catalog.drop_all_partitions(spark, name)
    left = spark.table(name).agg(F.count(F.lit(1)).cast("int").alias("rows_left"))
    return left.select(F.lit(dropped).cast("bigint").alias("dropped"), "rows_left")


@query(
    "clone_table",
    "SELECT 'o_orderkey, o_custkey, o_orderpriority, o_orderstatus' AS columns, 0 AS clone_rows, count(*) AS source_rows FROM orders",
)
def clone_table(spark, sf):
    name = _partitioned_orders(spark, sf, _database(spark))
    catalog.clone_empty(spark, name, f"{name}_backup")
    clone = spark.table(f"{name}_backup")
    columns = ", ".join(clone.columns)
    counts = clone.select(F.lit(1).alias("c"), F.lit(0).alias("s")).unionAll(
        spark.table(name).select(F.lit(0).alias("c"), F.lit(1).alias("s"))
    )
    return counts.agg(F.sum("c").cast("int").alias("clone_rows"), F.sum("s").alias("source_rows")).select(
        F.lit(columns).alias("columns"), "clone_rows", "source_rows"
    )


@query("copy_partition", f"SELECT * FROM ({_ORDERS}) WHERE o_orderstatus = 'O'")
def copy_partition(spark, sf):
    name = _partitioned_orders(spark, sf, _database(spark))
    target = scratch_path(spark, "copy")
    catalog.copy_partition(spark, [name], "o_orderstatus", "O", target)
    return spark.read.schema(_ORDER_DDL).parquet(f"{target}/orders")


@query(
    "query_report",
    """
    WITH r AS (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT 'query' AS part, 'o_orderstatus, n' AS text, count(*) AS n FROM r
    UNION ALL SELECT 'result', o_orderstatus, n FROM r
    """,
)
def query_report(spark, sf):
    folder = scratch_path(spark, "report")
    sql = f"SELECT o_orderstatus, count(*) AS n FROM parquet.`{sf}/orders.parquet` GROUP BY o_orderstatus, o_custkey"
    about = writers.query_report(spark, sql, folder)
    rows = spark.read.parquet(f"{folder}/result")
    return about.select(F.lit("query").alias("part"), F.col("columns").alias("text"), F.col("row_count").alias("n")).unionByName(
        rows.select(F.lit("result").alias("part"), F.col("o_orderstatus").alias("text"), "n")
    )


@query(
    "table_inventory",
    """
    SELECT 'customer' AS table_name, 'c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment' AS column_names, count(*) AS n_rows FROM customer
    UNION ALL SELECT 'nation', 'n_nationkey, n_name, n_regionkey', count(*) FROM nation
    UNION ALL SELECT 'orders', 'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority', count(*) FROM orders
    """,
)
def table_inventory(spark, sf):
    database = _database(spark)
    for name in ("customer", "nation", "orders"):
        spark.sql(f"CREATE TABLE {database}.{name} USING parquet LOCATION '{sf}/{name}.parquet'")
    return catalog.table_inventory(spark, database)


@query("table_sizes")
def table_sizes(spark, sf):
    database = _database(spark)
    names = [_partitioned_orders(spark, sf, database, f"orders_{i}") for i in (1, 2)]
    sizes = catalog.table_sizes(spark, names)
    return sizes.select(F.split("table_name", r"\.")[1].alias("table_name"), "n_files", "n_bytes")


@query(
    "nested_table",
    """
    SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 35 ELSE c_nationkey END AS first_age, 30 AS second_age
    FROM customer
    """,
)
def nested_table(spark, sf):
    """A table with an array of structs, filled in SQL, its elements then updated by name."""
    database = _database(spark)
    spark.sql(f"CREATE TABLE {database}.people (id BIGINT, persons ARRAY<STRUCT<name: STRING, age: INT>>) USING parquet")
    spark.sql(
        f"""INSERT INTO {database}.people
            SELECT c_custkey, array(named_struct('name', c_mktsegment, 'age', c_nationkey), named_struct('name', 'Alice', 'age', 30))
            FROM parquet.`{sf}/customer.parquet`"""
    )
    updated = update_by_predicate(F.col("persons"), lambda p: p["name"] == "BUILDING", "age", F.lit(35))
    people = spark.table(f"{database}.people").withColumn("persons", updated)
    age = [F.get("persons", F.lit(i))["age"] for i in (0, 1)]
    return people.select("id", age[0].alias("first_age"), age[1].alias("second_age"))


@query(
    "table_set_to_parquet",
    """
    SELECT 'customer' AS name, 'written' AS outcome, 'c_custkey, c_acctbal' AS columns, count(*) AS n FROM customer
    UNION ALL SELECT 'nation', 'skipped: no path', NULL, NULL
    UNION ALL SELECT 'orders', 'written', 'o_orderkey, o_custkey', count(*) FROM orders
    """,
)
def table_set_to_parquet(spark, sf):
    from pyspark.sql.types import StructType

    folder = scratch_path(spark, "set")
    frames = {name: table(spark, sf, name) for name in ("customer", "nation", "orders")}
    schemas = {
        "customer": StructType.fromDDL("c_custkey bigint, c_acctbal double, c_mktsegment string"),
        "nation": StructType.fromDDL("n_nationkey int"),
        "orders": StructType.fromDDL("o_orderkey string, o_custkey string"),
    }
    paths = {name: f"{folder}/{name}" for name in ("customer", "orders")}
    report = writers.table_set_to_parquet(spark, frames, schemas, paths, {"customer": "c_mktsegment"})
    written = []
    for name, path in paths.items():
        rows = spark.read.parquet(path)
        written.append(
            rows.agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(name).alias("name"), F.lit(", ".join(rows.columns)).alias("columns"), "n"
            )
        )
    return report.join(written[0].unionByName(written[1]), "name", "left")


@query(
    "unload_tables",
    "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem",
)
def unload_tables(spark, sf):
    folder = scratch_path(spark, "unload")
    names = writers.unload(spark, {n: table(spark, sf, n) for n in ("nation", "orders", "lineitem")}, folder)
    counts = [
        spark.read.parquet(f"{folder}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        for n in names
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- ingest -----------------------------------------------------------------


def _inbound(spark, sf):
    """Metadata for five files: two good, one reordered, one with NULL partitions, one without its table."""
    database, folder = _database(spark), scratch_path(spark, "inbound")
    spark.sql(f"CREATE TABLE {database}.orders ({_ORDER_DDL}) USING parquet")
    orders = _orders(spark, sf)
    done, other = orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus <> 'F'")
    writers.write_csv(done, f"{folder}/done.csv")
    writers.write_json(other, f"{folder}/other.json")
    writers.write_csv(done.select(*reversed(_ORDER_COLUMNS)), f"{folder}/reordered.csv")
    status = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus"))
    writers.write_json(other.withColumn("o_orderstatus", status), f"{folder}/nulls.json")
    entries = [
        {
            "csv_file_path": f"{folder}/{name}",
            "table_name": known,
            "database_name": database,
            "hdfs_base_path": f"{folder}/table",
            "partition_column": "o_orderstatus",
        }
        for name, known in (
            ("done.csv", "orders"),
            ("reordered.csv", "orders"),
            ("nulls.json", "orders"),
            ("missing.csv", "absent"),
            ("other.json", "orders"),
        )
    ]
    metadata = spark.createDataFrame([(json.dumps({"files": entries}),)], "value string")
    metadata.write.text(f"{folder}/metadata")
    return folder


@query("ingest_partitioned", _ORDERS)
def ingest_partitioned(spark, sf):
    folder = _inbound(spark, sf)
    ingest_job.ingest(spark, f"{folder}/metadata")
    return spark.read.schema(_ORDER_DDL).parquet(f"{folder}/table")


@query(
    "job_ingest",
    """
    SELECT 'done.csv' AS file, 'ok' AS status, count(*) AS n_rows, count(DISTINCT o_orderstatus) AS n_partitions FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'other.json', 'ok', count(*), count(DISTINCT o_orderstatus) FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'reordered.csv', 'refused', NULL, NULL
    UNION ALL SELECT 'nulls.json', 'refused', NULL, NULL
    UNION ALL SELECT 'missing.csv', 'error', NULL, NULL
    """,
)
def job_ingest(spark, sf):
    status = ingest_job.ingest(spark, f"{_inbound(spark, sf)}/metadata")
    return status.select(F.element_at(F.split("file", "/"), -1).alias("file"), "status", "n_rows", "n_partitions")
