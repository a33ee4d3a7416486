"""Aggregates, windows, ordering and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import ordering as order
from ..operators.shape import cast_column, yes_no
from .registry import query, table


@query(
    "flag_sum",
    """
    SELECT CASE WHEN event_type = 'error' THEN 'YES' ELSE 'NO' END AS is_error,
           CAST(sum(CAST(CAST(value AS FLOAT) AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM events GROUP BY 1
    """,
)
def flag_sum(spark, sf):
    events = table(spark, sf, "events").select("event_type", F.col("value").cast("string").alias("value"))
    flagged = cast_column(events, "value", "float").withColumn("is_error", yes_no(F.col("event_type") == "error"))
    return agg.sum_by(flagged, ["is_error"], "value", "total", scale=2)


@query(
    "distinct_users_by_type",
    """
    SELECT event_type, count(DISTINCT user_id) AS n_users
    FROM events GROUP BY event_type ORDER BY n_users DESC, event_type
    """,
)
def distinct_users_by_type(spark, sf):
    counted = agg.distinct_count_by(table(spark, sf, "events"), ["event_type"], "user_id", "n_users")
    return counted.orderBy(F.col("n_users").desc(), "event_type")


@query(
    "bucket_counts",
    """
    SELECT CASE WHEN k BETWEEN 0 AND 2499999999 THEN 0
                WHEN k BETWEEN 2500000000 AND 3999999999 THEN 1
                WHEN k BETWEEN 4000000000 AND 5499999999 THEN 2
                WHEN k BETWEEN 5500000000 AND 6999999999 THEN 3
                WHEN k BETWEEN 7000000000 AND 8499999999 THEN 4
                ELSE 5 END AS customer_split,
           count(*) AS customer_count
    FROM (SELECT c_custkey * 7000000 AS k FROM customer) GROUP BY 1
    """,
)
def bucket_counts(spark, sf):
    return agg.bucket_counts(table(spark, sf, "customer"), F.col("c_custkey") * F.lit(7000000))


@query(
    "duplicate_keys",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    return agg.duplicate_keys(table(spark, sf, "orders"), ["o_custkey"])


_CREDIT_DEBIT = """
    CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS credit,
    CAST(coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS debit
"""


def _transactions(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "F", F.lit("c")).otherwise(F.lit("d"))
    return table(spark, sf, "orders").select("o_custkey", kind.alias("type"), F.col("o_totalprice").alias("amount"))


@query("credit_debit_by_customer", f"SELECT o_custkey, {_CREDIT_DEBIT} FROM orders GROUP BY o_custkey")
def credit_debit_by_customer(spark, sf):
    types = {"c": "credit", "d": "debit"}
    return agg.totals_by_type(_transactions(spark, sf), F.col("type"), F.col("amount"), types, ["o_custkey"], scale=2)


@query("credit_debit_total", f"SELECT {_CREDIT_DEBIT} FROM orders")
def credit_debit_total(spark, sf):
    types = {"c": "credit", "d": "debit"}
    return agg.totals_by_type(_transactions(spark, sf), F.col("type"), F.col("amount"), types, scale=2)


@query(
    "group_list",
    """
    SELECT c_nationkey, 0::BIGINT AS chunk, string_agg(c_name, ', ' ORDER BY c_name) AS names
    FROM customer GROUP BY 1
    """,
)
def group_list(spark, sf):
    customers = table(spark, sf, "customer")
    return agg.group_list(customers, ["c_nationkey"], "c_name", "names", tie_break=["c_custkey"])


@query(
    "group_list_distinct",
    """
    SELECT c_mktsegment, 0::BIGINT AS chunk, string_agg(n_name, ', ' ORDER BY n_name) AS nations
    FROM (SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
    GROUP BY 1
    """,
)
def group_list_distinct(spark, sf):
    pairs = (
        table(spark, sf, "customer")
        .select("c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
        .distinct()
        .join(table(spark, sf, "nation"), "n_nationkey")
        .select("c_mktsegment", "n_name")
        .distinct()
    )
    return agg.group_list(pairs, ["c_mktsegment"], "n_name", "nations")


@query(
    "argmax_in_group",
    """
    SELECT c_nationkey, c_name AS richest FROM (
      SELECT c_nationkey, c_name,
             row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name DESC) AS rn FROM customer)
    WHERE rn = 1
    """,
)
def argmax_in_group(spark, sf):
    return agg.value_at_max(table(spark, sf, "customer"), ["c_nationkey"], "c_name", "c_acctbal", "richest")


@query("count_on_empty", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 1e12")
def count_on_empty(spark, sf):
    return agg.row_count(table(spark, sf, "customer").where("c_acctbal > 1e12"))


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf):
    return agg.row_count(table(spark, sf, "lineitem"))


@query("distinct_values", "SELECT DISTINCT l_suppkey FROM lineitem")
def distinct_values(spark, sf):
    return agg.distinct_values(table(spark, sf, "lineitem"), "l_suppkey")


@query(
    "null_profile",
    """
    WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, CAST(NULL AS VARCHAR) AS remark FROM customer)
    SELECT 'c_custkey' AS "column", count(*) - count(c_custkey) AS nulls, count(*) AS rows, count(c_custkey) = 0 AS all_null FROM c
    UNION ALL SELECT 'segment', count(*) - count(segment), count(*), count(segment) = 0 FROM c
    UNION ALL SELECT 'remark', count(*) - count(remark), count(*), count(remark) = 0 FROM c
    """,
)
def null_profile(spark, sf):
    customers = table(spark, sf, "customer").select(
        "c_custkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.lit(None).cast("string").alias("remark"),
    )
    return agg.null_profile(customers)


@query("all_columns_null", "SELECT count(c_custkey) + count(c_name) = 0 AS all_null FROM customer")
def all_columns_null(spark, sf):
    return agg.all_columns_null(table(spark, sf, "customer").select("c_custkey", "c_name"))


@query("column_sum", "SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem")
def column_sum(spark, sf):
    whole = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("bigint").alias("l_quantity"))
    return agg.column_sum(whole, "l_quantity", "total")


@query(
    "sum_small_fractions",
    """
    SELECT event_type, CAST(sum(CAST(value / 1000 AS DECIMAL(28,5))) AS DOUBLE) AS total,
           sum(CAST(event_id AS DECIMAL(38,0)) * 100000000000)::DECIMAL(38,0)::DOUBLE AS large_total
    FROM events GROUP BY event_type
    """,
)
def sum_small_fractions(spark, sf):
    """Five decimals, and values far beyond eighteen digits of cents."""
    scaled = table(spark, sf, "events").select(
        "event_type",
        (F.col("value") / 1000).alias("small"),
        (F.col("event_id").cast("decimal(20,0)") * F.lit(100000000000)).alias("large"),
    )
    small = agg.sum_by(scaled, ["event_type"], "small", "total", scale=5)
    large = agg.sum_by(scaled, ["event_type"], "large", "large_total")
    return small.join(large.withColumn("large_total", F.col("large_total").cast("double")), "event_type")


@query(
    "first_per_group",
    """
    SELECT status_code, o_custkey, o_orderkey, o_totalprice, CAST(row_number AS INTEGER) AS row_number FROM (
      SELECT o_orderstatus AS status_code, o_custkey, o_orderkey, o_totalprice,
             row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS row_number FROM orders)
    WHERE row_number = 1
    """,
)
def first_per_group(spark, sf):
    orders = table(spark, sf, "orders").withColumn(
        "attributes", F.array(F.struct(F.col("o_orderpriority").alias("value")), F.struct(F.col("o_orderstatus").alias("value")))
    )
    key = F.get("attributes", F.lit(1))["value"]
    first = order.first_per_group(orders, [key], ["o_totalprice", "o_orderkey"], keep_rank=True)
    return first.select(key.alias("status_code"), "o_custkey", "o_orderkey", "o_totalprice", "row_number")


_SERIAL = """
    SELECT o_custkey, o_orderkey,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS serial FROM orders
"""


@query("group_serial", _SERIAL)
def group_serial(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return order.group_serial(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "group_serial_large_groups",
    """
    SELECT o_orderstatus, o_orderkey,
           row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS serial FROM orders
    """,
)
def group_serial_large_groups(spark, sf):
    """Three groups hold all orders: every group is split over the range partitions."""
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_orderdate")
    numbered = order.group_serial(orders, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], group_rows=1000)
    return numbered.drop("o_orderdate")


_RUNNING = """
    SELECT {group}, o_orderkey,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER
             (PARTITION BY {group} ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running
    FROM orders
"""


def _running(spark, sf, group, **split):
    orders = table(spark, sf, "orders").select(group, "o_orderkey", "o_orderdate", "o_totalprice")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    total = order.running_total(orders, [group], ["o_orderdate", "o_orderkey"], amount, "running", **split)
    return total.select(group, "o_orderkey", F.col("running").cast("double").alias("running"))


@query("running_total", _RUNNING.format(group="o_custkey"))
def running_total(spark, sf):
    return _running(spark, sf, "o_custkey")


@query("running_total_large_groups", _RUNNING.format(group="o_orderstatus"))
def running_total_large_groups(spark, sf):
    return _running(spark, sf, "o_orderstatus", group_rows=1000)


@query(
    "record_range",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 101 OFFSET 399",
)
def record_range(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return order.record_range(orders, ["o_totalprice", "o_orderkey"], 400, 500)


@query(
    "record_range_long",
    """
    SELECT event_id, ts::VARCHAR AS ts FROM
      (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)
    WHERE rn BETWEEN n // 2 AND 3 * n
    """,
)
def record_range_long(spark, sf):
    """The second half of the records and on past the end, where the range is clipped."""
    events = table(spark, sf, "events").select("event_id", "ts")
    size = events.count()
    found = order.record_range(events, ["ts", "event_id"], size // 2, 3 * size)
    return found.select("event_id", F.col("ts").cast("string").alias("ts"))


@query("nth_record", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 399")
def nth_record(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return order.nth_record(orders, ["o_totalprice", "o_orderkey"], 400)


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return order.top_n(orders, [F.col("o_totalprice").desc(), "o_orderkey"], 10)


@query(
    "dense_serial",
    "SELECT c_custkey, c_name, 1000179 + row_number() OVER (ORDER BY c_custkey) AS customerid FROM customer",
)
def dense_serial(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return order.dense_ordinal(customers, ["c_custkey"], "customerid", 1000180)


@query("sparse_serial", "SELECT count(*) AS n_rows, count(*) AS n_ids, true AS from_start FROM lineitem")
def sparse_serial(spark, sf):
    """Ids with gaps are unique and start at the given number; which row gets which is not fixed."""
    numbered = order.sparse_ordinal(table(spark, sf, "lineitem").select("l_orderkey"), "customerid", 1000180)
    return numbered.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("customerid").alias("n_ids"),
        (F.min("customerid") >= 1000180).alias("from_start"),
    )
