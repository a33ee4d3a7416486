"""Data-quality checks and reconciliation of a table with an altered copy of itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, reconcile
from ..scratch import scratch_path
from ..sinks.writers import write_csv
from .registry import query, table

# --- checks -----------------------------------------------------------------


def _customers(spark, sf):
    return table(spark, sf, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))


@query(
    "partition_check",
    """
    SELECT 'structure' AS suite, 'partition_column' AS "check",
           CASE WHEN count(*) = count(nullif(c_mktsegment, 'BUILDING')) THEN 'passed' ELSE 'failed' END AS outcome,
           'nulls=' || (count(*) - count(nullif(c_mktsegment, 'BUILDING'))) || ' rows=' || count(*) AS evidence
    FROM customer
    """,
)
def partition_check(spark, sf):
    return quality.partition_check(_customers(spark, sf), "segment")


@query(
    "structure_check",
    """
    SELECT 'structure' AS suite, 'file_structure' AS "check", 'passed' AS outcome,
           'all_null_columns=1 rows=' || count(*) AS evidence FROM customer
    """,
)
def structure_check(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("remark"))
    return quality.structure_check(customers)


@query(
    "expected_value_check",
    """
    SELECT 'validation' AS suite, 'expected_value' AS "check",
           CASE WHEN count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) > 0 THEN 'passed' ELSE 'failed' END AS outcome,
           'eligible=' || count(*) || ' matching=' || count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS evidence
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 25 AND c_mktsegment = 'BUILDING'
    """,
)
def expected_value_check(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    conditions = [F.col("c_acctbal") > 25, F.col("c_mktsegment") == "BUILDING"]
    return quality.expected_value_check(customers, orders, ["c_custkey"], conditions, "o_orderpriority", "1-URGENT")


_ALLOWED = ["AUTOMOBILE", "BUILDING", "FURNITURE"]


@query(
    "allowed_values_check",
    """
    SELECT 'validation' AS suite, 'allowed_values' AS "check",
           CASE WHEN sum(bad) = 0 THEN 'passed' ELSE 'failed' END AS outcome,
           'bad=' || sum(bad) || ' rows=' || count(*) AS evidence
    FROM (SELECT CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 1 ELSE 0 END AS bad FROM customer)
    UNION ALL
    SELECT 'validation', 'implication', CASE WHEN sum(bad) = 0 THEN 'passed' ELSE 'failed' END,
           'bad=' || sum(bad) || ' rows=' || count(*)
    FROM (SELECT CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') AND NOT c_acctbal >= -1000 THEN 1 ELSE 0 END AS bad FROM customer)
    """,
)
def allowed_values_check(spark, sf):
    customers = table(spark, sf, "customer")
    return quality.check_results(
        quality.allowed_values_check(customers, "c_mktsegment", _ALLOWED),
        quality.implication_check(customers, "c_mktsegment", _ALLOWED, F.col("c_acctbal") >= -1000),
    )


@query(
    "disallowed_rows",
    """
    SELECT c_custkey, c_mktsegment, 'not allowed' AS reason FROM customer
    WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')
    UNION ALL SELECT c_custkey, c_mktsegment, 'balance below zero' FROM customer
    WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') AND c_acctbal < 0
    """,
)
def disallowed_rows(spark, sf):
    customers = table(spark, sf, "customer")
    other = quality.disallowed_rows(customers, "c_mktsegment", _ALLOWED).withColumn("reason", F.lit("not allowed"))
    below = quality.broken_implication_rows(customers, "c_mktsegment", _ALLOWED, F.col("c_acctbal") >= 0)
    both = other.unionByName(below.withColumn("reason", F.lit("balance below zero")))
    return both.select("c_custkey", "c_mktsegment", "reason")


@query(
    "non_empty_check",
    """
    SELECT 'tables' AS suite, 'non_empty:orders' AS "check", 'passed' AS outcome, 'rows=' || count(*) AS evidence FROM orders
    UNION ALL SELECT 'tables', 'non_empty:large_orders', CASE WHEN count(*) > 0 THEN 'passed' ELSE 'failed' END,
                     'rows=' || count(*) FROM orders WHERE o_totalprice > 1e9
    """,
)
def non_empty_check(spark, sf):
    orders = table(spark, sf, "orders")
    return quality.check_results(
        quality.non_empty_check(orders, "orders"),
        quality.non_empty_check(orders.where("o_totalprice > 1e9"), "large_orders"),
    )


@query(
    "evidence_sample",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE ('0x' || substr(md5('evidence:' || o_orderkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.1
    """,
)
def evidence_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return quality.evidence_sample(orders, ["o_orderkey"])


# --- a table against its altered copy ---------------------------------------

_SIDES = """
    WITH l AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer),
         r AS (SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment,
                      CASE WHEN c_acctbal < -500 THEN NULL ELSE c_acctbal END AS c_acctbal
               FROM customer WHERE c_acctbal <= 9000
               UNION ALL SELECT -1 - c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal > 9500)
"""


def _sides(spark, sf):
    """Customers, and a copy where debtors are changed, the richest removed and some new keys added."""
    left = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    debtor = F.col("c_acctbal") < 0
    changed = left.where("c_acctbal <= 9000").withColumns(
        {
            "c_mktsegment": F.when(debtor, F.lit("CHANGED")).otherwise(F.col("c_mktsegment")),
            "c_acctbal": F.when(F.col("c_acctbal") >= -500, F.col("c_acctbal")),
        }
    )
    added = left.where("c_acctbal > 9500").withColumn("c_custkey", F.lit(-1) - F.col("c_custkey"))
    return left, changed.unionByName(added)


_ONLY = """
    , a AS (SELECT * FROM l EXCEPT ALL SELECT * FROM r), b AS (SELECT * FROM r EXCEPT ALL SELECT * FROM l),
    n AS (SELECT (SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM r) AS right_rows,
                 (SELECT count(*) FROM a) AS left_only, (SELECT count(*) FROM b) AS right_only)
"""


@query(
    "table_equality",
    f"""
    {_SIDES} {_ONLY}
    SELECT 'customer' AS name, 'Do Not Match' AS result, left_rows, right_rows, left_only + right_only AS mismatches FROM n
    UNION ALL SELECT 'same', 'Match', left_rows, left_rows, 0 FROM n
    UNION ALL SELECT 'types', 'Do Not Match', left_rows, left_rows, NULL FROM n
    """,
)
def table_equality(spark, sf):
    left, right = _sides(spark, sf)
    retyped = left.withColumn("c_custkey", F.col("c_custkey").cast("string"))
    return (
        reconcile.table_equality(left, right, "customer")
        .unionByName(reconcile.table_equality(left, left, "same"))
        .unionByName(reconcile.table_equality(left, retyped, "types"))
    )


@query(
    "row_diff",
    f"""
    {_SIDES} {_ONLY}
    SELECT *, 'left' AS side, count(*) AS copies FROM a GROUP BY ALL
    UNION ALL SELECT *, 'right' AS side, count(*) FROM b GROUP BY ALL
    """,
)
def row_diff(spark, sf):
    return reconcile.row_diff(*_sides(spark, sf))


@query(
    "row_diff_shown",
    f"""
    {_SIDES} {_ONLY}
    SELECT *, 'left' AS side, count(*) AS copies FROM a GROUP BY ALL ORDER BY c_custkey LIMIT 10
    """,
)
def row_diff_shown(spark, sf):
    return reconcile.row_diff_shown(*_sides(spark, sf))


@query("row_diff_summary", f"{_SIDES} {_ONLY} SELECT *, left_only + right_only AS mismatches FROM n")
def row_diff_summary(spark, sf):
    return reconcile.row_diff_summary(*_sides(spark, sf))


@query(
    "cell_diff",
    f"""
    {_SIDES}
    SELECT c_custkey, 'c_mktsegment' AS "column", l.c_mktsegment AS left_value, r.c_mktsegment AS right_value
    FROM l JOIN r USING (c_custkey) WHERE l.c_mktsegment IS DISTINCT FROM r.c_mktsegment
    UNION ALL SELECT c_custkey, 'c_acctbal', CAST(l.c_acctbal AS VARCHAR), CAST(r.c_acctbal AS VARCHAR)
    FROM l JOIN r USING (c_custkey) WHERE l.c_acctbal IS DISTINCT FROM r.c_acctbal
    """,
)
def cell_diff(spark, sf):
    return reconcile.cell_diff(*_sides(spark, sf), ["c_custkey"])


@query(
    "column_mismatch_count",
    f"""
    {_SIDES} SELECT count(*) AS mismatch_count FROM l JOIN r USING (c_custkey)
    WHERE l.c_mktsegment IS DISTINCT FROM r.c_mktsegment
    """,
)
def column_mismatch_count(spark, sf):
    return reconcile.column_mismatch_count(*_sides(spark, sf), ["c_custkey"], "c_mktsegment")


_ORDERED = """
    WITH l AS (SELECT row_number() OVER (ORDER BY c_custkey) AS position, c_custkey AS k, c_mktsegment AS s FROM customer),
         r AS (SELECT row_number() OVER (ORDER BY c_custkey) AS position, c_custkey AS k,
                      CASE WHEN c_acctbal < 0 THEN 'CHANGED' ELSE c_mktsegment END AS s FROM customer),
         d AS (SELECT count(*) AS differing FROM l JOIN r USING (position) WHERE (l.k, l.s) IS DISTINCT FROM (r.k, r.s)),
         n AS (SELECT count(*) AS rows, count(CASE WHEN c_acctbal <= 9000 THEN 1 END) AS fewer FROM customer)
"""


def _ordered_sides(spark, sf):
    customers = table(spark, sf, "customer")
    left = customers.select("c_custkey", "c_mktsegment")
    segment = F.when(F.col("c_acctbal") < 0, F.lit("CHANGED")).otherwise(F.col("c_mktsegment"))
    right = customers.select("c_custkey", segment.alias("c_mktsegment"))
    shorter = customers.where("c_acctbal <= 9000").select("c_custkey", "c_mktsegment")
    return left, right, shorter


@query(
    "ordered_compare",
    f"""
    {_ORDERED}
    SELECT 'same' AS run, 'Success' AS verdict, rows AS source_rows, rows AS target_rows, 0 AS differing FROM n
    UNION ALL SELECT 'changed', 'Failure', rows, rows, differing FROM n, d
    UNION ALL SELECT 'shorter', 'Failure: Mismatched number of records (Source: ' || rows || ', Target: ' || fewer || ')',
                     rows, fewer, NULL FROM n
    """,
)
def ordered_compare(spark, sf):
    left, right, shorter = _ordered_sides(spark, sf)
    order = ["c_custkey"]
    runs = {"same": left, "changed": right, "shorter": shorter}
    lines = [
        reconcile.ordered_compare(left, other, order, order).select(F.lit(run).alias("run"), "*")
        for run, other in runs.items()
    ]
    return lines[0].unionByName(lines[1]).unionByName(lines[2])


@query(
    "ordered_diff",
    """
    WITH l AS (SELECT row_number() OVER (ORDER BY c_custkey) AS position, c_custkey AS k FROM customer),
         r AS (SELECT row_number() OVER (ORDER BY c_custkey) AS position, c_custkey AS k FROM customer WHERE c_acctbal <= 9000)
    SELECT position, CASE WHEN r.k IS NULL THEN 'source only' ELSE 'differs' END AS status,
           '{"c0":' || l.k || '}' AS source_row, CASE WHEN r.k IS NOT NULL THEN '{"c0":' || r.k || '}' END AS target_row
    FROM l LEFT JOIN r USING (position) WHERE l.k IS DISTINCT FROM r.k
    """,
)
def ordered_diff(spark, sf):
    left, _, shorter = _ordered_sides(spark, sf)
    return reconcile.ordered_diff(left.select("c_custkey"), shorter.select("c_custkey"), ["c_custkey"], ["c_custkey"])


@query(
    "schema_diff",
    """
    SELECT * FROM (VALUES (4, 'c_acctbal', 'double', 'c_acctbal', 'float'), (5, NULL, NULL, 'extra', 'int'))
      AS t(position, left_name, left_type, right_name, right_type)
    """,
)
def schema_diff(spark, sf):
    left, right = _sides(spark, sf)
    return reconcile.schema_diff(left, right.withColumn("c_acctbal", F.col("c_acctbal").cast("float")).withColumn("extra", F.lit(1)))


@query(
    "table_set_report",
    f"""
    {_SIDES} {_ONLY}
    SELECT 'customer' AS name, 'Do Not Match' AS result, left_rows, right_rows, left_only + right_only AS mismatches FROM n
    UNION ALL SELECT 'nation', 'Match', count(*), count(*), 0 FROM nation
    UNION ALL SELECT 'orders', 'Missing in left', NULL, count(*), NULL FROM orders
    UNION ALL SELECT 'region', 'Missing in right', count(*), NULL, NULL FROM region
    """,
)
def table_set_report(spark, sf):
    left, right = _sides(spark, sf)
    nation = table(spark, sf, "nation")
    first = {"customer": left, "nation": nation, "region": table(spark, sf, "region")}
    second = {"customer": right, "nation": nation, "orders": table(spark, sf, "orders")}
    return reconcile.table_set_report(first, second)


@query(
    "mixed_source_compare",
    """
    SELECT count(*) AS left_rows, count(*) AS right_rows, 0::BIGINT AS left_only, 0::BIGINT AS right_only, 0::BIGINT AS mismatches
    FROM customer
    """,
)
def mixed_source_compare(spark, sf):
    """A SQL query over a view against a CSV file with its columns in another order."""
    customers = table(spark, sf, "customer").select("c_name", "c_custkey")
    customers.createOrReplaceTempView("tallyforge_customers")
    path = scratch_path(spark, "side")
    write_csv(customers, path)
    source = {"kind": "sql", "query": "SELECT c_custkey, c_name FROM tallyforge_customers"}
    target = {
        "kind": "file",
        "format": "csv",
        "path": path,
        "schema": "c_name string, c_custkey bigint",
        "options": {"header": True, "enforceSchema": False},
    }
    return reconcile.compare_sides(spark, source, target)


@query(
    "check_results",
    f"""
    {_SIDES} {_ONLY}
    , res AS (SELECT CASE WHEN count(*) > 0 THEN 'passed' ELSE 'failed' END AS outcome FROM orders
              UNION ALL SELECT CASE WHEN count(*) = count(nullif(c_mktsegment, 'BUILDING')) THEN 'passed' ELSE 'failed' END FROM customer
              UNION ALL SELECT CASE WHEN left_only + right_only = 0 THEN 'passed' ELSE 'failed' END FROM n)
    SELECT outcome, count(*) AS n FROM res GROUP BY 1
    """,
)
def check_results(spark, sf):
    equality = reconcile.table_equality(*_sides(spark, sf), "customer")
    results = quality.check_results(
        quality.non_empty_check(table(spark, sf, "orders"), "orders"),
        quality.partition_check(_customers(spark, sf), "segment"),
        reconcile.as_check(equality),
    )
    return quality.check_totals(results)
