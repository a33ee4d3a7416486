"""Projections, predicates, struct edits and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rule_index, rules, shape
from ..scratch import scratch_path
from ..sources.readers import inline_rows
from .registry import query, table


@query(
    "const_cols",
    "SELECT c_custkey, CAST(1 AS BIGINT) AS exp1, 'fixed' AS c_name FROM customer",
)
def const_cols(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return shape.with_constants(customers, {"exp1": (1, "bigint"), "c_name": ("fixed", "string")})


@query(
    "yes_no_flag",
    "SELECT c_custkey, CASE WHEN nullif(c_mktsegment, 'MACHINERY') = 'BUILDING' THEN 'YES' ELSE 'NO' END AS flag FROM customer",
)
def yes_no_flag(spark, sf):
    segment = F.nullif("c_mktsegment", F.lit("MACHINERY"))
    return table(spark, sf, "customer").select("c_custkey", shape.yes_no(segment == "BUILDING").alias("flag"))


@query(
    "conditional_update",
    """
    SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'HOME' ELSE c_mktsegment END AS c_mktsegment
    FROM customer
    """,
)
def conditional_update(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    hit = F.col("c_mktsegment").isin("BUILDING", "FURNITURE")
    return shape.update_where(customers, "c_mktsegment", hit, F.lit("HOME"))


@query(
    "cast_columns",
    """
    SELECT l_orderkey, l_linenumber, l_returnflag,
           CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(12,0)) AS BIGINT) AS l_extendedprice,
           CAST(NULL AS BIGINT) AS l_linestatus
    FROM lineitem
    """,
)
def cast_columns(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("l_extendedprice"),
        "l_linestatus",
    )
    typed = shape.cast_all_but(lines, ["l_orderkey", "l_linenumber", "l_returnflag"])
    whole = [F.col(c).cast("bigint").alias(c) for c in ("l_extendedprice", "l_linestatus")]
    return typed.select("l_orderkey", "l_linenumber", "l_returnflag", *whole)


@query("lowercase_cols", "SELECT c_custkey AS customerid, c_name AS customername FROM customer")
def lowercase_cols(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("CustomerID"), F.col("c_name").alias("CustomerNAME")
    )
    return shape.lowercase_columns(customers)


@query("strip_prefix", "SELECT c_custkey AS customerid, c_name AS name, c_acctbal FROM customer")
def strip_prefix(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("t.customerid"), F.col("c_name").alias("t.name.text"), "c_acctbal"
    )
    return shape.strip_prefix(customers)


@query("drop_cols", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def drop_cols(spark, sf):
    return shape.drop_columns(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment", "run_date")


@query("keep_cols", "SELECT c_custkey, c_name FROM customer")
def keep_cols(spark, sf):
    return shape.keep_columns(table(spark, sf, "customer"), "c_name", "c_custkey", "run_date")


@query(
    "filters",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
    WHERE l_quantity > 30 AND (l_linestatus = 'O') = true AND l_returnflag IN ('A', 'R')
      AND l_linenumber NOT IN (2, 3) AND l_shipdate >= TIMESTAMP '1998-01-01'
    """,
)
def filters(spark, sf):
    conditions = [
        F.col("l_quantity") > 30,
        (F.col("l_linestatus") == "O") == F.lit(True),
        F.col("l_returnflag").isin("A", "R"),
        ~F.col("l_linenumber").isin(2, 3),
        F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"),
    ]
    chosen = table(spark, sf, "lineitem").where(shape.all_of(conditions))
    return chosen.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "fill_nulls",
    """
    SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_nationkey END, 0) AS a,
           CASE WHEN c_acctbal < 5000 THEN c_nationkey END AS b FROM customer
    """,
)
def fill_nulls(spark, sf):
    customers = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("a"),
        F.when(F.col("c_acctbal") < 5000, F.col("c_nationkey")).alias("b"),
    )
    return shape.fill_nulls(customers, ["a"])


@query(
    "sentinel_fix",
    """
    SELECT c_custkey, CASE WHEN s = 'NULL' THEN 'none' ELSE s END AS only_text,
           CASE WHEN s = 'NULL' OR s IS NULL THEN 'none' ELSE s END AS with_null
    FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'NULL' WHEN 'MACHINERY' THEN NULL
                                 ELSE c_mktsegment END AS s FROM customer)
    """,
)
def sentinel_fix(spark, sf):
    segment = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("NULL"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit(None))
        .otherwise(F.col("c_mktsegment"))
    )
    customers = table(spark, sf, "customer").select("c_custkey", segment.alias("s"))
    return customers.select(
        "c_custkey",
        shape.replace_sentinel(F.col("s"), F.lit("none")).alias("only_text"),
        shape.replace_sentinel(F.col("s"), F.lit("none"), also_null=True).alias("with_null"),
    )


@query("pack_struct", "SELECT c_custkey, c_custkey AS inner_key, c_acctbal AS inner_balance FROM customer")
def pack_struct(spark, sf):
    packed = shape.pack_struct(table(spark, sf, "customer"), "exp3", ["c_custkey", "c_acctbal"])
    return packed.select(
        "c_custkey", F.col("exp3.c_custkey").alias("inner_key"), F.col("exp3.c_acctbal").alias("inner_balance")
    )


@query("struct_field_update", "SELECT c_custkey, c_name AS name, c_nationkey + 10 AS age FROM customer")
def struct_field_update(spark, sf):
    customers = table(spark, sf, "customer").select(
        "c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("age")).alias("details")
    )
    return shape.add_to_field(customers, "details", "age", 10).select("c_custkey", "details.*")


@query(
    "swap_codes",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE l_returnflag WHEN 'A' THEN 'R' WHEN 'R' THEN 'A' END AS swapped FROM lineitem
    """,
)
def swap_codes(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", shape.swap_codes(F.col("l_returnflag"), "A", "R").alias("swapped")
    )


@query(
    "accept_reject",
    """
    SELECT c_custkey, c_mktsegment, coalesce(nullif(c_mktsegment, 'MACHINERY') <> 'BUILDING', false) AS accepted
    FROM customer
    """,
)
def accept_reject(spark, sf):
    """Both outputs put together again with their side: every row is on exactly one."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    accepted, rejected = shape.accept_reject(customers, F.nullif("c_mktsegment", F.lit("MACHINERY")) != "BUILDING")
    return accepted.withColumn("accepted", F.lit(True)).unionByName(rejected.withColumn("accepted", F.lit(False)))


_FILTER_RULES = [
    {"column": "l_quantity", "condition": ">", "value": 30},
    {"column": "l_extendedprice", "condition": "<=", "value": 50000},
    {"column": "l_returnflag", "condition": "!=", "value": "N"},
    {"column": "l_linestatus", "condition": "==", "value": "O"},
]


@query(
    "rule_filter",
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_quantity > 30 AND l_extendedprice <= 50000 AND l_returnflag <> 'N' AND l_linestatus = 'O'
    """,
)
def rule_filter(spark, sf):
    lines = table(spark, sf, "lineitem").where(rules.rule_filter(_FILTER_RULES))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey")


_MATCH_COLUMNS = ["l_linenumber", "l_quantity", "l_returnflag", "l_discount"]
_MATCH_RULES = [
    ("x == 1", "x > 10 and x <= 20", "any", "any", "first small"),
    ("x >= 2", "any", "x == 'A' or x == 'R'", "x < 0.05", "low discount"),
    ("any", "x < 5 or x > 45", "any", "any", "edge"),
    ("x != 7", "any", "x != 'N'", "any", "other"),
]


_FIRST_MATCH = """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE
        WHEN l_linenumber = 1 AND l_quantity > 10 AND l_quantity <= 20 THEN 'first small'
        WHEN l_linenumber >= 2 AND l_returnflag IN ('A', 'R') AND l_discount < 0.05 THEN 'low discount'
        WHEN l_quantity < 5 OR l_quantity > 45 THEN 'edge'
        WHEN l_linenumber <> 7 AND l_returnflag <> 'N' THEN 'other' END AS expected_value
    FROM lineitem
"""


@query("rule_first_match", _FIRST_MATCH)
def rule_first_match(spark, sf):
    names = [*_MATCH_COLUMNS, "expected_value"]
    lines = table(spark, sf, "lineitem")
    value = rules.first_match(lines, [dict(zip(names, r)) for r in _MATCH_RULES], _MATCH_COLUMNS)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", value.alias("expected_value"))


@query("rule_file_first_match", _FIRST_MATCH)
def rule_file_first_match(spark, sf):
    """The same rules, read from a CSV rule file with an order column."""
    names = [*_MATCH_COLUMNS, "expected_value"]
    path = scratch_path(spark, "rules")
    rows = [(i, *r) for i, r in enumerate(_MATCH_RULES)]
    written = inline_rows(spark, rows, ", ".join(["rule_no int", *[f"{n} string" for n in names]]))
    written.coalesce(1).write.option("header", True).csv(path)
    read = spark.read.schema(written.schema).option("header", True).csv(path)
    lines = table(spark, sf, "lineitem")
    value = rules.first_match(lines, rules.load_rules(read, "rule_no"), _MATCH_COLUMNS)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", value.alias("expected_value"))


_TABLE_COLUMNS = ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]


def _table_rules(spark, sf):
    """A rule for each part, supplier and nation: more rules than one expression holds on large tables."""
    parts = table(spark, sf, "part").select(
        (F.col("p_partkey") * 2).alias("no"), F.format_string("x == %d", "p_partkey").alias("l_partkey"), F.lit("any").alias("l_suppkey"),
        F.format_string("x > %d", "p_size").alias("l_quantity"), F.lit("any").alias("l_returnflag"), F.col("p_brand").alias("expected_value"),
    )
    suppliers = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 2 + 1).alias("no"), F.lit("any").alias("l_partkey"), F.format_string("x == %d", "s_suppkey").alias("l_suppkey"),
        F.lit("any").alias("l_quantity"), F.lit("x == 'R' or x == 'A'").alias("l_returnflag"), F.col("s_name").alias("expected_value"),
    )
    nations = table(spark, sf, "nation").select(
        (F.col("n_nationkey") + 1_000_000_000_000).alias("no"), F.lit("any").alias("l_partkey"), F.lit("any").alias("l_suppkey"),
        F.format_string("x > %d and x <= %d.5", "n_nationkey", F.col("n_nationkey") + 1).alias("l_quantity"), F.lit("any").alias("l_returnflag"),
        F.col("n_name").alias("expected_value"),
    )
    return parts.unionByName(suppliers).unionByName(nations)


@query(
    "rule_table_first_match",
    """
    WITH l AS (SELECT *, row_number() OVER () AS r FROM lineitem), hits AS (
        SELECT r, 2 * p_partkey AS no, p_brand AS v FROM l JOIN part ON l_partkey = p_partkey AND l_quantity > p_size
        UNION ALL SELECT r, 2 * s_suppkey + 1, s_name FROM l JOIN supplier ON l_suppkey = s_suppkey AND l_returnflag IN ('R', 'A')
        UNION ALL SELECT r, n_nationkey + 1000000000000, n_name FROM l JOIN nation ON l_quantity > n_nationkey AND l_quantity <= n_nationkey + 1.5
    ), best AS (SELECT r, min_by(v, no) AS expected_value FROM hits GROUP BY r)
    SELECT l_orderkey, l_linenumber, l_partkey, expected_value FROM l LEFT JOIN best USING (r)
    """,
)
def rule_table_first_match(spark, sf):
    lines = table(spark, sf, "lineitem")
    found = rule_index.match_rules(lines, _table_rules(spark, sf), _TABLE_COLUMNS, "no")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "expected_value")


@query(
    "row_score",
    """
    SELECT l_orderkey, l_linenumber,
           CAST(l_orderkey + l_partkey + l_suppkey + l_linenumber + CAST(l_quantity AS BIGINT) + year(l_shipdate)
                + month(l_shipdate) AS BIGINT) AS score
    FROM lineitem
    """,
)
def row_score(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("a"),
        F.col("l_partkey").alias("b"),
        F.col("l_suppkey").alias("c"),
        F.col("l_linenumber").alias("d"),
        F.col("l_quantity").alias("e"),
        F.year("l_shipdate").alias("f"),
        F.month("l_shipdate").alias("g"),
    )
    return lines.select(
        F.col("a").alias("l_orderkey"), F.col("d").alias("l_linenumber"), shape.row_score(list("abcdefg")).alias("score")
    )
