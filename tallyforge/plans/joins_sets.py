"""Joins, lookups, value spaces and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.nested import code_decision, elements_in
from ..operators import joins, sets
from ..sources.readers import inline_rows
from .registry import query, table

# --- key lists --------------------------------------------------------------


@query(
    "semi_by_key_list",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def semi_by_key_list(spark, sf):
    listed = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.keep_listed(table(spark, sf, "customer"), listed, ["c_custkey"]).select("c_custkey", "c_name")


_LEFT_JOIN = """
    SELECT c_custkey, c_name, o_orderkey, o_totalprice
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey
"""


def _left_join(spark, sf, **split):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return joins.left_join(customers, orders, ["c_custkey"], **split)


@query("left_join", _LEFT_JOIN)
def left_join(spark, sf):
    return _left_join(spark, sf)


@query("left_join_large_keys", _LEFT_JOIN)
def left_join_large_keys(spark, sf):
    """The way taken when a right key has too many rows for one task."""
    return _left_join(spark, sf, key_rows=1)


@query(
    "anti_join",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE c_mktsegment = 'BUILDING'
       OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
    """,
)
def anti_join(spark, sf):
    """The key is a field of an array element and may be NULL; NULL keys stay."""
    customers = table(spark, sf, "customer").withColumn(
        "attributes",
        F.array(
            F.struct(F.col("c_nationkey").cast("bigint").alias("value")),
            F.struct(F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey")).alias("value")),
        ),
    )
    listed = table(spark, sf, "orders").where("o_totalprice > 400000")
    key = F.get("attributes", F.lit(1))["value"]
    return joins.not_listed(customers, listed, key, "o_custkey").select("c_custkey", "c_name")


_RICH = "SELECT c_custkey FROM customer WHERE c_acctbal > 0"


@query(
    "extra_ids",
    f"SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN ({_RICH})",
)
def extra_ids(spark, sf):
    known = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey")
    return joins.extra_ids(table(spark, sf, "orders"), "o_custkey", known)


@query(
    "extra_rows",
    f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN ({_RICH})",
)
def extra_rows(spark, sf):
    known = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return joins.extra_rows(orders, "o_custkey", known)


@query(
    "extra_rows_short_list",
    "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')",
)
def extra_rows_short_list(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    return joins.extra_rows(parts, "p_brand", ["Brand#1", "Brand#2", "Brand#3"])


# --- star join --------------------------------------------------------------

_STAR = """
    SELECT a.l_orderkey AS cus_id, a.l_partkey AS sortid, a.l_suppkey AS stg_id, a.l_linenumber,
           a.l_extendedprice, b.o_custkey, c.o_totalprice, d.o_orderpriority, e.part_lines,
           f.s_name, g.s_acctbal, h.s_nationkey
    FROM lineitem a
    JOIN orders b ON a.l_orderkey = b.o_orderkey {b}
    JOIN orders c ON a.l_orderkey = c.o_orderkey {c}
    JOIN orders d ON a.l_orderkey = d.o_orderkey {d}
    LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS part_lines FROM lineitem GROUP BY 1, 2) e
      ON a.l_partkey = e.l_partkey AND a.l_suppkey = e.l_suppkey {e}
    LEFT JOIN supplier f ON a.l_suppkey = f.s_suppkey {f}
    LEFT JOIN supplier g ON a.l_suppkey = g.s_suppkey {g}
    LEFT JOIN supplier h ON a.l_suppkey = h.s_suppkey {h}
    {where}
"""


def _star(spark, sf, active, **limits):
    lines, orders, supplier = (table(spark, sf, n) for n in ("lineitem", "orders", "supplier"))

    def flag(condition):
        return F.expr(condition).cast("int").alias("active")

    base = lines.select(
        F.col("l_orderkey").alias("cus_id"),
        F.col("l_partkey").alias("sortid"),
        F.col("l_suppkey").alias("cus_acc_id"),
        F.col("l_suppkey").alias("stg_id"),
        "l_linenumber",
        "l_extendedprice",
        flag("l_linestatus = 'O'"),
    )
    key = F.col("o_orderkey").alias("cus_id")
    inner = [
        (orders.select(key, "o_custkey", flag("o_orderstatus <> 'P'")), ["cus_id"]),
        (orders.select(key, "o_totalprice", flag("o_totalprice > 50000")), ["cus_id"]),
        (orders.select(key, "o_orderpriority", flag("o_orderpriority <> '5-LOW'")), ["cus_id"]),
    ]
    per_part = lines.groupBy(F.col("l_partkey").alias("sortid"), F.col("l_suppkey").alias("cus_acc_id")).agg(
        F.count(F.lit(1)).alias("part_lines")
    )
    stage = F.col("s_suppkey").alias("stg_id")
    left = [
        (per_part.withColumn("active", (F.col("part_lines") > 1).cast("int")), ["sortid", "cus_acc_id"]),
        (supplier.select(stage, "s_name", flag("s_acctbal > 0")), ["stg_id"]),
        (supplier.select(stage, "s_acctbal", flag("s_nationkey < 20")), ["stg_id"]),
        (supplier.select(stage, "s_nationkey", flag("s_nationkey > 3")), ["stg_id"]),
    ]
    if not active:
        base = base.drop("active")
        inner, left = ([(t.drop("active"), on) for t, on in side] for side in (inner, left))
    joined = joins.star_join(base, inner, left, "active" if active else None, **limits)
    return joined.select(
        "cus_id", "sortid", "stg_id", "l_linenumber", "l_extendedprice", "o_custkey", "o_totalprice",
        "o_orderpriority", "part_lines", "s_name", "s_acctbal", "s_nationkey",
    )


_STAR_ACTIVE = _STAR.format(
    b="AND b.o_orderstatus <> 'P'",
    c="AND c.o_totalprice > 50000",
    d="AND d.o_orderpriority <> '5-LOW'",
    e="AND e.part_lines > 1",
    f="AND f.s_acctbal > 0",
    g="AND g.s_nationkey < 20",
    h="AND h.s_nationkey > 3",
    where="WHERE a.l_linestatus = 'O'",
)


@query("star_join_active", _STAR_ACTIVE)
def star_join_active(spark, sf):
    return _star(spark, sf, True)


@query("star_join_large_tables", _STAR_ACTIVE)
def star_join_large_tables(spark, sf):
    """The way taken when neighbouring tables on the same key are large."""
    return _star(spark, sf, True, together_rows=0)


@query("star_join_all", _STAR.format(b="", c="", d="", e="", f="", g="", h="", where=""))
def star_join_all(spark, sf):
    return _star(spark, sf, False)


@query(
    "join_multiplicity",
    """
    WITH l AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1),
         r AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'inner' AS join_type, CAST(sum(l.n * r.n) AS BIGINT) AS n_rows FROM l JOIN r USING (k)
    UNION ALL SELECT 'left', CAST(sum(l.n * coalesce(r.n, 1)) AS BIGINT) FROM l LEFT JOIN r USING (k)
    UNION ALL SELECT 'right', CAST(sum(r.n * coalesce(l.n, 1)) AS BIGINT) FROM l RIGHT JOIN r USING (k)
    """,
)
def join_multiplicity(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("k"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return joins.join_sizes(events, orders, ["k"])


# --- value spaces -----------------------------------------------------------


@query(
    "scenario_space",
    """
    WITH m AS (SELECT unnest([0, 1]) AS new_marker), c AS (SELECT unnest(['F', 'O', 'P', 'X']) AS code),
         l AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS priority),
         s AS (SELECT row_number() OVER (ORDER BY new_marker, code, priority) AS scenario_id, * FROM m, c, l),
         o AS (SELECT CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS new_marker, o_orderstatus AS code,
                      o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1, 2, 3)
    SELECT scenario_id, s.new_marker, s.code, s.priority, coalesce(n, 0) AS n
    FROM s LEFT JOIN o ON s.new_marker = o.new_marker AND s.code = o.code AND s.priority = o.priority
    """,
)
def scenario_space(spark, sf):
    """How many orders each combination of marker, code and priority has."""
    orders = table(spark, sf, "orders").select(
        (F.col("o_totalprice") > 250000).cast("int").alias("new_marker"),
        F.col("o_orderstatus").alias("code"),
        F.col("o_orderpriority").alias("priority"),
    )
    domains = {
        "new_marker": [0, 1],
        "code": ["F", "O", "P", "X"],
        "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    }
    return joins.covered_space(orders, joins.value_space(orders, domains, "scenario_id"), list(domains))


@query(
    "three_valued_cube",
    """
    WITH v AS (SELECT unnest([1, 0, NULL]) AS x),
         s AS (SELECT a.x AS a, b.x AS b, c.x AS c FROM v a, v b, v c),
         o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS a,
                      CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 0 END AS b,
                      CASE WHEN o_totalprice > 300000 THEN 1 WHEN o_totalprice < 100000 THEN 0 END AS c,
                      count(*) AS n FROM orders GROUP BY 1, 2, 3)
    SELECT s.a, s.b, s.c, coalesce(n, 0) AS n FROM s LEFT JOIN o
      ON s.a IS NOT DISTINCT FROM o.a AND s.b IS NOT DISTINCT FROM o.b AND s.c IS NOT DISTINCT FROM o.c
    """,
)
def three_valued_cube(spark, sf):
    def flag(one, zero, name):
        return F.when(F.expr(one), 1).when(F.expr(zero), 0).alias(name)

    orders = table(spark, sf, "orders").select(
        flag("o_orderstatus = 'F'", "o_orderstatus = 'O'", "a"),
        flag("o_orderpriority = '1-URGENT'", "o_orderpriority = '2-HIGH'", "b"),
        flag("o_totalprice > 300000", "o_totalprice < 100000", "c"),
    )
    space = joins.value_space(orders, {name: [1, 0, None] for name in "abc"})
    return joins.covered_space(orders, space, ["a", "b", "c"])


# --- lookups ----------------------------------------------------------------

_ACTIONS = [(1, "5", "hold"), (2, "11", "review"), (3, "5", "ship"), (4, "28", "return"), (5, "11", "close")]
_ACTIONS_SQL = "(VALUES (1,'5','hold'), (2,'11','review'), (3,'5','ship'), (4,'28','return'), (5,'11','close')) AS a(pos, value, action)"


def _actions(spark):
    return inline_rows(spark, _ACTIONS, "pos int, value string, action string")


@query(
    "lookup_first",
    f"""
    SELECT p_partkey, p_size, action AS expected_flag FROM part LEFT JOIN
      (SELECT value, min_by(action, pos) AS action FROM {_ACTIONS_SQL} GROUP BY value) ON value = CAST(p_size AS VARCHAR)
    """,
)
def lookup_first(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    return joins.lookup_first(parts, _actions(spark), "p_size", "value", "action", "pos", "expected_flag")


@query(
    "lookup_all",
    f"SELECT p_partkey, p_size, action FROM part LEFT JOIN {_ACTIONS_SQL} ON value = CAST(p_size AS VARCHAR)",
)
def lookup_all(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    return joins.lookup_all(parts, _actions(spark), "p_size", "value", "action", "action")


@query(
    "code_decision",
    """
    SELECT p_partkey, CASE p_brand WHEN 'Brand#2' THEN 'V1' WHEN 'Brand#3' THEN 'V2' WHEN 'Brand#1' THEN 'V3'
                      ELSE 'V99' END AS decision FROM part
    """,
)
def code_decisions(spark, sf):
    decisions = {"Brand#2": "V1", "Brand#3": "V2", "Brand#1": "V3"}
    return table(spark, sf, "part").select("p_partkey", code_decision(F.col("p_brand"), decisions).alias("decision"))


# --- set operations ---------------------------------------------------------


@query(
    "amplify",
    """
    WITH c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS o FROM customer),
         n AS (SELECT count(*) AS size, 2 * count(*) + count(*) // 3 AS n FROM customer)
    SELECT c_custkey, c_name, copy * size + o AS id FROM c, n, (SELECT unnest([0, 1, 2]) AS copy)
    WHERE copy * size + o < n
    """,
)
def amplify(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    size = customers.count()
    return sets.amplify(customers, 2 * size + size // 3, ["c_custkey"])


_LEFT_PARTS = "SELECT p_brand, p_type, p_size FROM part WHERE p_size <= 30"
_RIGHT_PARTS = "SELECT p_brand, p_type, p_size FROM part WHERE p_size > 25 AND p_retailprice < 1500"


def _part_sides(spark, sf):
    parts = table(spark, sf, "part")
    left = parts.where("p_size <= 30").select("p_brand", "p_type", "p_size")
    right = parts.where("p_size > 25 AND p_retailprice < 1500").select("p_brand", "p_type", "p_size")
    return left, right


@query("subtract_rows", f"{_LEFT_PARTS} EXCEPT {_RIGHT_PARTS}")
def subtract_rows(spark, sf):
    return sets.subtract(*_part_sides(spark, sf))


@query(
    "surplus_rows",
    f"SELECT p_brand, p_type, p_size, count(*) AS copies FROM ({_LEFT_PARTS} EXCEPT ALL {_RIGHT_PARTS}) GROUP BY 1, 2, 3",
)
def surplus_rows(spark, sf):
    return sets.surplus(*_part_sides(spark, sf))


@query(
    "once_only_rows",
    """
    SELECT o_custkey, o_totalprice, min(side) AS side FROM (
      SELECT o_custkey, o_totalprice, 'left' AS side FROM orders WHERE o_orderstatus <> 'P'
      UNION ALL SELECT o_custkey, o_totalprice, 'right' FROM orders WHERE o_orderstatus <> 'F')
    GROUP BY 1, 2 HAVING count(*) = 1
    """,
)
def once_only_rows(spark, sf):
    orders = table(spark, sf, "orders")
    columns = ["o_custkey", "o_totalprice"]
    return sets.once_only(
        orders.where("o_orderstatus <> 'P'").select(*columns), orders.where("o_orderstatus <> 'F'").select(*columns)
    )


_PART_LISTS = """
    (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS l1, ['small', 'red', 'ring', 'promo'] AS l2 FROM part)
"""


def _part_lists(spark, sf):
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")
    wanted = F.array(*[F.lit(w) for w in ("small", "red", "ring", "promo")])
    return table(spark, sf, "part").select("p_partkey", words.alias("l1"), wanted.alias("l2"))


@query(
    "list_intersection",
    f"""
    SELECT p_partkey, coalesce(array_to_string(list_filter(l1, lambda x: list_contains(l2, x)), ','), '') AS common
    FROM {_PART_LISTS}
    """,
)
def list_intersection(spark, sf):
    common = F.array_join(elements_in(F.col("l1"), F.col("l2")), ",").alias("common")
    return _part_lists(spark, sf).select("p_partkey", common)


@query(
    "list_intersection_distinct",
    f"""
    SELECT p_partkey,
           coalesce(array_to_string(list_sort(list_distinct(list_filter(l1, lambda x: list_contains(l2, x)))), ','), '') AS common
    FROM {_PART_LISTS}
    """,
)
def list_intersection_distinct(spark, sf):
    common = F.array_join(F.array_sort(sets.list_intersection(F.col("l1"), F.col("l2"))), ",").alias("common")
    return _part_lists(spark, sf).select("p_partkey", common)
