"""The rule index against the one expression of all rules."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import rule_index, rules

COLUMNS = ["a", "b", "c"]
RULES = "no int, a string, b string, c string, expected_value string"


def made_cell(made, letters):
    def term():
        sign = made.choice(["==", "==", "!=", ">", ">=", "<", "<="])
        literal = made.choice([str(made.randint(-3, 12)), f"{made.randint(0, 9)}.5", "'x'", "'5'", "''"] if letters else [str(made.randint(-3, 12)), f"{made.randint(0, 9)}.5"])
        return f"x {sign} {literal}"

    if made.random() < 0.35:
        return "any"
    return made.choice([" and ", " or "]).join(term() for _ in range(made.randint(1, 3)))


@pytest.mark.parametrize(("seed", "short"), [(0, 64), (1, 0)])
def test_same_as_one_expression(spark, rows, monkeypatch, seed, short):
    monkeypatch.setattr(rule_index, "SHORT_LIST", short)
    made = random.Random(seed)
    table = [(i, *[made_cell(made, c == "c" or seed % 2 == 1) for c in COLUMNS], f"v{i}") for i in range(40)]
    data = [
        (i, made.choice([None, *range(-4, 14)]), made.choice([None, float("nan"), *[k / 2 for k in range(-8, 28)]]), made.choice([None, "x", "5", "5.0", "", "7", "y"]))
        for i in range(200)
    ]
    df = spark.createDataFrame(data, "id int, a bigint, b double, c string")
    names = ["no", *COLUMNS, "expected_value"]
    value = rules.first_match(df, [dict(zip(names, r)) for r in table], COLUMNS)
    got = rule_index.match_rules(df, spark.createDataFrame(table, RULES), COLUMNS, "no")
    shown = [F.col(c).cast("string") for c in got.columns]  # NaN differs from itself in Python
    assert rows(got.select(*shown)) == rows(df.withColumn("expected_value", value).select(*shown))


def test_decimals_large_integers_and_one_leaf(spark, rows):
    big = 2**53
    data = [(1, big), (2, big + 1), (3, None), (4, 5)]
    df = spark.createDataFrame(data, "id int, a bigint").withColumn("b", (F.col("id") / 10).cast("decimal(12,2)"))
    table = [(1, f"x == {big + 1}", "any", "exact"), (2, f"x > {big}", "any", "never"), (3, "any", "x >= 0.2 and x < 0.4", "range"), (4, "x == 5", "x == 0.4", "four")]
    names = ["no", "a", "b", "expected_value"]
    got = rule_index.match_rules(df, spark.createDataFrame(table, "no int, a string, b string, expected_value string"), ["a", "b"], "no")
    value = rules.first_match(df, [dict(zip(names, r)) for r in table], ["a", "b"])
    assert rows(got.select("id", "expected_value")) == rows(df.select("id", value)) == [(1, None), (2, "exact"), (3, "range"), (4, "four")]


def test_no_rules_a_rule_for_all_and_cells_that_are_none(spark, rows):
    df = spark.createDataFrame([(1, "p"), (2, "q")], "a int, expected_value string")
    schema = "no int, a string, expected_value string"
    assert rows(rule_index.match_rules(df, spark.createDataFrame([], schema), ["a"], "no")) == [(1, None), (2, None)]
    table = [(9, "x == 2", "late"), (3, "any", "all"), (1, "x > 1", "first")]
    assert rows(rule_index.match_rules(df, spark.createDataFrame(table, schema), ["a"], "no")) == [(1, "all"), (2, "first")]
    with pytest.raises(Exception, match="not understood"):
        rule_index.match_rules(df, spark.createDataFrame([(1, "x ~ 2", "v")], schema), ["a"], "no").collect()


@pytest.mark.parametrize("seed", range(30))
def test_nodes_cover_a_range_once(seed):
    made = random.Random(seed)
    first, last = sorted(made.randrange(rule_index.GRID) for _ in range(2))
    leaves = [leaf for level, node in rule_index.cover(first, last) for leaf in range(node << level, (node + 1) << level)]
    assert sorted(leaves) == list(range(first, last + 1)) and len(rule_index.cover(first, last)) <= 70
    assert rule_index.cover(5, 4) == []


def test_twenty_thousand_rules(spark):
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    every = spark.range(20_000).select(
        F.col("id").alias("no"), F.format_string("x == %d", F.col("id") % 20_000 + 1).alias("l_partkey"),
        F.format_string("x > %d and x <= %d", F.col("id") % 30, F.col("id") % 30 + 10).alias("l_quantity"), F.concat(F.lit("v"), "id").alias("expected_value"),
    )

    def seconds(table):
        began = time.time()
        rule_index.match_rules(lines, table, ["l_partkey", "l_quantity"], "no").write.format("noop").mode("overwrite").save()
        return time.time() - began

    few = every.where("no < 100")
    seconds(few)
    assert seconds(every) < 2 * seconds(few) + 3
    found = rule_index.match_rules(lines, every, ["l_partkey", "l_quantity"], "no")
    wrong = found.where(
        "NOT (expected_value <=> IF(l_quantity > (l_partkey - 1) % 30 AND l_quantity <= (l_partkey - 1) % 30 + 10 AND l_partkey BETWEEN 1 AND 20000, concat('v', l_partkey - 1), NULL))"
    )
    assert wrong.count() == 0


def test_no_list_of_rules_goes_into_a_later_join(spark):
    """A row goes on with the lowest number and its value; with its lists it would be shuffled many times as wide."""
    df = spark.range(50).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"), F.lit(1.5).alias("c"))
    table = [(i, *([f"x == {i}", "any"] if i % 2 else ["any", f"x == {i}"]), "x > 1", f"v{i}") for i in range(6)]
    found = rule_index.match_rules(df, spark.createDataFrame(table, RULES), COLUMNS, "no")
    todo, joins = [found._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        joins += [children[0].schema().simpleString()] if node.nodeName() == "Join" else []
        todo += children
    assert len(joins) == 2 and not any("array" in side for side in joins)
