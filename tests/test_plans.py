"""Physical plans: what reaches the scan, what shuffles, and what must not appear."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import joins, ordering, rules, sets
from tallyforge.plans import QUERIES
from tallyforge.plans.joins_sets import _star

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rules_are_pushed_down_and_columns_pruned(spark):
    text = plan(QUERIES["rule_filter"](spark, SF_DIR))
    assert "GreaterThan(l_quantity,30.0)" in text and "EqualTo(l_linestatus,O)" in text
    read = re.search(r"ReadSchema: struct<(.*)>", text)[1]
    assert "l_tax" not in read and "l_comment" not in read


def test_filters_are_pushed_down(spark):
    assert "GreaterThan(l_quantity,30.0)" in plan(QUERIES["filters"](spark, SF_DIR))


def test_first_per_group_limits_before_the_shuffle(spark):
    text = plan(QUERIES["first_per_group"](spark, SF_DIR))
    assert text.count("WindowGroupLimit") >= 2


def test_distinct_count_spreads_a_hot_group(spark):
    text = plan(QUERIES["distinct_users_by_type"](spark, SF_DIR))
    assert re.search(r"hashpartitioning\(event_type#\d+, user_id#\d+L", text)


@pytest.mark.parametrize("name", ["subtract_rows", "row_diff", "once_only_rows", "duplicate_keys", "bucket_counts"])
def test_one_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.MULTILINE)) == 1


def test_map_only_operators_do_not_shuffle(spark):
    for name in ("rule_first_match", "swap_codes", "gen_customers", "gen_scramble", "update_at_index", "priority_list", "evidence_sample"):
        assert "Exchange" not in plan(QUERIES[name](spark, SF_DIR))


def test_star_join_broadcasts_small_tables(spark):
    text = plan(_star(spark, SF_DIR, True))
    assert "SortMergeJoin" not in text and "FullOuter" not in text


def test_star_join_meets_large_tables_in_one_join_per_key_set(spark, no_broadcast):
    text = plan(_star(spark, SF_DIR, True, together_rows=0))
    tree = text[: text.index("\n(1) ")]
    on_base = [line for line in tree.splitlines() if re.search(r"SortMergeJoin LeftOuter|SortMergeJoin Inner", line)]
    assert tree.count("SortMergeJoin LeftOuter") == 2 and tree.count("SortMergeJoin FullOuter") == 2
    assert tree.count("SortMergeJoin Inner") == 3 and len(on_base) == 5


@pytest.fixture
def splits(spark, no_broadcast):
    """Skew handling that reacts to small tables."""
    names = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_hot_left_key_is_split(spark, splits):
    facts = spark.range(0, 200_000, 1, 8).selectExpr("IF(id % 10 < 8, 7, id) AS k", "uuid() AS v")
    keys = spark.range(0, 200_000, 3, 4).selectExpr("id + 1 AS k", "CAST(id AS string) AS w")
    for joined in (
        joins.keep_listed(facts, keys, ["k"]),
        joins.not_listed(facts, keys, F.col("k"), "k"),
        joins.lookup_first(facts, keys, "k", "k", "w", "w", "found"),
    ):
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_literal_lookup_is_broadcast_by_size(spark):
    text = plan(QUERIES["lookup_first"](spark, SF_DIR))
    assert "BroadcastHashJoin LeftOuter" in text


def test_compiled_rules_stay_in_codegen(spark):
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    rule = [{"column": "l_quantity", "condition": ">", "value": 3}]
    assert "codegen id" in plan(lines.where(rules.rule_filter(rule)))


def test_top_n_takes_ordered(spark):
    assert "TakeOrderedAndProject" in plan(ordering.top_n(spark.range(100), [F.desc("id")], 5))


def test_numbering_needs_no_window(spark):
    text = plan(ordering.dense_ordinal(spark.range(100), ["id"]))
    assert "Window" not in text and "SinglePartition" not in text


def test_copies_do_not_union(spark):
    assert "Union" not in plan(sets.amplify(spark.range(10), 95, ["id"]))
