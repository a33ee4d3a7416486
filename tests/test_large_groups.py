"""The ways taken for large groups give the same results as the plain ones."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.operators import aggregates, joins, ordering, sets
from tallyforge.sources.readers import inline_rows


@pytest.fixture
def skewed(spark):
    """A third of the rows have one key; some keys and values are NULL."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 11))
    return spark.range(3000).select(
        key.alias("g"), F.hash("id").alias("o"), "id", F.when(F.col("id") % 5 > 0, F.col("id").cast("decimal(18,2)")).alias("v")
    )


@pytest.fixture
def many_pieces(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("slices", [None, 13])
def test_running_total(skewed, rows, many_pieces, slices):
    order = ["o", "id"]
    plain = ordering.running_total(skewed, ["g"], order, F.col("v"), "t")
    split = ordering.running_total(skewed, ["g"], order, F.col("v"), "t", group_rows=10, slices=slices)
    assert split.columns == plain.columns
    assert rows(split) == rows(plain)


def test_running_total_descending_and_leading_nulls(spark, rows, many_pieces):
    df = inline_rows(spark, [("a", i, Decimal(i) if i < 30 else None) for i in range(40)], "g string, o int, v decimal(10,0)")
    order = [F.col("o").desc()]
    plain = ordering.running_total(df, ["g"], order, F.col("v"), "t")
    split = ordering.running_total(df, ["g"], order, F.col("v"), "t", group_rows=1, slices=8)
    assert rows(split) == rows(plain)


def test_group_serial(skewed, rows, many_pieces):
    plain = ordering.group_serial(skewed, ["g"], ["o", "id"])
    split = ordering.group_serial(skewed, ["g"], ["o", "id"], group_rows=10, slices=17)
    assert rows(split) == rows(plain)


def test_group_list(skewed, rows, many_pieces):
    plain = aggregates.group_list(skewed, ["g"], "o", "l", chunk=50, tie_break=["id"])
    split = aggregates.group_list(skewed, ["g"], "o", "l", chunk=50, tie_break=["id"], group_rows=10)
    assert rows(split) == rows(plain)


def test_left_join(skewed, rows):
    left = inline_rows(skewed.sparkSession, [("hot", 1), ("k1", 2), ("none", 3), (None, 4), ("hot", 5)], "g string, x int")
    plain = joins.left_join(left, skewed, ["g"])
    split = joins.left_join(left, skewed, ["g"], key_rows=1)
    assert split.columns == plain.columns
    assert rows(split) == rows(plain)


def test_tables_joined_together_first_give_the_same_star(spark, rows):
    base = inline_rows(spark, [(1, 1), (1, 2), (2, 3), (3, None), (None, 1)], "a int, b int")
    inner = [(inline_rows(spark, [(1, "x"), (1, "y"), (2, "z"), (3, "w")], "a int, p string"), ["a"]),
             (inline_rows(spark, [(1, "q"), (3, "r"), (3, "s"), (None, "n")], "a int, q string"), ["a"])]
    left = [(inline_rows(spark, [(1, "f"), (1, "g"), (9, "h"), (None, "n")], "b int, f string"), ["b"]),
            (inline_rows(spark, [(2, "i"), (1, "j")], "b int, h string"), ["b"]),
            (inline_rows(spark, [(3, "k")], "a int, k string"), ["a"])]
    chained = base
    for table, on in inner:
        chained = chained.join(table, on)
    for table, on in left:
        chained = chained.join(table, on, "left")
    columns = chained.columns
    for limit in (0, 2, 1000):
        star = joins.star_join(base, inner, left, together_rows=limit)
        assert rows(star.select(*columns)) == rows(chained.select(*columns))


def test_record_ranges(spark, monkeypatch):
    df = spark.range(1000).repartition(5)
    for limit in (10_000, 0):
        monkeypatch.setattr(ordering, "RANGE_BY_LIMIT", limit)
        assert sorted(r[0] for r in ordering.record_range(df, ["id"], 400, 500).collect()) == list(range(399, 500))
        assert sorted(r[0] for r in ordering.record_range(df, ["id"], 990, 5000).collect()) == list(range(989, 1000))
        assert ordering.nth_record(df, [F.col("id").desc()], 1).first()[0] == 999
        assert ordering.record_range(df, ["id"], 2000, 3000).count() == 0
    with pytest.raises(ValueError):
        ordering.record_range(df, ["id"], 0, 5)


def test_numbering_an_empty_table(spark):
    assert ordering.dense_ordinal(spark.range(0), ["id"]).count() == 0
    assert ordering.running_total(spark.range(0).withColumn("g", F.lit(1)), ["g"], ["id"], F.col("id"), "t").count() == 0


small = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 2)), max_size=12)


@settings(max_examples=8, deadline=None)
@given(left=small, right=small)
def test_set_operations_match_spark(spark, left, right):
    kind = "s string, n int"
    l, r = inline_rows(spark, left, kind), inline_rows(spark, right, kind)
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert as_rows(sets.subtract(l, r)) == as_rows(l.subtract(r))
    repeated = sets.surplus(l, r).select("s", "n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("i")).drop("i")
    assert as_rows(repeated) == as_rows(l.exceptAll(r))
    both = left + right
    assert as_rows(sets.once_only(l, r).drop("side")) == sorted((t for t in both if both.count(t) == 1), key=repr)


def test_left_join_ways_agree_on_shared_names(spark, rows):
    left = spark.createDataFrame([(1, "a", "l"), (2, "b", "l"), (None, "c", "l")], "k int, x string, note string")
    right = spark.createDataFrame([(1, 1.5, "r"), (1, 2.5, "r"), (3, 3.5, "r")], "k int, y double, note string")
    plain, split = joins.left_join(left, right, ["k"]), joins.left_join(left, right, ["k"], key_rows=1)
    assert plain.dtypes == split.dtypes and rows(plain) == rows(split)


def test_running_total_keeps_its_type(spark):
    df = spark.range(40).selectExpr("id", "id % 2 AS g", "CAST(id AS decimal(18,2)) AS v", "id / 8 AS d")
    for column in ("v", "d", "id"):
        plain = ordering.running_total(df, ["g"], ["id"], F.col(column), "t")
        split = ordering.running_total(df, ["g"], ["id"], F.col(column), "t", group_rows=3, slices=4)
        assert plain.dtypes == split.dtypes
        assert sorted(plain.collect()) == sorted(split.collect())


def test_star_join_makes_no_pairs_of_keys_the_base_lacks(spark):
    base = spark.createDataFrame([(1, 1)], "k int, v int")
    left = [(spark.range(300).selectExpr("CAST(9 AS int) AS k", f"id AS c{i}"), ["k"]) for i in range(2)]
    joined = joins.star_join(base, [], left, together_rows=10)
    assert joined.collect() == [(1, 1, None, None)]
    assert "FullOuter" not in joined._jdf.queryExecution().optimizedPlan().toString()


def test_long_and_short_record_ranges_agree(spark, monkeypatch):
    df = spark.range(50).selectExpr("id * 7 % 50 AS id", "'x' AS t")
    short = ordering.record_range(df, ["id"], 5, 20)
    monkeypatch.setattr(ordering, "RANGE_BY_LIMIT", 3)
    long = ordering.record_range(df, ["id"], 5, 20)
    assert short.dtypes == long.dtypes and short.collect() == long.collect()
