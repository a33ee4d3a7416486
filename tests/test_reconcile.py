import pytest
from pyspark.sql import functions as F

from tallyforge.operators import quality, reconcile, sets
from tallyforge.sources.readers import inline_rows

KIND = "id string, value int"


@pytest.fixture
def sides(spark):
    return (
        inline_rows(spark, [("A", 10), ("B", 20), ("C", 30)], KIND),
        inline_rows(spark, [("A", 10), ("B", 25), ("D", 40)], KIND),
    )


def test_rows_on_one_side(sides, rows):
    assert rows(sets.subtract(*sides)) == [("B", 20), ("C", 30)]
    assert rows(reconcile.row_diff(*sides)) == [("B", 20, "left", 1), ("B", 25, "right", 1), ("C", 30, "left", 1), ("D", 40, "right", 1)]
    assert rows(reconcile.row_diff_summary(*sides)) == [(3, 3, 2, 2, 4)]
    assert reconcile.row_diff_shown(*sides, shown=3).count() == 3


def test_copies_count(spark, rows):
    left = inline_rows(spark, [("A", 1), ("A", 1), (None, None)], KIND)
    right = inline_rows(spark, [("A", 1), (None, None)], KIND)
    assert rows(reconcile.row_diff(left, right)) == [("A", 1, "left", 1)]
    assert rows(sets.subtract(left, right)) == []


def test_equality(sides, spark, rows):
    left, right = sides
    assert rows(reconcile.table_equality(left, left.repartition(3).orderBy(F.desc("id")), "t")) == [("t", "Match", 3, 3, 0)]
    assert rows(reconcile.table_equality(left, right, "t")) == [("t", "Do Not Match", 3, 3, 4)]
    assert rows(reconcile.table_equality(left, left.withColumnRenamed("id", "key"), "t")) == [("t", "Do Not Match", 3, 3, None)]
    nulls = inline_rows(spark, [(None, None)], KIND)
    assert rows(reconcile.table_equality(nulls, nulls, "t")) == [("t", "Match", 1, 1, 0)]


def test_empty_tables_are_equal(spark, rows):
    empty = inline_rows(spark, [], KIND)
    assert rows(reconcile.table_equality(empty, empty, "t")) == [("t", "Match", 0, 0, 0)]


def test_cells(sides, rows):
    assert rows(reconcile.cell_diff(*sides, ["id"])) == [("B", "value", "20", "25")]
    assert rows(reconcile.column_mismatch_count(*sides, ["id"], "value")) == [(1,)]


def test_cells_need_unique_keys(sides):
    left, right = sides
    with pytest.raises(reconcile.RepeatedKeys, match="left"):
        reconcile.cell_diff(left.union(left), right, ["id"])


def test_sides_of_different_types(spark, rows):
    left = spark.createDataFrame([(1, 5, "7", None), (2, 6, "x", 1)], "id int, n int, s string, m int")
    right = spark.createDataFrame([(1, 5.0, 7, None), (2, 6.5, 8, 1)], "id int, n double, s int, m bigint")
    assert rows(reconcile.cell_diff(left, right, ["id"])) == [(2, "n", "6", "6.5"), (2, "s", "x", "8")]
    assert rows(reconcile.column_mismatch_count(left, right, ["id"], "n")) == [(1,)]
    assert reconcile.ordered_compare(left, right, ["id"], ["id"]).first()["differing"] == 1
    assert reconcile.ordered_compare(left, right.drop("m"), ["id"], ["id"]).first()["differing"] == 2


def test_schemas(sides, rows):
    left, _ = sides
    other = left.select(F.col("id").alias("key"), F.col("value").cast("bigint"), F.lit(1).alias("more"))
    assert rows(reconcile.schema_diff(left, other)) == [
        (1, "id", "string", "key", "string"), (2, "value", "int", "value", "bigint"), (3, None, None, "more", "int"),
    ]
    assert reconcile.schema_diff(left, left).count() == 0


def test_ordered_results(sides, spark, rows):
    left, right = sides
    order = ["id"]
    assert rows(reconcile.ordered_compare(left, left, order, order)) == [("Success", 3, 3, 0)]
    assert rows(reconcile.ordered_compare(left, right, order, order)) == [("Failure", 3, 3, 2)]
    longer = right.union(inline_rows(spark, [("E", 1)], KIND))
    verdict = "Failure: Mismatched number of records (Source: 3, Target: 4)"
    assert rows(reconcile.ordered_compare(left, longer, order, order)) == [(verdict, 3, 4, None)]
    detail = reconcile.ordered_diff(left, longer, order, order)
    assert [(r["position"], r["status"]) for r in detail.orderBy("position").collect()] == [
        (2, "differs"), (3, "differs"), (4, "target only"),
    ]
    # The same rows in another order differ.
    assert reconcile.ordered_compare(left, left, order, [F.desc("id")]).first()["verdict"] == "Failure"


def test_table_sets(sides, rows):
    left, right = sides
    report = reconcile.table_set_report({"a": left, "b": left, "c": left}, {"a": left, "b": right, "d": right})
    assert rows(report.select("name", "result")) == [
        ("a", "Match"), ("b", "Do Not Match"), ("c", "Missing in right"), ("d", "Missing in left")
    ]
    counts = {r["name"]: (r["left_rows"], r["right_rows"], r["mismatches"]) for r in report.collect()}
    assert counts["a"] == (left.count(), left.count(), 0) and counts["b"][2] > 0
    assert counts["c"] == (left.count(), None, None) and counts["d"] == (None, right.count(), None)


def test_null_keys_are_compared(spark, rows):
    schema = "k string, v string"
    left, right = spark.createDataFrame([(None, "p"), ("a", "x")], schema), spark.createDataFrame([(None, "q"), ("a", "x")], schema)
    assert rows(reconcile.cell_diff(left, right, ["k"])) == [(None, "v", "p", "q")]
    assert reconcile.column_mismatch_count(left, right, ["k"], "v").first()[0] == 1


def test_a_column_of_one_side_only_is_no_match(spark):
    left = spark.createDataFrame([(1, 2)], "a int, b int")
    more = left.selectExpr("*", "3 AS c")
    for compare in (reconcile.row_diff, reconcile.row_diff_summary, lambda l, r: reconcile.cell_diff(l, r, ["a"])):
        for pair in ((left, more), (more, left)):
            with pytest.raises(ValueError, match="columns differ"):
                compare(*pair)
    assert reconcile.table_equality(left, more).first()["result"] == "Do Not Match"


def test_sides_of_different_kinds(sides, spark, rows, folder):
    left, right = sides
    left.createOrReplaceTempView("left_side")
    right.write.option("header", True).csv(f"{folder}/side")
    source = {"kind": "sql", "query": "SELECT * FROM left_side"}
    target = {"kind": "file", "format": "csv", "path": f"{folder}/side", "schema": KIND, "options": {"header": True}}
    assert rows(reconcile.compare_sides(spark, source, target)) == [(3, 3, 2, 2, 4)]
    assert rows(reconcile.compare_sides(spark, source, {"kind": "table", "name": "left_side"})) == [(3, 3, 0, 0, 0)]
    with pytest.raises(ValueError, match="unknown kind"):
        reconcile.load_side(spark, {"kind": "queue"})


def outcome(df):
    row = df.first()
    return row["outcome"], row["evidence"]


def test_expected_value(spark):
    left = inline_rows(spark, [("A1", 10, True), ("A2", 20, False), ("A3", 30, True)], "customerid string, value1 int, condition1 boolean")
    right = inline_rows(spark, [("A1", "X"), ("A2", "Y"), ("B1", "Z"), ("A3", "X"), ("A3", "W")], "customerid string, col_B string")
    conditions = [F.col("value1") > 25, F.col("condition1")]
    check = lambda value: outcome(quality.expected_value_check(left, right, ["customerid"], conditions, "col_B", value))
    assert check("X") == ("passed", "eligible=2 matching=1")
    assert check("Y") == ("failed", "eligible=2 matching=0")


def test_allowed_values(spark, rows):
    df = inline_rows(spark, [("A", 0), ("B", 10), ("C", 5), ("D", 0), ("E", 2)], "col_A string, col_B int")
    allowed = ["A", "B", "C"]
    assert outcome(quality.allowed_values_check(df, "col_A", allowed)) == ("failed", "bad=2 rows=5")
    assert rows(quality.disallowed_rows(df, "col_A", allowed)) == [("D", 0), ("E", 2)]
    assert outcome(quality.implication_check(df, "col_A", allowed, F.col("col_B") == 0)) == ("failed", "bad=2 rows=5")
    assert rows(quality.broken_implication_rows(df, "col_A", allowed, F.col("col_B") == 0)) == [("B", 10), ("C", 5)]


def test_structure(spark):
    empty = inline_rows(spark, [], KIND)
    nulls = inline_rows(spark, [(None, None)], KIND)
    one = inline_rows(spark, [("a", None)], KIND)
    assert [outcome(quality.structure_check(d))[0] for d in (empty, nulls, one)] == ["failed", "failed", "passed"]
    assert outcome(quality.partition_check(one, "value")) == ("failed", "nulls=1 rows=1")
    assert outcome(quality.partition_check(one, "absent")) == ("failed", "column absent is absent")
    assert outcome(quality.partition_check(one, "id"))[0] == "passed"


def test_totals(spark, rows):
    results = quality.check_results(
        quality.non_empty_check(spark.range(3), "a"), quality.non_empty_check(spark.range(0), "b"), quality.fixed_result(spark.range(0), "s", "c", True, "e")
    )
    assert rows(quality.check_totals(results)) == [("failed", 1), ("passed", 2)]


def test_sample_does_not_depend_on_partitions(spark, rows):
    df = spark.range(5000)
    first, again = (quality.evidence_sample(d, ["id"]) for d in (df, df.repartition(7)))
    assert rows(first) == rows(again) and 400 < first.count() < 600


def test_ordered_rows_are_compared_by_marks(spark, rows):
    left = spark.createDataFrame([(1, None, "a"), (2, 1.0, None), (2, 1.0, None), (3, -0.0, "c"), (4, float("nan"), "d")], "k int, v double, s string")
    right = spark.createDataFrame([(1, None, "a"), (2, 1.0, None), (2, 1.0, None), (3, 0.0, "c"), (4, float("nan"), "x"), (5, 2.0, "e")], "k bigint, v double, s string")
    got = reconcile.ordered_diff(left, right, ["k"], ["k"])
    assert rows(got.select("position", "status")) == [(5, "differs"), (6, "target only")]
    assert rows(got.select("target_row", "source_row"))[0] == ('{"c0":4,"c1":"NaN","c2":"x"}', '{"c0":4,"c1":"NaN","c2":"d"}')
    # A NULL and a value that would hash alike side by side are told apart.
    swapped = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    turned = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert reconcile.ordered_diff(swapped.limit(1), turned.limit(1), ["x"], ["x"]).count() == 1
    assert reconcile.ordered_compare(left, left, ["k"], ["k"]).first()["verdict"] == "Success"


def test_only_marks_are_written_for_positions(spark, monkeypatch):
    from tallyforge.operators import ordering

    written = []
    true = ordering.materialize
    monkeypatch.setattr(ordering, "materialize", lambda df, label="rows": written.append(df.columns) or true(df, label))
    wide = spark.range(50).selectExpr("id", "id * 2 AS b", "repeat('x', 100) AS c")
    reconcile.ordered_compare(wide, wide, ["id"], ["id"]).collect()
    monkeypatch.setattr(ordering, "RANGE_BY_LIMIT", 3)
    got = ordering.record_range(wide.unionByName(wide), ["id"], 9, 15).collect()
    assert [r["id"] for r in got] == [4, 4, 5, 5, 6, 6, 7] and got[0]["c"] == "x" * 100
    assert written == [["_source", "_place"], ["_target", "_place"], ["_mark", "_place"]]
    assert ordering.record_range(wide, ["id"], 49, 90).count() == 2 and ordering.record_range(wide.limit(0), ["id"], 5, 9).count() == 0


def test_equal_tables_shuffle_fingerprints_only(spark, rows):
    base = spark.range(3000).selectExpr("id % 700 AS k", "if(id % 5 = 0, null, id % 7) AS v", "named_struct('a', if(id % 2 = 0, null, 'x'), 'b', array(id % 3, null)) AS s")
    shuffled = base.orderBy("v").repartition(7)
    assert reconcile.table_equality(base, shuffled).first()[1:] == ("Match", 3000, 3000, 0)
    assert sets.fingerprints(base, shuffled).where("NOT equal").count() == 0
    assert sets.differing_counts(base, shuffled).count() == 0
    other = base.where("k <> 5").unionByName(base.where("k = 9"))
    want = sets.row_counts(base, other)
    differing = want.where("left_n <> right_n")
    assert rows(reconcile.row_diff(base, other).select("k", "v", "s")) == rows(differing.select("k", "v", "s"))
    got = reconcile.row_diff_summary(base, other).first()
    totals = want.selectExpr("sum(left_n)", "sum(right_n)", "sum(greatest(left_n - right_n, 0))", "sum(greatest(right_n - left_n, 0))").first()
    assert tuple(got)[:4] == tuple(totals)
    assert rows(reconcile.row_diff_summary(base.limit(0), base.limit(0))) == [(0, 0, 0, 0, 0)]


def test_nulls_within_nested_values_are_told_apart(spark):
    left = spark.sql("SELECT named_struct('a', CAST(NULL AS STRING), 'b', 'x') AS s, array(NULL, 'y') AS l")
    right = spark.sql("SELECT named_struct('a', 'x', 'b', CAST(NULL AS STRING)) AS s, array('y', NULL) AS l")
    assert reconcile.table_equality(left, right).first()["mismatches"] == 2


def test_equal_sums_in_one_bucket_are_no_accident(spark, monkeypatch):
    """With all rows in one bucket a difference of any two rows is still found."""
    monkeypatch.setattr(sets, "BUCKETS", 1)
    left = spark.range(200).selectExpr("id", "id % 3 AS v")
    right = left.selectExpr("if(id = 7, 8, if(id = 8, 7, id)) AS id", "v")
    assert reconcile.row_diff_summary(left, right).first()["mismatches"] == 4
    assert reconcile.row_diff_summary(left, left.orderBy(F.col("id").desc())).first()["mismatches"] == 0
