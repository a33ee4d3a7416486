"""Rows whose shown code is wrong: the intended result is what counts."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import nested, text
from tallyforge.operators import aggregates, datagen, ordering, rules, sets, shape
from tallyforge.sources.readers import inline_rows


def values(spark, kind, items, column):
    return [r[0] for r in inline_rows(spark, [(i,) for i in items], f"v {kind}").select(column).collect()]


def test_marker_append(spark):
    got = values(spark, "string", ["12.65", "11.5", "12", ".5"], text.marker_append(F.col("v")))
    assert got == ["121.65", "11.5", "12", "1.5"]


def test_marker_append_drops_nulls(spark, rows):
    df = inline_rows(spark, [("12.65",), (None,)], "v string")
    assert rows(text.marker_append_rows(df, "v")) == [("12.65", "121.65")]


def test_marker_replace_compares_whole_codes(spark, rows):
    data = [(1, "1295", "125.50"), (1, "0762", "125.50"), (1, "76", "125.50"), (0, "1295", "125.50"), (1, "1295", "128"), (1, "1295", "12.")]
    df = inline_rows(spark, data, "m int, c string, l string")
    got = [r[0] for r in df.select(text.marker_replace(F.col("m"), F.col("c"), F.col("l"))).collect()]
    assert got == ["121.50", "125.50", "121.50", "125.50", "121", "11"]


def test_split_number(spark):
    got = values(spark, "string", ["12.65", "12", None], text.split_number(F.col("v")))
    assert [g and tuple(g) for g in got] == [("12", "65"), ("12", ""), None]


def test_parse_list(spark):
    got = values(spark, "string", ['["PC001","PC002"]', "[]", "", "[a]"], text.parse_list(F.col("v")))
    assert got == [["PC001", "PC002"], [], [], ["a"]]


def test_file_name_dates(spark):
    names = ["x_2024-09-10_y.csv", "x_2024-13-10_y.csv", "abc-10-09-2024.zip", "none"]
    iso = [str(d) for d in values(spark, "string", names, text.filename_iso_date(F.col("v")))]
    dmy = [str(d) for d in values(spark, "string", names, text.filename_dmy_date(F.col("v")))]
    assert iso == ["2024-09-10", "None", "None", "None"]
    assert dmy == ["None", "None", "2024-09-10", "None"]


def test_decimal_cast_rounds_half_up_and_overflow_is_null(spark):
    df = spark.createDataFrame([("12.5", "keep"), ("x", "keep"), ("9999999999999", "keep")], "a string, b string")
    got = [r["a"] for r in shape.cast_all_but(df, ["b"]).collect()]
    assert [None if g is None else int(g) for g in got] == [13, None, None]


def test_colliding_names_raise(spark):
    with pytest.raises(ValueError, match="collide"):
        shape.lowercase_columns(spark.createDataFrame([(1, 2)], ["A", "a"]))


def test_prefixes(spark):
    df = spark.range(1).toDF("t.a").withColumn("b", F.lit(1)).withColumn("t.c.d", F.lit(2))
    assert shape.strip_prefix(df).columns == ["a", "b", "c"]


def test_struct_field_keeps_others(spark):
    df = spark.createDataFrame([(1, ("John", 30))], "id int, details struct<name:string,age:int>")
    assert tuple(shape.add_to_field(df, "details", "age", 10).first()["details"]) == ("John", 40)


def test_reject_holds_null_conditions(spark, rows):
    df = inline_rows(spark, [(1,), (5,), (None,)], "v int")
    accepted, rejected = shape.accept_reject(df, F.col("v") > 3)
    assert rows(accepted) == [(5,)]
    assert rows(rejected) == [(1,), (None,)]


def test_unknown_comparison_is_an_error():
    with pytest.raises(ValueError, match="unknown comparison"):
        rules.rule_filter([{"column": "a", "condition": "=>", "value": 1}])


def test_first_match(spark):
    df = spark.createDataFrame([(-9997, 1, "some_value", 5), (-9997, 3, "any", 10), (-9997, -1, "any", None)], "column1 int, column2 int, column3 string, column4 int")
    columns = ["column1", "column2", "column3", "column4"]
    table = [
        ("x == -9997", "x < 0", "any", "x > 5", "never: NULL is not above 5"),
        ("x == -9997", "x >= 1 and x <= 2", "x == 'some_value'", "any", "first"),
        ("x == -9997 or x == 0", "any", "any", "x != 7", "second"),
        ("any", "any", "x > 1", "any", "never: text is no number"),
    ]
    rule_rows = [dict(zip([*columns, "expected_value"], r)) for r in table]
    assert [r[0] for r in df.select(rules.first_match(df, rule_rows, columns)).collect()] == ["first", "second", "second"]
    assert df.select(rules.first_match(df, [], columns)).first()[0] is None


@pytest.mark.parametrize(
    ("cell", "want"),
    [
        ("x != 7", [True, True, False, True]),
        ("x == 7", [False, False, True, False]),
        ("x > 3", [False, False, True, False]),
        ("x != 7 or x > 3", [True, True, True, True]),
        ("x > 3 or x != 7", [False, False, True, True]),
        ("x != 8 and x > 3", [False, False, True, False]),
        ("x == 'this or that' or x == 'a'", [False, True, False, False]),
    ],
)
def test_rule_cells_with_null_text_and_quotes(spark, cell, want):
    df = spark.createDataFrame([(None,), ("a",), ("7",), ("1",)], "v string")
    assert [r[0] for r in df.select(rules.rule_cell(cell, F.col("v"))).collect()] == want


def test_rule_files_have_a_bound(spark):
    table = spark.range(10).selectExpr("id", "'any' AS a")
    assert len(rules.load_rules(table, "id")) == 10
    with pytest.raises(ValueError, match="more than 9"):
        rules.load_rules(table, "id", most=9)


@pytest.mark.parametrize("cell", ["__import__('os')", "x.y", "x == 1; 2", "", "y > 1", "x > 1 xor x < 0"])
def test_rule_cells_are_not_code(cell):
    with pytest.raises(ValueError, match="not understood"):
        rules.rule_cell(cell, F.col("v"))


def test_amplify_gives_exactly_n_rows(spark, rows):
    df = inline_rows(spark, [("a",), ("b",), ("c",)], "v string")
    for n in (0, 2, 3, 7, 3500):
        made = rows(sets.amplify(df, n, ["v"]))
        assert sorted(r[1] for r in made) == list(range(n))
        assert [r[0] for r in sorted(made, key=lambda r: r[1])] == [("abc" * n)[i] for i in range(n)]


def test_amplify_many_copies_from_a_range(spark, rows, monkeypatch):
    monkeypatch.setattr(sets, "COPIES_PER_ROW", 2)
    df = inline_rows(spark, [("a",), ("b",), ("c",)], "v string")
    made = sorted(rows(sets.amplify(df, 11, ["v"])), key=lambda r: r[1])
    assert [r[0] for r in made] == list("abcabcabcab")


def test_amplify_replaces_an_old_id(spark, rows, monkeypatch):
    df = inline_rows(spark, [(7, "a"), (9, "b")], "id bigint, v string")
    for limit in (1000, 1):
        monkeypatch.setattr(sets, "COPIES_PER_ROW", limit)
        assert rows(sets.amplify(df, 5, ["id"]).select("v", "id")) == [("a", 0), ("a", 2), ("a", 4), ("b", 1), ("b", 3)]


def test_serial_is_dense_over_many_partitions(spark):
    df = spark.range(10_000).repartition(7).withColumn("k", F.hash("id"))
    numbered = ordering.dense_ordinal(df, ["k", "id"], "serial", 1000180).collect()
    numbered.sort(key=lambda r: (r["k"], r["id"]))
    assert [r["serial"] for r in numbered] == list(range(1000180, 1010180))


def test_whole_elements_are_compared(spark):
    row = spark.range(1).select(
        nested.elements_in(F.split(F.lit("PC00,PC001,PC001"), ","), F.split(F.lit("PC001,PC002"), ","))
    ).first()
    assert row[0] == ["PC001", "PC001"]


def test_elements_past_the_end(spark):
    df = spark.createDataFrame([([("5",), ("x",)],)], "a array<struct<value:string>>")
    row = df.select(*[nested.element_field(F.col("a"), i, "value", "int") for i in (0, 1, 66)]).first()
    assert tuple(row) == (5, None, None)


def test_update_at_index_only_where_null(spark):
    kind = "a array<struct<value:int,value2:int>>"
    df = spark.createDataFrame([([(None, 1), (None, 2)],), ([(1, 1), (7, 2)],), ([(1, 1)],)], kind)
    got = [[tuple(x) for x in r[0]] for r in df.select(nested.update_at_index(F.col("a"), 1, "value", F.lit(10))).collect()]
    assert got == [[(None, 1), (10, 2)], [(1, 1), (7, 2)], [(1, 1)]]


def test_json_cells(spark):
    cells = ['{"a": 1, "b": -2.5, "c": "t"}', "{bad", "", None, "[1]"]
    got = values(spark, "string", cells, nested.parse_json_cell(F.col("v")))
    assert [(dict(g["cell"]), g["is_bad"]) for g in got] == [
        ({"a": "1", "b": "-2.5", "c": "t"}, False), ({}, True), ({}, False), ({}, False), ({}, True),
    ]


def test_priority_list(spark):
    data = [
        (["PC001"], ["a", "b", "c", "d", "e", "f", "NULL"], "-999"),
        (["PC001"], ["a", "NULL", "NULL", "d", "e"], "Unknown"),
        ([], ["null", "null", "null", "null"], "-998"),
        (["PC001"], ["null", "null", "null", "null"], "Unknown"),
        (["PC001", "PC002"], ["PC001", "PC002", "0", "0", "PC009"], "-997"),
        (["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "x"], "-997"),
        ([], [], "Unknown"),
    ]
    df = spark.createDataFrame([d[:2] for d in data], "c array<string>, p array<string>")
    got = [r[0] for r in df.select(nested.priority_list(F.col("c"), F.col("p"))).collect()]
    assert got == [[d[2]] * 4 for d in data]


def test_zero_months(spark, rows):
    lists = [("a", ",".join(["0"] * 9 + ["5"])), ("b", "0,1,0.0"), ("c", "x,y"), ("d", None)]
    df = inline_rows(spark, lists, "customer_id string, months string")
    assert rows(nested.zero_months(df, "customer_id", "months")) == [("a", 9, 1, 1331), ("b", 2, 0, 0), ("c", 0, 0, 0), ("d", 0, 0, 0)]


def test_adverse_label_of_nothing(spark, rows):
    df = spark.createDataFrame([], "a array<int>")
    assert rows(nested.adverse_label(df, "a")) == [("customer is not adverse",)]


def test_join_dates_stay_in_range(spark):
    made = datagen.customer_columns(spark.range(5000), ["id"])
    low, high, ids = made.agg(F.min("Joindate").cast("string"), F.max("Joindate").cast("string"), F.min("customerid")).first()
    assert "2004-01-01" <= low and high <= "2020-06-01" and ids >= 300000


def test_ten_digit_ids(spark):
    got = [r[0] for r in spark.range(1000).select(datagen.ten_digit_id(["id"])).collect()]
    assert all(len(g) == 10 and g[0] != "0" for g in got)


def test_scramble_keeps_nulls_booleans_and_nested(spark):
    df = spark.createDataFrame([(1, None, True, [1, 2], "abc", 2.5)], "id int, a int, b boolean, c array<int>, d string, e float")
    row = datagen.scramble(df, ["id"], keep=["id"]).first()
    assert (row["id"], row["a"], row["b"], row["c"]) == (1, None, True, [1, 2])
    assert len(row["d"]) == 10 and row["d"].isalpha() and 0 <= row["e"] <= 100


def test_sums_keep_their_fractions(spark, rows):
    df = spark.createDataFrame([("a", 0.004, 1, Decimal("1.25")), ("a", 0.004, 2, Decimal("2.50"))], "g string, d double, i int, m decimal(10,2)")
    assert aggregates.sum_by(df, ["g"], "d", "t").first()["t"] == 0.008
    assert aggregates.sum_by(df, ["g"], "i", "t").dtypes[1] == ("t", "bigint")
    assert aggregates.sum_by(df, ["g"], "m", "t").first()["t"] == Decimal("3.75")
    halves = spark.createDataFrame([(0.5, [0.5, None, 0.5]), (0.5, [])], "v double, l array<double>")
    assert aggregates.column_sum(halves, "v", "t").first()["t"] == 1.0
    assert [r[0] for r in halves.select(nested.array_total(F.col("l"))).collect()] == [1.0, 0.0]
    large = spark.createDataFrame([("a", 1e17), ("a", 1e17)], "g string, v double")
    assert aggregates.sum_by(large, ["g"], "v", "t", scale=2).first()["t"] == 2e17
    assert aggregates.totals_by_type(large, F.col("g"), F.col("v"), {"a": "x", "b": "y"}).first() == (2e17, 0.0)


def test_text_after_letters_whose_case_changes_length(spark):
    df = spark.createDataFrame([("İa1a2",), ("xA.a|y",)], "s string")
    assert [r[0] for r in df.select(text.after_nth(F.col("s"), "a", 2)).collect()] == ["2", "|y"]


def test_unique_ten_digit_ids_never_meet(spark):
    n = 1_000_000
    ids = spark.range(n).select(datagen.unique_ten_digit_id(F.col("id") * 8999).alias("i"))
    found = ids.agg(F.count_distinct("i"), F.min(F.length("i")), F.max(F.length("i"))).first()
    assert tuple(found) == (n, 10, 10)
    ends = spark.createDataFrame([(0,), (8_999_999_999,), (None,)], "k bigint")
    got = [r[0] for r in ends.select(datagen.unique_ten_digit_id("k")).collect()]
    assert got[2] is None and all(10**9 <= int(x) < 10**10 for x in got[:2])
    with pytest.raises(Exception, match="no ten-digit id"):
        spark.range(1).select(datagen.unique_ten_digit_id(F.lit(-1))).collect()
