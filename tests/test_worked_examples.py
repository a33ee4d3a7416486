"""Worked input/output pairs."""

from pyspark.sql import functions as F

from tallyforge.functions import nested, text
from tallyforge.operators import aggregates, joins, ordering, rules, shape
from tallyforge.sources.readers import inline_rows


def test_serials_within_type(spark, rows):
    products = inline_rows(spark, [(123, "ABC"), (123, "DEF"), (123, "GHI"), (456, "JKL"), (456, "MNO"), (456, "PQR")], "type int, name string")
    numbered = ordering.group_serial(products, ["type"], ["name"])
    assert rows(numbered) == [(123, "ABC", 1), (123, "DEF", 2), (123, "GHI", 3), (456, "JKL", 1), (456, "MNO", 2), (456, "PQR", 3)]


def test_city_with_most_people(spark, rows):
    cities = inline_rows(spark, [("Pune", 50000000), ("Nashik", 8000000), ("Aurangabad", 6000000)], "city string, population bigint")
    assert rows(aggregates.value_at_max(cities, [], "city", "population", "city")) == [("Pune",)]


def test_join_sizes_of_repeated_keys(spark, rows):
    left = inline_rows(spark, [(k,) for k in (1, 1, 1, 2, 2, 2, 3, 3)], "k int")
    right = inline_rows(spark, [(k,) for k in (1, 1, 2, 2, 3, 3)], "k int")
    assert rows(joins.join_sizes(left, right, ["k"])) == [("inner", 16), ("left", 16), ("right", 16)]
    for how in ("inner", "left", "right"):
        assert left.join(right, "k", how).count() == 16


def test_cities_of_states(spark, rows):
    pairs = [("Maharashtra", "Pune"), ("Karnataka", "Bengaluru"), ("Tamil Nadu", "Chennai"), ("Maharashtra", "Nashik"),
             ("Tamil Nadu", "Vellore"), ("Karnataka", "Mangalore"), ("Maharashtra", "Mumbai")]
    listed = aggregates.group_list(inline_rows(spark, pairs, "state string, city string"), ["state"], "city", "cities")
    assert rows(listed.drop("chunk")) == [
        ("Karnataka", "Bengaluru, Mangalore"), ("Maharashtra", "Mumbai, Nashik, Pune"), ("Tamil Nadu", "Chennai, Vellore"),
    ]


def test_long_lists_go_on_in_further_rows(spark, rows):
    pairs = [("a", f"v{i}") for i in range(5)] + [("b", "w")]
    df = inline_rows(spark, pairs, "g string, v string")
    assert rows(aggregates.group_list(df, ["g"], "v", "l", chunk=2)) == [
        ("a", 0, "v0, v1"), ("a", 1, "v2, v3"), ("a", 2, "v4"), ("b", 0, "w"),
    ]


def test_credit_and_debit(spark, rows):
    moves = inline_rows(spark, [(1, "c", 500), (1, "c", 800), (1, "d", 400), (2, "c", 900), (2, "d", 500)], "cust_id int, type string, amount int")
    types = {"c": "credit", "d": "debit"}
    args = (moves, F.col("type"), F.col("amount"), types)
    assert rows(aggregates.totals_by_type(*args, ["cust_id"])) == [(1, 1300.0, 400.0), (2, 900.0, 500.0)]
    assert rows(aggregates.totals_by_type(*args)) == [(2200.0, 900.0)]


def test_count_of_nothing_is_zero(spark, rows):
    assert rows(aggregates.row_count(spark.range(5).where("id > 9"))) == [(0,)]


def test_text_after_second_letter(spark, rows):
    df = inline_rows(spark, [("Maharashtra",), ("Mah",), (None,)], "s string")
    assert [r[0] for r in df.select(text.after_nth(F.col("s"), "A", 2)).collect()] == ["rashtra", "", None]


def test_phone(spark, rows):
    assert rows(inline_rows(spark, [("1234567890",)], "n string").select(text.phone_format(F.col("n")))) == [("123-456-7890",)]


def test_gender_swap(spark, rows):
    df = inline_rows(spark, [(1, "F"), (2, "M"), (3, "x"), (4, None)], "id int, g string")
    assert rows(df.select("id", shape.swap_codes(F.col("g")))) == [(1, "M"), (2, "F"), (3, None), (4, None)]


def test_activities(spark, rows):
    kind = "user_id int, activities array<struct<date:string,activity:string>>"
    data = [(1, [("2023-01-01", "login"), ("2023-01-02", "purchase")]), (2, [("2023-01-01", "browse"), ("2023-01-03", "logout")])]
    exploded = nested.explode_structs(spark.createDataFrame(data, kind), "activities", ["user_id"])
    assert rows(exploded) == [(1, "2023-01-01", "login"), (1, "2023-01-02", "purchase"), (2, "2023-01-01", "browse"), (2, "2023-01-03", "logout")]


def test_jane_becomes_35(spark):
    kind = "id int, persons array<struct<name:string,age:int>>"
    df = spark.createDataFrame([(1, [("John", 25), ("Alice", 30)]), (2, [("Bob", 28), ("Jane", None)])], kind)
    updated = df.select(nested.update_by_predicate(F.col("persons"), lambda p: p["name"] == "Jane", "age", F.lit(35)))
    assert [[tuple(p) for p in r[0]] for r in updated.collect()] == [[("John", 25), ("Alice", 30)], [("Bob", 28), ("Jane", 35)]]


def test_scenario_space(spark, rows):
    domains = {
        "New_Marker": [0, 1],
        "Code": ["0762", "4208", "4199", "9876", "6546", "2354", "1295"],
        "Limit": [-1000, -1001, -1002, -1003, -1004, -1005, -1006, -1007, -1008, -1009, -2000],
    }
    space = joins.value_space(spark.range(0), domains, "idx").orderBy("idx").collect()
    assert len(space) == 154
    assert tuple(space[0]) == (1, 0, "0762", -1000)
    assert tuple(space[11]) == (12, 0, "4208", -1000)
    assert tuple(space[153]) == (154, 1, "1295", -2000)
    assert len(set(rows(joins.value_space(spark.range(0), {c: [1, 0, None] for c in "abc"})))) == 27


def test_comparison_rules(spark, rows):
    given = [{"column": "age", "condition": ">", "value": 30}, {"column": "salary", "condition": "<=", "value": 50000}]
    people = inline_rows(spark, [(25, 30000), (35, 60000), (40, 40000)], "age int, salary int")
    assert rows(people.where(rules.rule_filter(given))) == [(40, 40000)]


def test_action_lookup(spark, rows):
    actions = inline_rows(spark, [(1, "52", "a"), (2, "51", "b"), (3, "52", "c")], "pos int, value string, action string")
    values = inline_rows(spark, [(52,), (51,), (60,)], "column_value int")
    first = joins.lookup_first(values, actions, "column_value", "value", "action", "pos", "flag")
    assert rows(first) == [(51, "b"), (52, "a"), (60, None)]
    every = joins.lookup_all(values, actions, "column_value", "value", "action", "flag")
    assert rows(every) == [(51, "b"), (52, "a"), (52, "c"), (60, None)]


def test_fill_nulls_in_listed_columns(spark, rows):
    df = inline_rows(spark, [(1, None), (2, 3), (None, 4)], "a int, b int")
    assert df.transform(shape.fill_nulls, ["a"]).collect() == [(1, None), (2, 3), (0, 4)]


def test_policy_codes(spark):
    codes = F.split(F.lit("PC002,PC001,PC005,PC003"), ",")
    reference = ["PC001", "PC002", "PC003", "PC004", "PC005"]
    row = spark.range(1).select(nested.policy_order(codes, reference), nested.policy_order_padded(codes, reference)).first()
    assert row[0] == ["PC001", "PC002", "PC003", "PC005"]
    assert row[1] == ["PC001", "PC002", "PC003", "0"]


def test_decisions(spark, rows):
    decisions = {"PC002": "V1", "PC003": "V2", "PC001": "V3"}
    df = inline_rows(spark, [("PC002",), ("PC003",), ("PC001",), ("PC00",), (None,)], "c string")
    assert [r[0] for r in df.select(nested.code_decision(F.col("c"), decisions)).collect()] == ["V1", "V2", "V3", "V99", "V99"]
