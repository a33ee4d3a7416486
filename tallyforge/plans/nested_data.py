"""Arrays, structs, maps and JSON text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested
from ..operators.records import edit_records, read_records
from .registry import query, table

# --- sums and labels over lists ---------------------------------------------

_SCALED = "SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 100) AS BIGINT)) AS v FROM embeddings"


def _scaled(spark, sf, factor=100):
    """Whole-number lists from the vectors."""
    scaled = F.transform("embedding", lambda x: F.floor(x * F.lit(float(factor))))
    return table(spark, sf, "embeddings").select("vec_id", scaled.alias("v"))


@query("array_sum", f"SELECT vec_id, CAST(list_sum(v) AS BIGINT) AS total FROM ({_SCALED})")
def array_sum(spark, sf):
    return _scaled(spark, sf).select("vec_id", nested.array_total(F.col("v"), "bigint").alias("total"))


_ONES = "SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.2 THEN 1 ELSE 0 END) AS v FROM embeddings"


def _ones(spark, sf):
    flags = F.transform("embedding", lambda x: F.when(x > 0.2, 1).otherwise(0))
    return table(spark, sf, "embeddings").select("vec_id", flags.alias("v"))


@query(
    "adverse_label",
    f"""
    SELECT CASE WHEN coalesce(sum(list_sum(v)), 0) >= 9 THEN 'customer is adverse'
                ELSE 'customer is not adverse' END AS customer_status FROM ({_ONES})
    """,
)
def adverse_label(spark, sf):
    return nested.adverse_label(_ones(spark, sf), "v")


@query(
    "adverse_label_by_row",
    f"""
    SELECT vec_id, CASE WHEN list_sum(v) >= 9 THEN 'customer is adverse' ELSE 'customer is not adverse' END AS customer_status
    FROM ({_ONES})
    """,
)
def adverse_label_by_row(spark, sf):
    return nested.adverse_label_by_row(_ones(spark, sf), "v").drop("v")


@query(
    "zero_months",
    """
    SELECT vec_id, CAST(n AS INTEGER) AS zero_months, CASE WHEN n >= 9 THEN 1 ELSE 0 END AS flag, CASE WHEN n >= 9 THEN 1331 ELSE 0 END AS value
    FROM (SELECT vec_id, len(list_filter(list_transform(embedding, lambda x: floor(x * 10)), lambda x: x = 0)) AS n FROM embeddings)
    """,
)
def zero_months(spark, sf):
    lists = _scaled(spark, sf, 10).select("vec_id", F.array_join(F.col("v").cast("array<string>"), ",").alias("months"))
    return nested.zero_months(lists, "vec_id", "months")


# --- arrays of structs ------------------------------------------------------

_WORDS = "SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations"


def _worded(spark, sf):
    """Conversation turns with their words as structs; the word is NULL where it is short."""
    words = F.transform(
        F.split("text", " "),
        lambda w, k: F.struct(F.when(F.length(w) > 2, w).alias("word"), (k + 1).alias("pos")),
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", words.alias("words"))


@query(
    "explode_structs",
    f"""
    SELECT conv_id, turn, CASE WHEN len(w[i]) > 2 THEN w[i] END AS word, CAST(i AS INTEGER) AS pos
    FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM ({_WORDS}))
    """,
)
def explode_structs(spark, sf):
    return nested.explode_structs(_worded(spark, sf), "words", ["conv_id", "turn"])


@query(
    "repeat_rows",
    "SELECT c_custkey, c_name, CAST(copy AS INTEGER) AS copy FROM customer, (SELECT unnest(range(1, 7)) AS copy)",
)
def repeat_rows(spark, sf):
    return nested.repeat_rows(table(spark, sf, "customer").select("c_custkey", "c_name"), 6, "copy")


@query(
    "repeat_per_value",
    "SELECT c_custkey, c_name, col FROM customer, (SELECT unnest(['A', 'B', 'C', 'D', 'E', 'F']) AS col)",
)
def repeat_per_value(spark, sf):
    return nested.repeat_per_value(table(spark, sf, "customer").select("c_custkey", "c_name"), list("ABCDEF"))


@query(
    "element_field",
    f"SELECT conv_id, turn, w[6] AS sixth, TRY_CAST(w[6] AS INTEGER) AS sixth_number, len(w[51]) AS length_51 FROM ({_WORDS})",
)
def element_field(spark, sf):
    words = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("value")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("words"))
    return rows.select(
        "conv_id",
        "turn",
        nested.element_field(F.col("words"), 5, "value").alias("sixth"),
        nested.element_field(F.col("words"), 5, "value", "int").alias("sixth_number"),
        F.length(nested.element_field(F.col("words"), 50, "value")).cast("bigint").alias("length_51"),
    )


@query(
    "update_at_index",
    f"""
    SELECT conv_id, turn, array_to_string(list_transform(w, lambda x, i:
             CASE WHEN len(x) > 2 THEN x WHEN i = 3 THEN '10' ELSE '-' END), ' ') AS words FROM ({_WORDS})
    """,
)
def update_at_index(spark, sf):
    updated = nested.update_at_index(F.col("words"), 2, "word", F.lit("10"))
    shown = F.array_join(F.transform(updated, lambda x: x["word"]), " ", "-")
    return _worded(spark, sf).select("conv_id", "turn", shown.alias("words"))


@query(
    "update_by_predicate",
    f"""
    SELECT conv_id, turn, array_to_string(list_transform(w, lambda x, i:
             CASE WHEN len(x) > 2 AND x = 'the' THEN '35' ELSE CAST(i AS VARCHAR) END), ' ') AS positions FROM ({_WORDS})
    """,
)
def update_by_predicate(spark, sf):
    updated = nested.update_by_predicate(F.col("words"), lambda x: x["word"] == "the", "pos", F.lit(35))
    shown = F.array_join(F.transform(updated, lambda x: x["pos"].cast("string")), " ")
    return _worded(spark, sf).select("conv_id", "turn", shown.alias("positions"))


# --- JSON text --------------------------------------------------------------


@query(
    "json_array_parse",
    """
    SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS key1,
           CASE WHEN event_type <> 'error' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS key2
    FROM events
    """,
)
def json_array_parse(spark, sf):
    """Cells ``[{"key1": ..., "key2": ...}]``; those of error events are cut off and give NULL."""
    cell = F.concat(
        F.lit('[{"key1": "'), F.col("event_type"), F.lit('", "key2": '), F.get_json_object("props", "$.k"), F.lit("}]")
    )
    broken = F.substr(cell, F.lit(1), F.length(cell) - 2)
    events = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") == "error", broken).otherwise(cell).alias("cell")
    )
    parsed = nested.parse_json_array(events, "cell", "array<struct<key1:string,key2:int>>")
    first = F.get("parsed_json", F.lit(0))
    return parsed.select("event_id", first["key1"].alias("key1"), first["key2"].alias("key2"))


@query(
    "json_cell_parse",
    """
    SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE json_extract_string(props, '$.k') END AS k,
           event_type = 'error' AS is_bad
    FROM events
    """,
)
def json_cell_parse(spark, sf):
    """Error events carry a broken cell, view events an empty one."""
    cell = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("{"), F.col("props")))
        .when(F.col("event_type") == "view", F.lit(""))
        .otherwise(F.col("props"))
    )
    parsed = table(spark, sf, "events").select("event_id", nested.parse_json_cell(cell).alias("p"))
    return parsed.select("event_id", F.try_element_at("p.cell", F.lit("k")).alias("k"), F.col("p.is_bad").alias("is_bad"))


def _documents(spark, sf, *also):
    """Events as nested records: a struct holding a list of structs."""
    return table(spark, sf, "events").select(
        "event_id",
        *also,
        F.struct(
            F.col("event_type").alias("type"),
            F.array(
                F.struct(F.col("user_id").alias("id"), F.lit("user").alias("kind")),
                F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("id"), F.lit("prop").alias("kind")),
            ).alias("refs"),
        ).alias("body"),
    )


@query(
    "path_get",
    """
    SELECT event_id, event_type AS type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS second_id,
           CAST(NULL AS BIGINT) AS past_end, CAST(NULL AS VARCHAR) AS absent
    FROM events
    """,
)
def path_get(spark, sf):
    df = _documents(spark, sf)
    return df.select(
        "event_id",
        nested.path_get(df, "body.type").alias("type"),
        nested.path_get(df, "body.refs.1.id").alias("second_id"),
        nested.path_get(df, "body.refs.7.id").alias("past_end"),
        nested.path_get(df, "body.nothing.here").alias("absent"),
    )


@query(
    "json_path",
    """
    SELECT event_id, CAST(user_id AS VARCHAR) AS first_id, json_extract_string(props, '$.k') AS second_id,
           CAST(NULL AS VARCHAR) AS absent FROM events
    """,
)
def json_path(spark, sf):
    rows = _documents(spark, sf).select("event_id", F.to_json("body").alias("j"))
    return rows.select(
        "event_id",
        nested.json_path(F.col("j"), "refs.0.id").alias("first_id"),
        nested.json_path(F.col("j"), "refs.1.id").alias("second_id"),
        nested.json_path(F.col("j"), "refs.2.id").alias("absent"),
    )


@query(
    "path_set",
    """
    SELECT event_id, CASE WHEN hit THEN 'edited' ELSE event_type END AS type, user_id AS first_id,
           CASE WHEN hit THEN 77 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS second_id
    FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) BETWEEN 100 AND 700 AS hit FROM events)
    """,
)
def path_set(spark, sf):
    """Records 100 to 700 in time order are edited; two of the paths lead nowhere and are skipped."""
    edits = {"body.type": "edited", "body.refs.1.id": 77, "body.refs.1": 5, "body.none": "x"}
    edited, _ = edit_records(_documents(spark, sf, "ts"), ["ts", "event_id"], 100, 700, edits)
    refs = F.col("body.refs")
    return edited.select(
        "event_id",
        F.col("body.type").alias("type"),
        F.get(refs, F.lit(0))["id"].alias("first_id"),
        F.get(refs, F.lit(1))["id"].alias("second_id"),
    )


@query(
    "read_records",
    """
    SELECT rn AS record, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value
    FROM (SELECT props, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)
    WHERE rn BETWEEN n // 3 AND 2 * n
    """,
)
def nested_records(spark, sf):
    events = _documents(spark, sf, "ts")
    size = events.count()
    return read_records(events, ["ts", "event_id"], "body.refs.1.id", size // 3, 2 * size)


@query(
    "key_lookup",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS absent FROM events",
)
def key_lookup(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        nested.json_key(F.col("props"), "k").alias("k"),
        nested.json_key(F.col("props"), "city").alias("absent"),
    )


# --- code lists -------------------------------------------------------------

_CODES = """
    SELECT p_partkey, list_distinct(['PC00' || (1 + p_partkey % 5), 'PC00' || (1 + p_size % 6), 'PC00' || (1 + length(p_name) % 5),
           'PC00' || (1 + length(p_type) % 5)]) AS codes FROM part
"""
_REFERENCE = ["PC001", "PC002", "PC003", "PC004", "PC005"]


def _coded(spark, sf):
    def code(number, of):
        return F.concat(F.lit("PC00"), (F.lit(1) + number % F.lit(of)).cast("string"))

    codes = F.array(
        code(F.col("p_partkey"), 5), code(F.col("p_size"), 6), code(F.length("p_name"), 5), code(F.length("p_type"), 5)
    )
    return table(spark, sf, "part").select("p_partkey", codes.alias("codes"))


@query(
    "policy_order",
    f"""
    SELECT p_partkey, coalesce(array_to_string(list_filter(['PC001', 'PC002', 'PC003', 'PC004', 'PC005'],
             lambda r: list_contains(codes, r))[1:4], ','), '') AS ordered FROM ({_CODES})
    """,
)
def policy_order(spark, sf):
    ordered = nested.policy_order(F.col("codes"), _REFERENCE)
    return _coded(spark, sf).select("p_partkey", F.array_join(ordered, ",").alias("ordered"))


@query(
    "policy_order_padded",
    f"""
    SELECT p_partkey, array_to_string(list_transform(['PC001', 'PC002', 'PC003', 'PC004', 'PC005'],
             lambda r: CASE WHEN list_contains(codes, r) THEN r ELSE '0' END)[1:4], ',') AS ordered FROM ({_CODES})
    """,
)
def policy_order_padded(spark, sf):
    ordered = nested.policy_order_padded(F.col("codes"), _REFERENCE)
    return _coded(spark, sf).select("p_partkey", F.array_join(ordered, ",").alias("ordered"))


@query(
    "priority_list",
    """
    SELECT o_orderkey, CASE o_orderpriority
             WHEN '1-URGENT' THEN '-999,-999,-999,-999' WHEN '2-HIGH' THEN '-998,-998,-998,-998'
             WHEN '3-MEDIUM' THEN '-997,-997,-997,-997' WHEN '4-NOT SPECIFIED' THEN 'Unknown,Unknown,Unknown,Unknown'
             ELSE CASE WHEN o_orderstatus = 'F' THEN '-997,-997,-997,-997' ELSE 'Unknown,Unknown,Unknown,Unknown' END
           END AS priority
    FROM orders
    """,
)
def priority_list(spark, sf):
    """Earlier codes are made so that each priority value of an order takes one of the rule's branches."""

    def listed(*values):
        return F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]).cast("array<string>")

    own = F.col("o_custkey").cast("string")
    rank = F.col("o_orderpriority")
    codes = F.when(rank == "2-HIGH", F.array().cast("array<string>")).otherwise(listed(own, "PC002"))
    previous = (
        F.when(rank == "1-URGENT", listed("PC001", "PC002", "PC003", "PC004", "NULL"))
        .when(rank == "2-HIGH", listed("null", "null", "null", "null"))
        .when(rank == "3-MEDIUM", listed(own, "PC002", "0", "0", "PC009"))
        .when(rank == "4-NOT SPECIFIED", listed("PC002", own, "0", "0"))
        .otherwise(listed(own, "PC002", "0", F.when(F.col("o_orderstatus") == "F", "0").otherwise("1")))
    )
    orders = table(spark, sf, "orders").select("o_orderkey", codes.alias("codes"), previous.alias("previous"))
    chosen = nested.priority_list(F.col("codes"), F.col("previous"))
    return orders.select("o_orderkey", F.array_join(chosen, ",").alias("priority"))
