"""Scalar text and date functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from .registry import query, table


@query(
    "phone_format",
    """
    SELECT c_custkey, substr(p, 1, 3) || '-' || substr(p, 4, 3) || '-' || substr(p, 7, 4) AS phone
    FROM (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '1') AS p FROM customer)
    """,
)
def phone_format(spark, sf):
    number = F.lpad(F.col("c_custkey").cast("string"), 10, "1")
    return table(spark, sf, "customer").select("c_custkey", text.phone_format(number).alias("phone"))


@query(
    "after_nth",
    """
    SELECT doc_id, CASE WHEN len(parts) > 2 THEN substr(text, len(array_to_string(parts[1:2], 'a')) + 2) ELSE '' END AS rest
    FROM (SELECT doc_id, text, string_split(lower(text), 'a') AS parts FROM documents)
    """,
)
def after_nth(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.after_nth(F.col("text"), "A", 2).alias("rest"))


_PRICE = "CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) WHEN o_orderpriority <> '5-LOW' THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END"


def _prices(spark, sf):
    """Prices as text: with a fraction, without one, or NULL."""
    price = F.when(
        F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    ).when(F.col("o_orderpriority") != "5-LOW", F.floor("o_totalprice").cast("string"))
    return table(spark, sf, "orders").withColumn("price", price)


@query(
    "marker_append",
    f"""
    SELECT o_orderkey, CASE
        WHEN instr(p, '.') > 0 AND substr(p, instr(p, '.') - 1, 1) <> '1'
          THEN substr(p, 1, instr(p, '.') - 1) || '1' || substr(p, instr(p, '.'))
        ELSE p END AS modified_value
    FROM (SELECT o_orderkey, {_PRICE} AS p FROM orders) WHERE p IS NOT NULL
    """,
)
def marker_append(spark, sf):
    return text.marker_append_rows(_prices(spark, sf), "price").select("o_orderkey", "modified_value")


@query(
    "marker_replace",
    f"""
    SELECT o_orderkey, CASE WHEN m = 1 AND c NOT IN ('0762', '4208', '4199')
        THEN regexp_replace(p, '[0-9](\\.|$)', '1\\1') ELSE p END AS limit_text
    FROM (SELECT o_orderkey, {_PRICE} AS p, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS m,
                 CASE o_orderpriority WHEN '1-URGENT' THEN '0762' WHEN '2-HIGH' THEN '76' ELSE '1295' END AS c FROM orders)
    """,
)
def marker_replace(spark, sf):
    code = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "0762").when(F.col("o_orderpriority") == "2-HIGH", "76").otherwise("1295")
    )
    marker = (F.col("o_totalprice") > 100000).cast("int")
    return _prices(spark, sf).select(
        "o_orderkey", text.marker_replace(marker, code, F.col("price")).alias("limit_text")
    )


@query(
    "split_number",
    f"""
    SELECT o_orderkey, split_part(p, '.', 1) AS integer_part, split_part(p, '.', 2) AS decimal_part
    FROM (SELECT o_orderkey, {_PRICE} AS p FROM orders)
    """,
)
def split_number(spark, sf):
    return _prices(spark, sf).select("o_orderkey", text.split_number(F.col("price")).alias("n")).select("o_orderkey", "n.*")


@query(
    "filename_date",
    """
    SELECT o_orderkey,
           CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso_date,
           CASE WHEN o_orderstatus <> 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS dmy_date
    FROM orders
    """,
)
def filename_date(spark, sf):
    day = F.col("o_orderdate")
    iso_name = F.when(
        F.col("o_orderstatus") != "P",
        F.concat(F.lit("orders_"), F.date_format(day, "yyyy-MM-dd"), F.lit("_"), F.col("o_orderkey"), F.lit(".csv")),
    ).otherwise(F.lit("orders_undated_.csv"))
    dmy_name = F.when(
        F.col("o_orderstatus") != "F", F.concat(F.lit("abc-"), F.date_format(day, "dd-MM-yyyy"), F.lit(".txt"))
    ).otherwise(F.lit("abc-99-99-2020.txt"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        text.filename_iso_date(iso_name).cast("string").alias("iso_date"),
        text.filename_dmy_date(dmy_name).cast("string").alias("dmy_date"),
    )


@query(
    "text_lines",
    """
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_pos, lines[i] AS line FROM (
      SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
    """,
)
def text_lines(spark, sf):
    return text.text_lines(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query(
    "parse_list",
    """
    SELECT p_partkey, len(l) AS n, coalesce(array_to_string(l, '|'), '') AS items FROM (
      SELECT p_partkey, CASE WHEN p_size <= 10 THEN [] ELSE [p_name, p_brand, p_type] END AS l FROM part)
    """,
)
def parse_list(spark, sf):
    quoted = F.concat(F.lit('["'), F.concat_ws('","', "p_name", "p_brand", "p_type"), F.lit('"]'))
    listed = F.when(F.col("p_size") <= 10, F.lit("[]")).otherwise(quoted)
    items = table(spark, sf, "part").select("p_partkey", text.parse_list(listed).alias("l"))
    return items.select("p_partkey", F.size("l").cast("bigint").alias("n"), F.array_join("l", "|").alias("items"))


@query(
    "date_plus_ten",
    "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS report_date_10 FROM orders",
)
def date_plus_ten(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.plus_days(F.col("o_orderdate")).cast("string").alias("report_date_10")
    )


@query(
    "anniversary",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%m-%d') = '02-29'",
)
def anniversary(spark, sf):
    orders = table(spark, sf, "orders").where(dates.is_anniversary(F.col("o_orderdate"), "2024-02-29"))
    return orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("date_text", "SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS moment FROM events")
def date_text(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.time_text(F.col("ts")).alias("moment"))
