"""Generated test data and the customer jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..jobs import customer as jobs
from ..jobs.rounds import run_rounds
from ..operators import datagen
from ..scratch import scratch_path
from ..sinks.writers import write_parquet
from .registry import query, table


def _u(salt: str, key: str = "c_custkey") -> str:
    return f"(('0x' || substr(md5('{salt}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _int(salt: str, low: int, high: int, key: str = "c_custkey") -> str:
    return f"CAST(floor({_u(salt, key)} * {high - low}) + {low} AS BIGINT)"


def _text(salt: str, key: str) -> str:
    digest = f"md5('{salt}:' || {key})"
    letters = [
        f"substr('abcdefghijklmnopqrstuvwxyz', 1 + ('0x' || substr({digest}, {3 * i + 1}, 3))::BIGINT * 26 // 4096, 1)"
        for i in range(10)
    ]
    return " || ".join(letters)


def _keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey")


_KEY = ["c_custkey"]


@query(
    "gen_customers",
    f"""
    SELECT c_custkey, CAST({_int("customer:customerid", 300000, 400000)} AS INTEGER) AS customerid,
           CASE WHEN {_u("customer:Empstatus")} < 0.5 THEN '05' ELSE '04' END AS Empstatus,
           CASE WHEN {_u("customer:BACS")} < 0.5 THEN 1 ELSE 0 END AS BACS,
           CASE WHEN {_u("customer:Howner")} < 0.5 THEN 1 ELSE 0 END AS Howner,
           strftime(DATE '2004-01-01' + CAST({_int("customer:Joindate", 0, 5997)} AS INTEGER), '%Y-%m-%d') AS Joindate
    FROM customer
    """,
)
def gen_customers(spark, sf):
    made = datagen.customer_columns(_keys(spark, sf), _KEY)
    return made.withColumn("Joindate", F.col("Joindate").cast("string"))


@query(
    "gen_score",
    f"SELECT c_custkey, CAST(CASE WHEN {_u('score')} > 0.5 THEN 880 ELSE 879 END AS BIGINT) AS fullscore FROM customer",
)
def gen_score(spark, sf):
    return _keys(spark, sf).withColumn("fullscore", datagen.two_valued_score(_KEY))


@query(
    "gen_pick",
    f"""
    SELECT c_custkey, (['CUST001', 'CUST002', 'CUST003', 'CUST004', 'CUST005'])[CAST(floor({_u("pick")} * 5) AS INTEGER) + 1] AS customerid,
           ([0.5, 1.2, 3.4, 2.8, 4.1, 5.0]::DOUBLE[])[CAST(floor({_u("pd")} * 6) AS INTEGER) + 1] AS pdscore
    FROM customer
    """,
)
def gen_pick(spark, sf):
    names = [f"CUST00{i}" for i in range(1, 6)]
    picked = _keys(spark, sf).withColumn("customerid", datagen.pick(names, _KEY))
    return picked.withColumn("pdscore", datagen.pick(datagen.PD_SCORES, _KEY, "pd"))


@query(
    "gen_id10",
    f"SELECT c_custkey, CAST({_int('id10', 10**9, 10**10)} AS VARCHAR) AS customerid FROM customer",
)
def gen_id10(spark, sf):
    return _keys(spark, sf).withColumn("customerid", datagen.ten_digit_id(_KEY))


@query("gen_small_float", f"SELECT c_custkey, round(0.001::DOUBLE + {_u('small')} * {0.110 - 0.001!r}::DOUBLE, 3) AS x FROM customer")
def gen_small_float(spark, sf):
    return _keys(spark, sf).withColumn("x", datagen.small_float(_KEY))


@query(
    "gen_scramble",
    f"""
    SELECT c_custkey, {_text("scramble:c_name", "c_custkey")} AS c_name,
           CASE WHEN c_acctbal >= 0 THEN CAST({_int("scramble:c_nationkey", 0, 101)} AS INTEGER) END AS c_nationkey,
           {_u("scramble:c_acctbal")} * 100.0::DOUBLE AS c_acctbal, c_mktsegment = 'BUILDING' AS is_building
    FROM customer
    """,
)
def gen_scramble(spark, sf):
    customers = table(spark, sf, "customer").select(
        "c_custkey",
        "c_name",
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("c_nationkey"),
        "c_acctbal",
        (F.col("c_mktsegment") == "BUILDING").alias("is_building"),
    )
    return datagen.scramble(customers, _KEY, keep=_KEY)


@query(
    "gen_rounds",
    f"""
    SELECT round, count(DISTINCT s) AS new_ids, count(*) AS n_rows FROM (
      SELECT round, CAST(floor({_u("rounds:c_acctbal", "round || ':' || c_custkey")} * 100.0::DOUBLE * 0.45::DOUBLE) AS BIGINT) AS s
      FROM customer, (SELECT CAST(unnest(range(10)) AS INTEGER) AS round))
    WHERE s >= 40 GROUP BY round
    """,
)
def gen_rounds(spark, sf):
    """The process under test numbers scenarios 0 to 44; those from 40 up are not known."""

    def process(made):
        number = F.floor(F.col("c_acctbal") * F.lit(0.45)).cast("string")
        return made.withColumn("scenario_id", F.concat(F.lit("scenario_"), number))

    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return run_rounds(customers, _KEY, process, scratch_path(spark, "rounds"))


@query(
    "gen_keys",
    """
    SELECT 'customer' AS table_name, 'RecordKey_' || (2999 + row_number() OVER ()) AS sys_recordkey FROM customer
    UNION ALL SELECT 'orders', 'RecordKey_' || (2999 + row_number() OVER ()) FROM orders
    """,
)
def gen_keys(spark, sf):
    """One key from 3000 up for every row of two tables."""
    ranges = {name: (3000, 2999 + table(spark, sf, name).count()) for name in ("customer", "orders")}
    return datagen.key_series(spark, ranges)


# --- jobs -------------------------------------------------------------------


@query(
    "job_json_csv",
    """
    SELECT event_id, CAST(floor(value + 0.5) AS BIGINT) AS value,
           event_type AS key1, CAST(json_extract_string(props, '$.k') AS INTEGER) AS key2
    FROM (SELECT event_id, event_type, props, CAST(value AS DECIMAL(18,2)) AS value FROM events)
    """,
)
def job_json_csv(spark, sf):
    folder = scratch_path(spark, "job")
    cell = F.concat(F.lit('[{"key1": "'), "event_type", F.lit('", "key2": '), F.get_json_object("props", "$.k"), F.lit("}]"))
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("t.event_id"),
        F.col("value").alias("t.value"),
        F.lit("2024-09-10").alias("t.run_date"),
        cell.alias("t.cells"),
    )
    events.write.csv(f"{folder}/csv", header=True, quote='"', escape='"')
    jobs.json_csv_to_parquet(spark, f"{folder}/csv", "cells", f"{folder}/out", quote='"', escape='"')
    first = F.get("parsed_json", F.lit(0))
    return spark.read.parquet(f"{folder}/out").select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("value").cast("bigint").alias("value"),
        first["key1"].alias("key1"),
        first["key2"].alias("key2"),
    )


@query(
    "job_customer_subset",
    f"""
    SELECT CAST({_int("subset", 10**9, 10**10)} AS VARCHAR) AS customerid, c_name AS name, CAST(1 AS BIGINT) AS userdefinedscore1
    FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
    """,
)
def job_customer_subset(spark, sf):
    path = scratch_path(spark, "job")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("CustomerID"), F.col("c_name").alias("Name"))
    listed = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("customerID"))
    jobs.customer_subset(customers, listed, "customerid", path)
    return spark.read.parquet(path)


@query(
    "job_enrich",
    f"""
    SELECT c_custkey AS customerid, CAST(1 AS BIGINT) AS exp1, CAST(1 AS BIGINT) AS exp2, s AS fullscore,
           c_custkey AS inner_id, s AS inner_score
    FROM (SELECT c_custkey, CAST(CASE WHEN {_u("fullscore")} > 0.5 THEN 880 ELSE 879 END AS BIGINT) AS s FROM customer)
    """,
)
def job_enrich(spark, sf):
    folder = scratch_path(spark, "job")
    write_parquet(_keys(spark, sf).withColumnRenamed("c_custkey", "customerid"), f"{folder}/in")
    jobs.enrich(spark, f"{folder}/in", f"{folder}/out")
    return spark.read.parquet(f"{folder}/out").select(
        "customerid", "exp1", "exp2", "fullscore",
        F.col("exp3.customerid").alias("inner_id"), F.col("exp3.fullscore").alias("inner_score"),
    )


@query(
    "job_rekey",
    "SELECT c_name, 1000179 + row_number() OVER (ORDER BY c_custkey) AS customerid FROM customer",
)
def job_rekey(spark, sf):
    folder = scratch_path(spark, "job")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("customerid"), "c_name")
    write_parquet(customers, f"{folder}/in")
    jobs.rekey(spark, f"{folder}/in", f"{folder}/out", ["customerid"])
    return spark.read.parquet(f"{folder}/out")


def _permuted(rounds: int = datagen.ID_ROUNDS) -> str:
    """SQL of the permutation of c_custkey, a query a round."""
    sql = f"SELECT c_custkey, c_custkey // {datagen.ID_COLUMNS} AS r, c_custkey % {datagen.ID_COLUMNS} AS c FROM customer"
    for i in range(rounds):
        moved, other, size = ("r", "c", datagen.ID_ROWS) if i % 2 else ("c", "r", datagen.ID_COLUMNS)
        shift = f"('0x' || substr(md5('unique10:{i}:' || {other}), 1, 13))::BIGINT"
        sql = f"SELECT c_custkey, ({moved} + {shift}) % {size} AS {moved}, {other} FROM ({sql})"
    return f"SELECT c_custkey, CAST(r * {datagen.ID_COLUMNS} + c + 1000000000 AS VARCHAR) AS customerid FROM ({sql})"


@query("gen_unique_ids", _permuted())
def gen_unique_ids(spark, sf):
    """Ten-digit ids of customers, no two the same."""
    customers = table(spark, sf, "customer")
    return customers.select("c_custkey", datagen.unique_ten_digit_id("c_custkey").alias("customerid"))
