"""Repeatable test data: every value follows from a salt and the row's key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.uniform import hex_to_long, key_digest, uniform
from .joins import extra_rows

# Ranges and choices of the generated columns.
CUSTOMER_ID_RANGE = (300000, 400000)
JOIN_DATE_RANGE = (dt.date(2004, 1, 1), dt.date(2020, 6, 2))
EMPLOYMENT_CODES = ("05", "04")
SCORES = (880, 879)
PD_SCORES = (0.5, 1.2, 3.4, 2.8, 4.1, 5.0)
SMALL_FLOAT_RANGE = (0.001, 0.110)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
TEXT_LENGTH = 10
RECORD_KEY_PREFIX = "RecordKey_"
KNOWN_SCENARIOS = tuple(f"scenario_{i}" for i in range(40))


# A grid with a cell for each ten-digit number.
ID_ROWS, ID_COLUMNS, ID_ROUNDS = 90_000, 100_000, 6


def int_between(salt: str, keys: Sequence[str], low: int, high: int) -> Column:
    """Whole number in ``[low, high)``."""
    return (F.floor(uniform(salt, *keys) * F.lit(high - low)) + F.lit(low)).cast("bigint")


def customer_columns(df: DataFrame, keys: Sequence[str], salt: str = "customer") -> DataFrame:
    """``customerid, Empstatus, BACS, Howner, Joindate`` for each row."""
    first, last = JOIN_DATE_RANGE
    days = int_between(f"{salt}:Joindate", keys, 0, (last - first).days).cast("int")
    return df.withColumns(
        {
            "customerid": int_between(f"{salt}:customerid", keys, *CUSTOMER_ID_RANGE).cast("int"),
            "Empstatus": F.when(uniform(f"{salt}:Empstatus", *keys) < 0.5, EMPLOYMENT_CODES[0]).otherwise(
                EMPLOYMENT_CODES[1]
            ),
            "BACS": (uniform(f"{salt}:BACS", *keys) < 0.5).cast("int"),
            "Howner": (uniform(f"{salt}:Howner", *keys) < 0.5).cast("int"),
            "Joindate": F.date_add(F.lit(first), days),
        }
    )


def two_valued_score(keys: Sequence[str], salt: str = "score") -> Column:
    high, low = SCORES
    return F.when(uniform(salt, *keys) > 0.5, F.lit(high)).otherwise(F.lit(low)).cast("bigint")


def pick(values: Sequence[object], keys: Sequence[str], salt: str = "pick") -> Column:
    position = F.floor(uniform(salt, *keys) * F.lit(len(values))).cast("int")
    return F.get(F.array(*[F.lit(v) for v in values]), position)


def ten_digit_id(keys: Sequence[str], salt: str = "id10") -> Column:
    return int_between(salt, keys, 10**9, 10**10).cast("string")


def unique_ten_digit_id(key: Column | str, salt: str = "unique10", rounds: int = ID_ROUNDS) -> Column:
    """Ten digits for a whole number from 0 to 8,999,999,999, never the same for two numbers; NULL stays NULL.

    A keyed permutation of all ten-digit numbers: the key's place is a cell of a grid of 90,000 rows and 100,000 columns, and each round
    moves it along its column or its row by a digest of the other coordinate, which can be undone. A key outside is an error.
    """
    number = (F.col(key) if isinstance(key, str) else key).cast("bigint")
    inside = number.isNull() | number.between(0, ID_ROWS * ID_COLUMNS - 1)
    number = F.when(inside, number).otherwise(F.raise_error(F.lit("a key has no ten-digit id of its own")).cast("bigint"))

    def step(place: Column, i: int) -> Column:
        row, column = place["row"], place["column"]
        if i % 2:
            row = F.pmod(row + hex_to_long(F.substring(key_digest(f"{salt}:{i}", column), 1, 13)), F.lit(ID_ROWS))
        else:
            column = F.pmod(column + hex_to_long(F.substring(key_digest(f"{salt}:{i}", row), 1, 13)), F.lit(ID_COLUMNS))
        return F.struct(row.alias("row"), column.alias("column"))

    row = F.floor(number / F.lit(ID_COLUMNS).cast("decimal(10,0)")).cast("bigint")
    places = F.array(F.struct(row.alias("row"), F.pmod(number, F.lit(ID_COLUMNS)).cast("bigint").alias("column")))
    for i in range(rounds):
        places = F.transform(places, lambda place: step(place, i))  # called at once
    place = F.get(places, F.lit(0))
    return (place["row"] * F.lit(ID_COLUMNS) + place["column"] + F.lit(10**9)).cast("string")


def small_float(keys: Sequence[str], salt: str = "small") -> Column:
    low, high = SMALL_FLOAT_RANGE
    return F.round(F.lit(low) + uniform(salt, *keys) * F.lit(high - low), 3)


def random_text(keys: Sequence[str], salt: str) -> Column:
    """Ten lower-case letters, each from three digits of one digest."""
    digest = key_digest(salt, *keys)

    def letter(i: int) -> Column:
        share = hex_to_long(F.substring(digest, 3 * i + 1, 3)) * F.lit(len(LETTERS))
        return F.substr(F.lit(LETTERS), (F.floor(share / F.lit(4096)) + 1).cast("int"), F.lit(1))

    return F.concat(*[letter(i) for i in range(TEXT_LENGTH)])


def scramble(df: DataFrame, keys: Sequence[str], salt: str = "scramble", keep: Sequence[str] = ()) -> DataFrame:
    """Replace every value by a random one of its type; NULLs, booleans and nested values stay."""

    def new(field: T.StructField) -> Column:
        old, own = F.col(f"`{field.name}`"), f"{salt}:{field.name}"
        if field.name in keep:
            return old
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            value = (uniform(own, *keys) * F.lit(100.0)).cast(field.dataType)
        elif isinstance(field.dataType, T.IntegralType):
            value = int_between(own, keys, 0, 101).cast(field.dataType)
        elif isinstance(field.dataType, T.StringType):
            value = random_text(keys, own)
        else:
            return old
        return F.when(old.isNotNull(), value).alias(field.name)

    return df.select(*[new(f) for f in df.schema.fields])


def generated_rounds(
    df: DataFrame,
    keys: Sequence[str],
    process: Callable[[DataFrame], DataFrame],
    scenario: str = "scenario_id",
    known: Sequence[str] = KNOWN_SCENARIOS,
    rounds: int = 10,
    salt: str = "rounds",
) -> DataFrame:
    """Rows with scenario ids not yet known, over ``rounds`` scrambled copies of the input.

    All rounds are one job: a round number joins the key, and ``process`` (the
    job under test) sees every round's rows with that number.
    """
    copies = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    made = scramble(copies, ["round", *keys], salt, keep=["round", *keys])
    return extra_rows(process(made), scenario, known)


def rounds_report(found: DataFrame, scenario: str = "scenario_id") -> DataFrame:
    """New ids and rows of each round, counted apart."""
    return found.groupBy("round").agg(
        F.count_distinct(scenario).alias("new_ids"), F.count(F.lit(1)).alias("n_rows")
    )


def key_series(
    spark: SparkSession, ranges: dict[str, tuple[int, int]], prefix: str = RECORD_KEY_PREFIX
) -> DataFrame:
    """``table_name, sys_recordkey`` for each table's inclusive number range."""
    parts = [
        spark.range(first, last + 1).select(
            F.lit(name).alias("table_name"), F.concat(F.lit(prefix), F.col("id").cast("string")).alias("sys_recordkey")
        )
        for name, (first, last) in ranges.items()
    ]
    return reduce(DataFrame.unionByName, parts)
