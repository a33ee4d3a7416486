"""The four customer jobs: each a chain of operators from files or tables to Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nested import parse_json_array
from ..operators.datagen import ten_digit_id, two_valued_score, unique_ten_digit_id
from ..operators.joins import keep_listed
from ..operators.ordering import Order, dense_ordinal
from ..operators.shape import cast_all_but, drop_columns, lowercase_columns, pack_struct, strip_prefix, with_constants
from ..sinks.writers import write_parquet
from ..sources.readers import read_csv_inferred, read_parquet

# Element type of the JSON array cells, and the first serial id.
JSON_CELLS = T.ArrayType(T.StructType([T.StructField("key1", T.StringType()), T.StructField("key2", T.IntegerType())]))
FIRST_SERIAL = 1000180


def json_csv_to_parquet(spark: SparkSession, source: str, json_column: str, target: str, **csv: object) -> None:
    """CSV with a JSON-array column: names stripped, cells parsed, ``run_date`` dropped, the rest as decimal(12,0)."""
    table = strip_prefix(read_csv_inferred(spark, source, **csv))
    parsed = parse_json_array(table, json_column, JSON_CELLS)
    write_parquet(cast_all_but(drop_columns(parsed, "run_date"), ["parsed_json"]), target, "overwrite")


def customer_subset(
    customers: DataFrame, listed: DataFrame, key: str, target: str, salt: str = "subset", unique: bool = False
) -> None:
    """Listed customers with replaced ids and a constant score column, appended to Parquet.

    With ``unique`` the ids are a permutation of the old ones, which must be whole numbers, so that no two customers meet.
    """
    table, keys = lowercase_columns(customers), lowercase_columns(listed)
    kept = keep_listed(table, keys, [key])
    renamed = kept.withColumn(key, unique_ten_digit_id(key, salt) if unique else ten_digit_id([key], salt))
    write_parquet(with_constants(renamed, {"userdefinedscore1": (1, "bigint")}), target, "append")


def enrich(spark: SparkSession, source: str, target: str, key: str = "customerid") -> None:
    """Two constants, a score of 879 or 880, and a struct of id and score."""
    table = with_constants(read_parquet(spark, source), {"exp1": (1, "bigint"), "exp2": (1, "bigint")})
    scored = table.withColumn("fullscore", two_valued_score([key], "fullscore"))
    write_parquet(pack_struct(scored, "exp3", [key, "fullscore"]), target, "overwrite")


def rekey(spark: SparkSession, source: str, target: str, order_by: Order, key: str = "customerid") -> None:
    """Replace the id by a dense serial in the given order (which may still use the old id)."""
    numbered = dense_ordinal(read_parquet(spark, source), order_by, "_serial", FIRST_SERIAL)
    write_parquet(numbered.drop(key).withColumnRenamed("_serial", key), target, "overwrite")
