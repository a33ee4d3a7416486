"""Time an operator against the row-at-a-time or many-jobs way of getting the same rows.

    python benchmarks/pairs.py [SF_DIR]
"""

from __future__ import annotations

import sys
import time
from functools import reduce
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tallyforge.operators import rules, sets  # noqa: E402
from tallyforge.plans.registry import table  # noqa: E402
from tallyforge.plans.row_rules import _MATCH_COLUMNS, _MATCH_RULES  # noqa: E402
from tallyforge.scratch import scratch_path  # noqa: E402
from tallyforge.session import local_session  # noqa: E402
from tallyforge.sinks.writers import write_partitioned  # noqa: E402


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def compiled_rules(spark, sf):
    lines = table(spark, sf, "lineitem")
    given = [dict(zip([*_MATCH_COLUMNS, "expected_value"], r)) for r in _MATCH_RULES]
    drain(lines.select("l_orderkey", rules.first_match(lines, given, _MATCH_COLUMNS).alias("v")))


def udf_rules(spark, sf):
    @F.udf("string")
    def value(number, quantity, flag, discount):
        if number == 1 and 10 < quantity <= 20:
            return "first small"
        if number >= 2 and flag in ("A", "R") and discount < 0.05:
            return "low discount"
        if quantity < 5 or quantity > 45:
            return "edge"
        return "other" if number != 7 and flag != "N" else None

    drain(table(spark, sf, "lineitem").select("l_orderkey", value(*_MATCH_COLUMNS).alias("v")))


def one_partitioned_write(spark, sf):
    write_partitioned(table(spark, sf, "orders"), scratch_path(spark, "pair"), "o_orderpriority")


def write_per_value(spark, sf):
    orders, base = table(spark, sf, "orders"), scratch_path(spark, "pair")
    for (value,) in orders.select("o_orderpriority").distinct().collect():
        part = orders.where(F.col("o_orderpriority") == value)
        part.count()
        part.write.mode("overwrite").parquet(f"{base}/o_orderpriority={value}")


def numbered_copies(spark, sf):
    drain(sets.amplify(table(spark, sf, "customer"), 1_000_000, ["c_custkey"]))


def union_of_copies(spark, sf):
    customers = table(spark, sf, "customer")
    copies = reduce(DataFrame.union, [customers] * (-(-1_000_000 // customers.count())))
    drain(copies.limit(1_000_000))


PAIRS = {
    "first-match rules": (compiled_rules, udf_rules),
    "partitioned write": (one_partitioned_write, write_per_value),
    "amplify to 1,000,000 rows": (numbered_copies, union_of_copies),
}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, "pairs")
    spark.sparkContext.setLogLevel("OFF")
    for name, ways in PAIRS.items():
        took = []
        for way in ways:
            way(spark, sf)
            began = time.perf_counter()
            way(spark, sf)
            took.append(time.perf_counter() - began)
        print(f"{name}: {took[0]:.2f} s against {took[1]:.2f} s", flush=True)


if __name__ == "__main__":
    main()
