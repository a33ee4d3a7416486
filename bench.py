"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (default 1, median taken), written to
Spark's noop sink so that every row and column is produced. ``--all`` times every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tallyforge.plans import QUERIES
from tallyforge.session import local_session

HEADLINE = [
    "flag_sum", "distinct_users_by_type", "bucket_counts", "duplicate_keys", "credit_debit_by_customer",
    "group_list", "argmax_in_group", "null_profile", "first_per_group", "group_serial",
    "group_serial_large_groups", "running_total", "record_range", "dense_serial", "top_n", "amplify",
    "semi_by_key_list", "left_join", "anti_join", "star_join_active", "star_join_all", "join_multiplicity",
    "scenario_space", "lookup_first", "subtract_rows", "once_only_rows", "rule_filter", "rule_first_match",
    "swap_codes", "after_nth", "text_lines", "explode_structs", "json_cell_parse", "path_get", "policy_order",
    "evidence_sample", "table_equality", "row_diff_summary", "cell_diff", "ordered_compare", "log_metrics",
    "read_csv_schema", "write_partitioned", "ingest_partitioned", "gen_customers", "gen_scramble", "gen_rounds",
    "job_rekey",
]


def run(spark, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("OFF")
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    took = {}
    for name in names:
        run(spark, name, sf_dir)
        took[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(runs)), 4)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total" if names is HEADLINE else "all_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": spark.version,
            }
        )
    )


if __name__ == "__main__":
    main()
