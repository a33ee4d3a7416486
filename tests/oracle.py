"""Run a query in Spark and its SQL statement in DuckDB on the same tables, and compare whole results."""

from __future__ import annotations

import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else float(f"{value:.12g}")
    return value


def _kind(value):
    return "number" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, Counter(tuple(_plain(row[i]) for i in at) for row in cursor.fetchall())


def differences(df, con, sql) -> str | None:
    names, got = spark_rows(df)
    want_names, want = duck_rows(con, sql)
    if names != want_names:
        return f"columns {names} vs {want_names}"
    if got != want:
        return f"rows {sum(got.values())} vs {sum(want.values())}: only spark {list((got - want).items())[:3]}, only sql {list((want - got).items())[:3]}"
    for a, b in zip(next(iter(got), ()), next(iter(want), ())):
        if a is not None and b is not None and _kind(a) != _kind(b):
            return f"types {type(a)} vs {type(b)}"
    return None
