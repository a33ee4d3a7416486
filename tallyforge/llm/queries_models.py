"""Queries on toxicity, vector codes and source divergence."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..scratch import materialize
from . import source_audit, toxicity, vector_codes
from .registry import query, table


@query("op11_toxicity")
def op11_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def _op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The rounds one after the other: books_k are the entries, near_k the entry of each part under them."""
    usable = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
    steps = [
        f"kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, "
        f"list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings "
        f"WHERE {usable} AND len(embedding) > 0 AND len(embedding) % {parts} = 0)",
        "whole AS (SELECT * FROM kept WHERE len(v) = (SELECT len(v) FROM kept WHERE r = 1))",
        f"cut AS (SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x "
        f"FROM whole, (SELECT unnest(range({parts})) AS p))",
        f"books_0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY r) - 1 AS e, x AS y FROM cut "
        f"QUALIFY row_number() OVER (PARTITION BY p ORDER BY r) <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"near_{k} AS (SELECT r, p, x, e, d FROM (SELECT r, cut.p AS p, x, e, "
            f"list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d "
            f"FROM cut JOIN books_{k} b ON cut.p = b.p) QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)"
        )
        if k < rounds:
            steps.append(
                f"means_{k} AS (SELECT p, e, list(m ORDER BY i) AS y FROM (SELECT p, e, i, floor(sum(c) / count(*))::BIGINT AS m "
                f"FROM (SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM near_{k}) GROUP BY p, e, i) GROUP BY p, e)"
            )
            steps.append(
                f"books_{k + 1} AS (SELECT b.p AS p, b.e AS e, coalesce(m.y, b.y) AS y FROM books_{k} b LEFT JOIN means_{k} m ON b.p = m.p AND b.e = m.e)"
            )
    last = rounds
    steps += [
        f"coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near_{last} GROUP BY r)",
        f"digest AS (SELECT sha256(string_agg(list_aggregate(y, 'string_agg', ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books_{last})",
    ]
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 "
        "FROM whole JOIN coded USING (r), digest"
    )


def _digest(books: vector_codes.Codebooks | None) -> str | None:
    if books is None:
        return None
    return hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()


OP12_SQL = _op12_sql()


@query("op12_vector_codes", OP12_SQL)
def op12_vector_codes(spark, sf_dir):
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    code = F.array_join(F.transform("codes", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    # A row a label: written, so that Spark knows its size, joins it as a broadcast or splits a hot label.
    by_label = materialize(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    met = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left")
    return met.select("vec_id", code.alias("code"), "error", "label_error", F.lit(_digest(books)).alias("codebooks_sha256"))


def _op13_sql(min_docs: int = 30, top: int = 50) -> str:
    one = lambda n, total, terms: f"1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * {terms})"
    return rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
    SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {min_docs}
), langs AS (
    SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), counts AS (
    SELECT w.lang AS lang, source, w.term AS term, count(*) AS n FROM w JOIN kept ON w.lang = kept.lang AND w.term = kept.term
    GROUP BY w.lang, source, w.term
), grp AS (
    SELECT g.lang AS lang, g.source AS source, coalesce(sum(n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source
), p AS (
    SELECT k.lang AS lang, grp.source AS source, k.term AS term, coalesce(c.n, 0) AS n,
           {one("coalesce(c.n, 0)", "grp.total", "langs.v")} AS p, {one("k.n", "langs.total", "langs.v")} AS q
    FROM kept k JOIN langs ON k.lang = langs.lang JOIN grp ON k.lang = grp.lang
    LEFT JOIN counts c ON c.lang = k.lang AND c.source = grp.source AND c.term = k.term
), far AS (
    SELECT a.lang AS lang, a.source AS source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
    SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(far.value, 0)::BIGINT AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
), every AS (
    SELECT * FROM pairs
    UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}
"""


OP13_SQL = _op13_sql()


@query("op13_source_divergence", OP13_SQL)
def op13_source_divergence(spark, sf_dir):
    found = source_audit.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = found.pairs().withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(found.terms().withColumn("part", F.lit("term")).select(*columns))
