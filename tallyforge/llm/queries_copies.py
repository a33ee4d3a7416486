"""Queries on copies: repeated bytes, lines and near copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import line_runs, near_copies, repeats
from .registry import query, table


@query("op3_repeated_bytes")
def op3_repeated_bytes(spark, sf_dir):
    return repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_copies.join(docs, 3, 90).select("doc_id", "n_shingles", "component_id", "n_links")


# A run counts from two lines on, and one line of 50 words or more; the longest run of a document is grown line by line.
OP7_SQL = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
    SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split
), pairs AS (
    SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM lines
), starts AS (
    SELECT doc_id, pos FROM (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) AS nth FROM pairs WHERE next IS NOT NULL
    ) WHERE nth > 1
), alone AS (
    SELECT doc_id, pos FROM (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM lines
        WHERE len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) >= 50
    ) WHERE nth > 1
), gone AS (
    SELECT DISTINCT doc_id, pos
    FROM (SELECT doc_id, pos FROM starts UNION ALL SELECT doc_id, pos + 1 FROM starts UNION ALL SELECT doc_id, pos FROM alone)
), numbered AS (
    SELECT doc_id, pos, dense_rank() OVER (ORDER BY line) AS line, count(*) OVER (PARTITION BY line) AS n FROM lines
), grown AS (
    SELECT doc_id, pos, 1 AS length, line AS run FROM numbered WHERE n > 1
    UNION ALL
    SELECT doc_id, pos, length + 1, dense_rank() OVER (ORDER BY run, line) FROM (
        SELECT g.doc_id, g.pos, g.length, g.run, l.line, count(*) OVER (PARTITION BY g.run, l.line) AS n
        FROM grown g JOIN numbered l ON l.doc_id = g.doc_id AND l.pos = g.pos + g.length
    ) WHERE n > 1
), longest AS (
    SELECT doc_id, max(length) AS length FROM grown GROUP BY doc_id
), marked AS (
    SELECT lines.doc_id, lines.pos, line, gone.pos IS NOT NULL AS removed FROM lines LEFT JOIN gone USING (doc_id, pos)
), runs AS (
    SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM marked
), kept AS (
    SELECT doc_id, count(*)::BIGINT AS n_lines, sum(removed::INT)::BIGINT AS n_removed, sum(opens::INT)::BIGINT AS n_runs,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT removed), '')) AS kept_sha256
    FROM runs GROUP BY doc_id
)
SELECT kept.*, coalesce(longest.length, 0)::BIGINT AS longest_run FROM kept LEFT JOIN longest USING (doc_id)
"""


@query("op7_line_runs", OP7_SQL)
def op7_line_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_runs.remove(docs, min_words=line_runs.MIN_WORDS)
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2("kept_text", 256).alias("kept_sha256"))
