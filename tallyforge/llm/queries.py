"""The operators over the driver tables, each on its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import mixing, quality, queries_copies, queries_models, queries_search, queries_tokens  # noqa: F401
from .registry import ORACLES, QUERIES, query, table  # noqa: F401

# Fixed text of every statement below: the words of a text.
SQL_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1_SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, len({SQL_WORDS})::BIGINT AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
           [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight,
           (sum(size) * 3)::DOUBLE AS room
    FROM sized GROUP BY source
), filled AS (
    SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(room) OVER f, 0) AS rest,
           sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS weight_left
    FROM sources
    WINDOW f AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levelled AS (
    SELECT *, room * weight_left <= rest * weight AS limited,
           max(CASE WHEN NOT room * weight_left <= rest * weight THEN rest / weight_left END) OVER () AS level
    FROM filled
), targets AS (
    SELECT source, source_size, CASE WHEN limited THEN room ELSE least(room, level * weight) END AS target,
           (('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 13))::BIGINT) / 4503599627370496.0::DOUBLE AS shift
    FROM levelled
), placed AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, t.shift,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
           row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) AS place
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (floor(place * rate + shift) - floor((place - 1) * rate + shift))::BIGINT * size AS taken
FROM placed
"""


@query("op1_mix_sources", OP1_SQL)
def op1_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    return mixing.mix(sized, size_column="words").select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = rf"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {SQL_WORDS} AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), grams AS (
    SELECT r, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: {{'p': i, 'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}})) AS g
    FROM split WHERE len(w) >= 3
), again AS (
    SELECT r, g.p AS p, count(*) OVER (PARTITION BY r, g.a, g.b, g.c) AS n FROM grams
), repeats AS (
    SELECT r, count(DISTINCT q) AS n_repeat_words
    FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM again WHERE n > 1) GROUP BY r
), counted AS (
    SELECT doc_id, source, len(w)::BIGINT AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM split LEFT JOIN repeats USING (r)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
), hosts AS (
    SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM judged GROUP BY source
), sums AS (
    SELECT sum(f) / sum(n) AS mean, sum(n) / count(*) AS average, sum(n * (f / n) * (f / n)) / sum(n) AS squares FROM hosts
), spread AS (
    SELECT *, greatest(squares - mean * mean, 0) - mean * (1 - mean) / average AS spread FROM sums
), prior AS (
    SELECT mean, CASE WHEN mean IN (0, 1) THEN 2.0
        ELSE least(greatest(CASE WHEN spread > 0 THEN mean * (1 - mean) / spread - 1 ELSE average END, 2), greatest(average, 2)) END AS weight
    FROM spread
), verdicts AS (
    SELECT source, n::BIGINT AS host_docs, shrunk AS host_rate,
           shrunk - 2 * sqrt(shrunk * (1 - shrunk) / (n + weight + 1)) >= 4 * mean / (1 - mean + 4 * mean) AND mean > 0 AND mean < 1 AS bad
    FROM (SELECT *, (f + mean * weight) / (n + weight) AS shrunk FROM hosts, prior)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_docs,
       round(host_rate, 6) AS host_rate, NOT base_failed AND NOT bad AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""


@query("op6_host_quality", OP6_SQL)
def op6_host_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    judged = quality.judge(docs, keep_text=False)
    rate = F.round("host_rate", 6).alias("host_rate")
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "host_docs", rate, "kept")


def _travel_with_tasks() -> None:
    """Functions of this package are sent to tasks by value: workers need not find the package."""
    from pyspark import cloudpickle

    from . import char_model, encode, hashing, near_copies, private, repeats, source_audit, tagger, token_counts, token_files, toxicity
    from . import url_rules, vector_codes

    shipped = [char_model, encode, hashing, near_copies, private, repeats, source_audit, tagger, token_counts, token_files, toxicity]
    shipped += [url_rules, vector_codes]
    for module in shipped:
        cloudpickle.register_pickle_by_value(module)


_travel_with_tasks()
