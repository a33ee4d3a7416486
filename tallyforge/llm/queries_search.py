"""Queries on URLs and on benchmark items."""

from __future__ import annotations

from . import decontaminate, private, url_rules
from .registry import query, table

HOST_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
BLOCKED_NAMES = ["spam-farm", "cheap-pills", "casino", "free-money", "adult-video", "click-bait", "warez", "payday-loan"]

_NAMES_SQL = " OR ".join(f"regexp_matches(lower(place), '(^|[^a-z0-9]){name}($|[^a-z0-9])')" for name in BLOCKED_NAMES)
_RULES_SQL = ", ".join(f"('{verdict}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in HOST_RULES)

OP8_SQL = rf"""
WITH parts AS (
    SELECT row_number() OVER () AS r, page_id,
           translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages
), rules(v, h, p) AS (VALUES {_RULES_SQL}
), best AS (
    SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
), placed AS (
    SELECT *, host || path AS place FROM parts LEFT JOIN best USING (r)
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN v WHEN {_NAMES_SQL} THEN 'block' ELSE 'allow' END AS verdict
FROM placed
"""


@query("op8_url_rules", OP8_SQL)
def op8_url_rules(spark, sf_dir):
    rules = [url_rules.host_rule(*r) for r in HOST_RULES] + [url_rules.token_rule("block", n) for n in BLOCKED_NAMES]
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def _sets(name: str) -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = rf"list_filter(regexp_split_to_array({lower}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    many = "list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))"
    return f"SELECT *, CASE WHEN len(w) >= 5 THEN {many} ELSE [] END AS s, ' ' || array_to_string(w, ' ') || ' ' AS line FROM (SELECT row_number() OVER () AS r, *, {found} AS w FROM {name})"


OP10_SQL = f"""
WITH d AS ({_sets("documents")}), i AS ({_sets("benchmark")}),
ds AS (SELECT r AS dr, doc_id, unnest(s) AS x FROM d),
si AS (SELECT r AS ir, item_id, len(s) AS n, unnest(s) AS x FROM i)
SELECT any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, any_value(n)::BIGINT AS n_item, count(*)::BIGINT AS n_shared
FROM ds JOIN si USING (x) GROUP BY dr, ir HAVING count(*) * 100 >= any_value(n) * 80
UNION ALL
SELECT doc_id, item_id, 1, 1 FROM d JOIN i ON len(i.w) BETWEEN 1 AND 4 AND contains(d.line, i.line)
"""


@query("op10_decontaminate", OP10_SQL)
def op10_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark")).drop("doc")


@query("op4_personal_data")
def op4_personal_data(spark, sf_dir):
    found = private.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
