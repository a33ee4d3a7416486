"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression over ``host + path`` with tokens (runs of a-z and 0-9) that every fitting URL must
hold. Each rule is indexed by the one of its tokens that the fewest URLs have; a URL's tokens fetch its candidate
rules, and only those run their regular expressions.

Scale: the token counts are one aggregate over all URLs, limited to tokens that some rule names, so that no more
counts than rule tokens reach the driver. The rules, a list in the caller's program, travel with the task; judging
needs no shuffle, and only the URL column passes through Arrow.

Defined results: a NULL URL or one without ``://`` has empty host and path, fits no rule with tokens, and is allowed
unless a rule without tokens fits; repeated pages are judged each; an empty table gives an empty table; added columns
take a trailing underscore if the name is taken.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import lowered, spare

TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``rank`` decides between fitting rules: the largest wins, the name on a tie."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: tuple[int, int]
    shown: bool = True


def host_rule(verdict: str, rule: str) -> Rule:
    """A rule like ``example.com/en/``: the host with its subdomains, and paths that start so; longest wins.

    Host labels and the path's complete segments are tokens that a fitting URL holds.
    """
    host, slash, path = rule.partition("/")
    whole = (slash + path)[: (slash + path).rfind("/") + 1]
    tokens = TOKEN.findall(host) + [t for t in TOKEN.findall(whole.lower()) if re.fullmatch("[a-z0-9/]*", whole)]
    return Rule(rule, verdict, rf"(?:[^/]*\.)?{re.escape(host)}(?=/|\Z){re.escape(slash + path)}", tuple(tokens), (1, len(rule)))


def token_rule(verdict: str, text: str) -> Rule:
    """A rule on any place where ``text`` stands between characters that are no letters or digits."""
    tokens = tuple(TOKEN.findall(text.lower()))
    edge = "(?<![a-z0-9])", "(?![a-z0-9])"
    return Rule(text, verdict, rf"(?i)[\s\S]*?{edge[0]}{re.escape(text)}{edge[1]}", tokens, (0, len(text)), shown=False)


def host_of(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(places: DataFrame, place: str, rules: Sequence[Rule]) -> Counter:
    """Rows that hold each token of a rule."""
    named = sorted({t for r in rules for t in r.tokens})
    if not named:
        return Counter()
    held = F.array_distinct(F.regexp_extract_all(F.lower(place), F.lit("([a-z0-9]+)"), 1))
    counts = places.select(F.explode(held).alias("token")).where(F.col("token").isin(named)).groupBy("token").count()
    return Counter({r["token"]: r["count"] for r in counts.collect()})  # at most one row per token of a rule


def indexed(rules: Sequence[Rule], counts: Counter) -> dict[str, list[Rule]]:
    """Rules by their rarest token; those without tokens, under the empty one, are tried on every URL."""
    index = defaultdict(list)
    for rule in rules:
        index[min(rule.tokens, key=lambda t: (counts[t], t), default="")].append(rule)
    return dict(index)


class Judge:
    def __init__(self, index: dict[str, list[Rule]]):
        self.index = {t: [(r, re.compile(r.pattern)) for r in rules] for t, rules in index.items()}

    def best(self, place: str) -> Rule | None:
        found = None
        for token in {"", *TOKEN.findall(place.lower())} & self.index.keys():
            for rule, pattern in self.index[token]:
                if (found is None or (rule.rank, rule.name) > (found.rank, found.name)) and pattern.match(place):
                    found = rule
        return found


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the host rule that decided) and ``verdict``."""
    n_host, n_path, n_rule, n_verdict, found = spare(pages, "host", "path", "rule", "verdict", "_found")
    split = pages.withColumn(n_host, host_of(F.col(url))).withColumn(n_path, path_of(F.col(url)))
    places = split.select(F.concat(n_host, n_path).alias("place"))
    index = indexed(rules, token_counts(places, "place", rules))

    @F.pandas_udf("rule string, verdict string")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Judge(index)
        for batch in batches:
            best = [judge.best(place) for place in batch]
            yield pd.DataFrame(
                {
                    "rule": [r.name if r and r.shown else None for r in best],
                    "verdict": [r.verdict if r else otherwise for r in best],
                },
                dtype=object,
            )

    return split.withColumn(found, decide(F.concat(n_host, n_path))).select(
        *split.columns, F.col(found)["rule"].alias(n_rule), F.col(found)["verdict"].alias(n_verdict)
    )
