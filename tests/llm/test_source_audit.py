"""Source divergence against a plain version with Python's integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyforge.llm import source_audit

SCHEMA = "text string, lang string, source string"


def plain(rows, min_docs, top):
    docs = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), la or "", s or "") for t, la, s in rows]
    counts, holds, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for words, lang, source in docs:
        counts[lang, source].update(words)
        holds[lang].update(set(words))
        groups[lang].add(source)
    pairs, terms = set(), set()
    for lang, sources in groups.items():
        kept = [t for t, n in holds[lang].items() if n >= min_docs]

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            far = sorted((-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode()) for o in sources - {s})
            pairs |= {(lang, s, o.decode(), -v, k) for k, (v, o) in enumerate(far, 1)}
            over = sorted((whole[t] - own[s][t], t.encode()) for t in kept if counts[lang, s][t] and own[s][t] > whole[t])
            terms |= {(lang, s, t.decode(), -v, k) for k, (v, t) in enumerate(over[:top], 1)}
    return pairs, terms


def check(table_of, rows, min_docs=2, top=5, block=4, tile=2):
    found = source_audit.audit(table_of(rows, SCHEMA), min_docs=min_docs, block=block)
    got = [[tuple(r) for r in df.collect()] for df in (found.pairs(tile), found.terms(top))]
    pairs, terms = plain(rows, min_docs, top)
    assert len(got[0]) == len(pairs) and set(got[0]) == pairs
    assert len(got[1]) == len(terms) and set(got[1]) == terms
    found.release()


def test_same_as_plain_version(table_of):
    made = random.Random(3)
    words = [f"w{chr(97 + i)}" for i in range(25)] + ["Éa", "ß", "WA"]
    rows = [
        (" ".join(made.choices(words, weights=range(1, 29), k=made.randint(0, 12))), made.choice(["x", "y"]), f"s{made.randint(0, 6)}")
        for _ in range(150)
    ]
    check(table_of, rows)
    check(table_of, rows, block=1000, tile=100)


def test_nulls_empty_texts_single_sources_and_repeats(table_of):
    rows = [
        (None, None, None), ("", "x", "a"), ("a a-b\x00C", "x", "b"), ("a a-b\x00C", "x", "b"), ("A 1 b", "x", None), ("zz", "y", "a"),
        ("only one source", "z", "a"), ("only one source", "z", "a"),
    ]
    check(table_of, rows)


def test_empty_table(table_of):
    check(table_of, [])


def test_a_hot_source_and_a_long_text(table_of):
    rows = [("a b c " * 20_000, "x", "hot")] + [("a b", "x", "hot")] * 50 + [("b c d d", "x", f"s{i}") for i in range(5)]
    check(table_of, rows)


def test_clashing_names(spark):
    rows = [("a b", "x", "s", 1, 2), ("a c", "x", "t", 1, 2)]
    df = spark.createDataFrame(rows, "term string, lang string, n string, docs int, source int")
    found = source_audit.audit(df, text="term", source="n", min_docs=1)
    assert {tuple(r)[:3] for r in found.pairs().collect()} == {("x", "s", "t"), ("x", "t", "s")}


def test_equal_subtrees_are_one_node():
    forest = source_audit.grow(np.array([[0, 1] * 8, [0, 1] * 8, [0] * 16]))
    assert forest.roots[0] == forest.roots[1] != forest.roots[2]
    assert [len(nodes) for nodes in forest.levels] == [2, 2, 2, 2]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 13])
def test_price_is_the_summed_difference(width):
    made = np.random.default_rng(width)
    matrix = made.integers(0, 3, (4, width))
    forest = source_audit.grow(matrix)
    held = [source_audit.shares(forest.counts, 10 + g, width) for g in range(4)]
    for a in range(4):
        for b in range(4):
            x, y = (source_audit.shares(matrix[g], 10 + g, width) for g in (a, b))
            assert source_audit.price(forest, a, b, held[a], held[b]) == np.abs(x - y).sum()


def test_shares_of_counts_beyond_64_bits():
    big = 10**12
    assert source_audit.shares(np.array([0, big]), big, 2).tolist() == [1 + 5 * 10**9 // (big + 10), 1 + 10**9 * (big + 5) // (big + 10)]
