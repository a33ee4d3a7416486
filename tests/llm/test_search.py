import random
import re

import numpy as np
from texts import shingles

from tallyforge.llm import decontaminate, private, url_rules
from tallyforge.llm.tagger import KINDS, Tagger


def test_containment_like_plain_version(table_of):
    r = random.Random(9)
    voc = [f"W{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(voc) for _ in range(n))) for i, n in enumerate([3, 5, 6, 9, 17, 33, 64, 65, 120, 1, 2, 4])]
    items += [(50, None), (51, ""), (52, items[4][1])]
    docs = []
    for i in range(60):
        chosen = r.choice(items)[1] or ""
        text = [w if r.random() > r.choice([0, 0.02, 0.1]) else "other" for w in chosen.split()]
        docs.append((i, " ".join([*(r.choice(voc) for _ in range(r.choice([0, 5, 300]))), *text, "end"]).lower()))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[5][1])]
    want = []
    for k, t in docs:
        for i, x in items:
            item = shingles(x, 5)
            n = len(item & shingles(t, min(5, len((x or "").split()) or 5)))
            if item and 100 * n >= 80 * len(item):
                want.append((k, i, len(item), n))
    table, bench = table_of(docs, "doc_id long, text string"), table_of(items, "item_id long, text string")
    found = decontaminate.find(table, bench).drop("doc")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    hit = {k for k, *_ in want}
    clean = decontaminate.clean(table.selectExpr("*", "1 AS _hit"), bench)
    assert clean.columns == ["doc_id", "text", "_hit"]
    assert sorted((x["doc_id"] for x in clean.collect()), key=repr) == sorted((k for k, _ in docs if k not in hit), key=repr)
    assert decontaminate.find(table, bench.where("false")).count() == 0
    assert decontaminate.clean(table.where("false"), bench).count() == 0


def test_url_rules(table_of):
    urls = [
        (1, "https://A.example.com/en/1?x=/fr/"), (2, "http://www.example.com/en/"), (3, "http://shop.net/es/a"), (4, "http://net/fr/"),
        (5, "http://shop.net/de/"), (6, None), (7, "no scheme"), (8, "http://x.cheap-pills.org/"), (9, "http://x.org/cheap-pillsx"),
        (10, "http://com"), (11, "http://notcom/"), (12, "x://y://a.com/\nb#c"), (2, "http://www.example.com/en/"),
    ]
    given = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    rules = [url_rules.host_rule(*x) for x in given] + [url_rules.token_rule("block", "cheap-pills")]
    pages = table_of([(*u, "h") for u in urls], "page_id long, url string, HOST string")
    found = url_rules.judge(pages, rules)
    assert found.columns == ["page_id", "url", "HOST", "host_", "path", "rule", "verdict"]
    rows = {r["page_id"]: (r["host_"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
    assert rows[1] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert rows[2] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert rows[3][2:] == ("net/es/", "block") and rows[4][2:] == ("net/fr/", "block") and rows[5][2:] == (None, "allow")
    assert rows[6] == rows[7] == ("", "", None, "allow")
    assert rows[8][2:] == (None, "block") and rows[9][2:] == (None, "allow")
    assert rows[10][2:] == (None, "allow") and rows[11][2:] == (None, "allow") and rows[12] == ("y:", "//a.com/\nb", None, "allow")
    assert found.count() == len(urls)
    assert url_rules.judge(pages.where("false"), rules).count() == 0


def test_rules_are_indexed_by_their_rarest_token(table_of):
    pages = table_of([(f"http://a{i}.com/en/{i}",) for i in range(20)] + [("http://rare.com/x",)], "url string")
    rules = [url_rules.host_rule("block", "rare.com/en/")]
    counts = url_rules.token_counts(pages.selectExpr("url AS place"), "place", rules)
    assert counts == {"com": 21, "en": 20, "rare": 1}
    assert list(url_rules.indexed(rules, counts)) == ["rare"]


def plain_spans(text):
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(private.digits_of(m)) <= 19 and private.luhn(private.digits_of(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(private.digits_of(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m.group())]


def test_pattern_spans_like_plain_patterns():
    r = random.Random(7)
    parts = ["@", ".", "a", "b-c", "1", "22", "300", "+", " ", "-", "(", ")", "é", "@x.y", "4111 1111 1111 1111", "+1 (22) 333-4444", "1.2.3.4", "_%"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert private.base_spans(text) == plain_spans(text), text
    assert private.base_spans("9" * 200_000 + "a" * 200_000) == []


def test_gradients_of_the_tagger():
    tagger, r = Tagger(hidden=3, embed=3), np.random.default_rng(0)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    letters, tags = r.integers(0, 90, (3, 9)), np.zeros((3, 9), int)
    tags[0, 2:4], tags[1, 4] = (1, 2), 5
    _, grads = tagger.gradients(letters, tags)
    for name, values in tagger.p.items():
        at = {"E": (letters[0, 2], 1), "T": (0, 1)}.get(name, tuple(s // 2 for s in values.shape))
        held, near = values[at], []
        for step in (1e-3, -1e-3):
            values[at] = held + step
            near.append(tagger.gradients(letters, tags)[0])
        values[at] = held
        assert abs((near[0] - near[1]) / 2e-3 - grads[name][at]) < 2e-3


def test_tagger_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labelled = private.snippets(docs.where("doc_id < 6000"), "text", private.SAMPLE)
    tagger = private.trained(labelled)
    assert tagger.losses[-1] < 0.2 * tagger.losses[0]
    texts = [r["text"] for r in docs.where("doc_id >= 6000").collect()]
    bases = [private.base_spans(t) for t in texts]
    known = {(i, *s) for i, b in enumerate(bases) for s in b if s[0] in (0, 1, 2)}
    found = {(i, *s) for i, b in enumerate(private.added_spans(texts, [[] for _ in texts], tagger)) for s in b if s[0] in (0, 1, 2)}
    assert len(known & found) >= 0.6 * len(known) and len(found - known) <= 0.2 * len(found)


def test_training_sample_of_many_copies_is_distinct_and_has_all_kinds(table_of):
    copied = " and ".join(f"mail user{i}.name{i}@example{i}.org for more of these words here" for i in range(60))
    found = [f"from 10.{i}.0.1 today" for i in range(30)] + [f"call +1 (555) 010-{1000 + i} now" for i in range(30)]
    found += [f"card 4111 1111 1111 1111 number {'x' * i}" for i in range(30)] + [f"item {i} sold" for i in range(200)]
    rows = [(i, copied) for i in range(3000)] + [(10_000 + i, t) for i, t in enumerate(found)]
    sample = private.snippets(table_of(rows, "doc_id long, text string"), "text", 160)
    assert len(sample) == len(set(sample)) == 160 and sum(bool(spans) for _, spans in sample) == 80
    kinds = [{s.split(":")[0] for s in spans.split(",")} for _, spans in sample if spans]
    assert all(sum(k in x for x in kinds) >= 20 for k in KINDS)


def test_personal_data_query_shape(table_of):
    rows = [(1, "x a.b@c.org 1.2.3.4 +1 (222) 333-4444", 0), (2, None, 0), (3, "", 0), (1, "none", 0), (4, "é 😀 z@y.xx", 0)]
    found = private.find(table_of(rows, "doc_id long, text string, N_EMAIL int"), epochs=1)
    got = {(r["doc_id"], r["text"]): r for r in found.collect()}
    assert len(got) == 5 and got[(1, rows[0][1])]["n_email_"] == 1 and got[(1, rows[0][1])]["n_phone"] == 1
    assert got[(4, rows[4][1])]["spans"].startswith("email:4:10")
    assert got[(2, None)]["spans"] == "" and [*KINDS] == ["email", "ip", "card", "phone"]
    assert private.find(table_of([], "doc_id long, text string")).count() == 0
