from collections import Counter

from tallyforge.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies int, _place string, _RATE int"


def test_targets_near_and_limits(spark, table_of):
    rows = [(i, "w " * (1 + i % 37), f"s{i % 5 if i % 2 else 0}", "x", 1, "p", 0) for i in range(600)]
    rows += [(600 + i, "v " * 3, None, None, None, None, None) for i in range(4)]
    docs = table_of(rows, SCHEMA)
    drawn = mixing.mix(docs)
    assert drawn.columns == [*docs.columns, "size_", "source_size", "target", "copies_", "taken"]
    taken, target, total, words = Counter(), {}, {}, 0
    for r in drawn.collect():
        assert 0 <= r["taken"] <= 3 * r["size_"]
        taken[r["source"]] += r["taken"]
        target[r["source"]], total[r["source"]] = r["target"], r["source_size"]
        words += r["size_"]
    assert abs(sum(target.values()) - words) < 1e-6 * words
    for s in target:
        assert target[s] <= 3 * total[s] + 1e-9
        assert abs(taken[s] - target[s]) <= 3 * 37
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(target, key=lambda s: (s is None, s)))}
    level = [target[s] / weights[s] for s in target if target[s] < 3 * total[s] - 1e-9]
    assert max(level) - min(level) < 1e-6
    again = mixing.mix(docs).select("doc_id", "taken")
    assert sorted(map(tuple, again.collect())) == sorted((r["doc_id"], r["taken"]) for r in drawn.collect())
    copied = mixing.mixed(docs)
    assert copied.columns == docs.columns
    assert copied.count() == sum(r["copies_"] for r in drawn.collect())


def test_ties_repeats_and_nulls(table_of):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, None, "s"), (None, "a b c", None), (2, "", "empty")]
    found = mixing.mix(table_of(rows, "doc_id long, text string, source string")).collect()
    assert len(found) == 5
    assert {r["source"]: r["target"] for r in found}["empty"] == 0
    assert all(r["taken"] == 0 for r in found if r["size"] == 0)


def test_empty_table(table_of):
    docs = table_of([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    assert mixing.mixed(docs).count() == 0
