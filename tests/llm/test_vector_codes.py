"""Vector codes against a plain version in Python's integers."""

import math

import numpy as np
import pytest

from tallyforge.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, parts, entries, rounds, scale):
    """{(vec_id, codes, error): times} and the codebooks, from (vec_id, vector) rows."""
    good = [(i, v) for i, v in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in good if len(v) == len(good[0][1])]
    if not good:
        return [], []
    width = len(good[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(groups[k]) for col in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    found = [[near(p, c[p]) for p in range(parts)] for c in cut]
    return [(i, tuple(k for _, k in f), sum(d for d, _ in f)) for (i, _), f in zip(good, found)], books


def check(table_of, rows, parts=2, entries=3, rounds=4, scale=8):
    coded, books = vector_codes.compress(table_of(rows, SCHEMA), parts=parts, entries=entries, rounds=rounds, scale=scale)
    want, want_books = plain([r[:2] for r in rows], parts, entries, rounds, scale)
    got = [(r["vec_id"], tuple(r["codes"]), r["error"]) for r in coded.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert (books.entries.tolist() if books else []) == want_books
    return coded, books


@pytest.mark.parametrize("seed", range(5))
def test_nearest_is_exact_and_takes_the_lower_index(seed):
    made = np.random.default_rng(seed)
    entries = made.integers(-4, 5, (9, 3))
    values = made.integers(-6, 7, (500, 3))
    distances = ((values[:, None] - entries[None]) ** 2).sum(axis=2)
    index, best = vector_codes.nearest(values, entries)
    assert (index == distances.argmin(axis=1)).all() and (best == distances.min(axis=1)).all()


def test_nearest_at_the_bound_of_whole_numbers():
    top = 1 << vector_codes.bound_bits(8, 64)
    values = np.array([[top] * 8, [-top] * 8, [0] * 8])
    index, best = vector_codes.nearest(values, np.array([[-top] * 8, [top] * 8]))
    assert index.tolist() == [1, 0, 0] and best.tolist() == [0, 0, 8 * top * top]


def test_same_as_plain_version(table_of):
    made = np.random.default_rng(7)
    check(table_of, [(i, made.normal(size=4).tolist(), i % 3) for i in range(60)])


def test_nulls_ties_repeats_and_odd_lengths(table_of):
    rows = [
        (1, None, 1), (2, [], 1), (3, [1.0, None, 0.0, 0.0], 1), (4, [math.nan, 0.0, 0.0, 0.0], 1), (5, [math.inf, 0.0, 0.0, 0.0], 1),
        (6, [1.0, 2.0, 3.0], 2), (7, [0.5, -0.5, 0.25, 1.0], 2), (7, [0.5, -0.5, 0.25, 1.0], 2), (7, [0.5, -0.5, 0.25, 0.5], None),
        (8, [0.0] * 6, 2), (9, [-1.0, 0.0, 0.0, 1.0], None), (None, [0.1, 0.1, 0.1, 0.1], None), (10, [0.5, -0.5, 0.25, 1.0], 3),
    ]
    check(table_of, rows)


def test_fewer_vectors_than_entries_and_none(table_of):
    check(table_of, [(1, [1.0, 2.0], 1)], entries=16)
    for rows in ([], [(1, None, 1)]):
        coded, books = check(table_of, rows)
        assert books is None and coded.columns == ["vec_id", "label", "codes", "error"]


def test_huge_components_saturate(table_of):
    coded, books = vector_codes.compress(table_of([(1, [1e300] * 16, 1), (2, [-1e300] * 16, 1)], SCHEMA), entries=1, rounds=0)
    top = 1 << vector_codes.bound_bits(2, 16)
    assert [r["error"] for r in coded.orderBy("vec_id").collect()] == [0, 16 * 4 * top * top]


def test_taken_names_and_decoded_vectors(spark, table_of):
    rows = [(i, [float(i), 0.5], "x") for i in range(4)]
    df = table_of(rows, "codes bigint, embedding array<double>, Error string")
    coded, books = vector_codes.compress(df, vec_id="codes", parts=2, entries=4, rounds=2)
    assert coded.columns == ["codes", "Error", "codes_", "error_"]
    back = vector_codes.decode(coded, books, codes="codes_", vector="v").orderBy("codes").collect()
    assert [r["v"] for r in back] == [[float(i), 0.5] for i in range(4)]
