import math
import random

import numpy as np
from pyspark.sql import functions as F
from texts import cut_lines, cut_repeats, groups, longest_runs
from texts import near_copies as plain_near

from tallyforge.llm import graph, line_runs, near_copies, repeats
from tallyforge.llm.hashing import mix, shingle_sets

TEXTS = "doc_id long, text string"


def variants(r, kinds=(6, 12, 25, 60, 200)):
    voc = [f"w{i}" for i in range(2000)]
    rows = []
    for length in kinds:
        base = [r.choice(voc) for _ in range(length)]
        for _ in range(12):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, max(1, length // 20)])):
                text[r.randrange(length)] = r.choice(voc)
            rows.append((len(rows), " ".join(text)))
    shared = " ".join(r.choice(voc) for _ in range(12))
    rows += [(500 + i, f"{shared} {' '.join(r.choice(voc) for _ in range(r.choice([1, 4, 30])))}") for i in range(25)]
    odd = [None, "", " \n", "one", "ONE", "one two", rows[5][1], rows[5][1].upper()]
    rows += [(900 + i, t) for i, t in enumerate(odd)] + [(905, "one two"), (None, rows[9][1]), (None, "zz yy"), (None, "zz yy")]
    return rows


def test_links_and_components_like_plain_version(table_of):
    rows = variants(random.Random(2))
    docs = table_of(rows, TEXTS)
    columns = ["doc_id", "n_shingles", "component_id", "n_links"]
    for size, percent, limits in ((3, 90, near_copies.Limits()), (5, 80, near_copies.Limits(400, 6))):
        found = near_copies.join(docs, size, percent, limits=limits).select(*columns)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain_near(rows, size, percent), key=repr)


def test_every_similar_pair_shares_a_signature():
    r = random.Random(8)
    for percent in (60, 80, 90):
        make = near_copies.Signatures(percent)
        for n in (2, 5, 9, 10, 17, 40, 150, 900):
            for _ in range(15):
                union = shingle_sets([" ".join(str(r.random()) for _ in range(n)).encode()], 1)[0]
                apart = [x for x in range(n) if r.random() < (100 - percent) / 100]
                left = [i for i in range(n) if i not in apart[::2]]
                right = [i for i in range(n) if i not in apart[1::2]]
                if left != right and left and right and 100 * (n - len(apart)) >= percent * n:
                    assert set(make.of(union[left]).tolist()) & set(make.of(union[right]).tolist())


def test_signatures_of_long_sets_are_few_and_complete():
    r = np.random.default_rng(3)
    make = near_copies.Signatures(80)
    make._grow(100_000)
    for low in [n for n in make.lows if 100 <= n <= 100_000]:
        n = low * 5 // 4
        apart = n // 5
        for a, b in [(apart, 0), (apart // 2, apart - apart // 2)] * 5:
            union = r.permutation(np.unique(r.integers(0, 1 << 64, n, dtype=np.uint64)))
            left, right = np.sort(union[a:]), np.sort(union[: len(union) - b])
            assert 100 * (len(union) - a - b) >= 80 * len(union)
            made = [make.of(s) for s in (left, right)]
            assert len(np.intersect1d(*made)) and max(map(len, made)) <= 1000 + 2 * len(union)


def test_equal_parts_may_all_be_empty(monkeypatch):
    """154 of 164 parts differ in two elements each, the other 10 are empty."""
    make, k, m, parts, band = near_copies.Signatures(80), 308, 10, 164, 40
    monkeypatch.setattr(make, "plan", lambda band: (k, m, parts))
    pool = np.random.default_rng(5).integers(0, 1 << 64, 100_000, dtype=np.uint64)
    dealt = mix(pool + np.uint64(band))
    part, third = (dealt >> np.uint64(40)) % np.uint64(parts), (dealt & np.uint64(0xFFFF)) % np.uint64(3)
    left, right = [], []
    for p in range(m, parts):
        a, b, c = (pool[(part == p) & (third == t)][:2] for t in range(3))
        left += [*a, b[0], c[0]]
        right += [a[0], *b, c[0]]
    left, right = (np.sort(np.array(x, np.uint64)) for x in (left, right))
    for most, width in ((10**6, 3), (10**5, 2), (10, 1)):
        monkeypatch.setattr(near_copies, "MOST_CHOICES", most)
        assert near_copies.together(m, parts) == width
        assert len(np.intersect1d(make._of_band(left, band), make._of_band(right, band))) == math.comb(m, width)


def test_one_of_each_group_stays(table_of):
    rows = variants(random.Random(3), (12, 60))
    docs = table_of([(k, t, 1) for k, t in rows], "doc_id long, text string, _row int")
    kept = near_copies.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    sets, roots, _ = groups(rows, 5, 80)
    assert kept.count() == len({r for r, s in zip(roots, sets) if s}) + sum(not s for s in sets)
    assert near_copies.one_of_each(docs.where("false"), 5, 80).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def passages(r):
    def text(n):
        return "".join(r.choice("ab cdé") for _ in range(n))

    parts = [text(n) for n in (190, 199, 200, 201, 260, 500)]
    rows = []
    for i in range(70):
        pieces = [r.choice([text(r.randrange(150)), r.choice(parts), r.choice(parts)[r.randrange(60) :]]) for _ in range(r.randrange(1, 6))]
        rows.append((i, "".join(pieces)))
    return rows + [(200, None), (201, ""), (202, "x" * 3000), (203, "xy" * 400), (None, parts[5] + "q"), (204, parts[4]), (204, parts[4])]


def test_repeated_bytes_like_plain_version(table_of):
    rows = passages(random.Random(3))
    docs = table_of(rows, TEXTS)
    want = sorted(cut_repeats(rows, repeats.LENGTH), key=repr)
    for hot in (repeats.HOT_RUNS, 2):
        assert sorted(map(tuple, repeats.remove(docs, hot_runs=hot).collect()), key=repr) == want
    assert repeats.remove(docs.where("false")).count() == 0


def test_long_texts_are_cut_without_losing_strings(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    text = random.Random(1).randbytes(2000)
    seen = []
    for data, valid, key, base in repeats.pieces([5, 6, 7], [text, b"short", text[:199]]):
        for at in valid.nonzero()[0].tolist():
            assert key[at] == 5 and bytes(data[at : at + 200]) == text[base[at] + at : base[at] + at + 200]
            seen.append(int(base[at]) + at)
    assert sorted(seen) == list(range(1801))


def test_repeated_line_runs_like_plain_version(table_of):
    r = random.Random(6)
    rows = [(i, "\n".join(r.choice("abcdefg") for _ in range(r.randrange(1, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n".join("abcdefg" * 4))]
    docs = table_of([(k, t, 1) for k, t in rows], "doc_id long, text string, _Row int")
    for n in (1, 2, 3, 5):
        found = line_runs.remove(docs, min_lines=n).select("doc_id", "n_lines", "n_removed", "n_runs", "kept_text")
        assert sorted(map(tuple, found.collect())) == cut_lines(rows, n)
    assert line_runs.remove(docs.where("false")).count() == 0


def test_longest_common_runs_like_plain_version(table_of, monkeypatch):
    r = random.Random(11)
    passage = [f"p{i}" for i in range(37)]
    rows = [(i, "\n".join(r.choice("abc") for _ in range(r.randrange(1, 40)))) for i in range(30)]
    for i in range(12):
        start = r.randrange(20)
        part = passage[start : start + r.randrange(1, 18)]
        rows.append((50 + i, "\n".join([f"own {i}", *part, *([f"tail {i}"] if i % 2 else [])])))
    rows += [(100, None), (101, ""), (102, "\n" * 70), (103, "\n" * 9), (104, "lonely"), (105, rows[3][1]), (None, rows[4][1])]
    docs = table_of(rows, TEXTS)
    for cut in (line_runs.BUCKET_ROWS, 5):  # in one piece, and with large buckets numbered in pieces
        monkeypatch.setattr(line_runs, "BUCKET_ROWS", cut)
        found = line_runs.remove(docs, min_lines=3, min_words=2)
        assert sorted(map(tuple, found.select("doc_id", "longest_run").collect()), key=repr) == sorted(longest_runs(rows), key=repr)
        by_id = sorted(rows, key=lambda row: (row[0] is not None, row[0]))
        kept = {k: (text, n) for k, text, n in cut_lines_or_words(by_id, 3, 2)}
        assert {x["doc_id"]: (x["kept_text"], x["n_removed"]) for x in found.collect()} == kept


def test_long_documents_of_lines(table_of):
    lines = [f"line {i}" for i in range(3000)]
    long = "\n".join(lines)
    docs = table_of([(1, long), (2, f"x\n{long}"), (3, "\n".join(lines[:2000]) + "\nend"), (4, "y " * 200_000)], TEXTS)
    found = line_runs.remove(docs, min_words=50).select("doc_id", "n_removed", "n_runs", "longest_run", "kept_text").orderBy("doc_id").collect()
    assert [tuple(x)[1:4] for x in found] == [(0, 0, 3000), (3000, 1, 3000), (2000, 1, 2000), (0, 0, 0)]
    assert [x["kept_text"] for x in found][1:3] == ["x", "end"]


def test_equal_rows_are_one_document_for_lines(table_of):
    docs = table_of([(1, "a\nb"), (1, "a\nb"), (None, "c\nd"), (2, "c\nd")], TEXTS)
    found = line_runs.remove(docs).select("doc_id", "n_removed").orderBy(F.col("doc_id").asc_nulls_first())
    assert [tuple(x) for x in found.collect()] == [(None, 0), (1, 0), (1, 0), (2, 2)]


def cut_lines_or_words(rows, min_lines, min_words):
    """(id, removed places): later copies of windows of ``min_lines`` lines, or of fewer with ``min_words`` words."""
    seen, out = set(), []
    for key, text in rows:
        lines = (text or "").split("\n")
        gone = set()
        for n in range(1, min_lines + 1):
            for i in range(len(lines) - n + 1):
                window = tuple(lines[i : i + n])
                if window in seen and (n == min_lines or len(" ".join(window).split()) >= min_words):
                    gone |= set(range(i, i + n))
                seen.add(window)
        out.append((key, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def test_long_repeated_lines_count_by_their_words(table_of):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"a\n{long}\nb"), (2, f"c\n{long}\nd"), (3, "one line " * 30), (4, "one line " * 30), (5, "short"), (6, "short"), (7, "a\nx")]
    docs = table_of(rows, TEXTS)
    found = {r["doc_id"]: (r["kept_text"], r["n_removed"]) for r in line_runs.remove(docs, min_words=50).collect()}
    assert found[2] == ("c\nd", 1) and found[4] == ("", 1) and found[6] == ("short", 0) and found[7] == ("a\nx", 0)
    assert {r["n_removed"] for r in line_runs.remove(docs).collect()} == {0}
    r = random.Random(4)
    lines = ["", "a", "b", "c d", "e f g", "h i j k l"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 8)))) for i in range(40)]
    docs = table_of(rows, TEXTS)
    for n, w in ((1, 3), (2, 3), (3, 4), (5, 6)):
        found = line_runs.remove(docs, min_lines=n, min_words=w).select("doc_id", "kept_text", "n_removed")
        assert sorted(map(tuple, found.collect())) == cut_lines_or_words(rows, n, w)


def test_words_of_lines_are_matched_not_split(spark):
    spaced = ["a " * 49 + "b", " \t" + "a \x0b" * 48 + "b\r", "x" * 300, " " * 300, "é\x0c" * 50, "", "a " * 51]
    docs = spark.createDataFrame([(1, "\n".join(spaced)), (2, None)], TEXTS)
    found = line_runs._counted_lines(docs, "doc_id", "text", 2, 50)
    assert "replace(" not in found._jdf.queryExecution().analyzed().toString()
    heads = [r["heads"] for r in found.orderBy("doc", "at").collect()]
    assert heads == [[50], [0], [0], [0], [50], [0], [50], [0]]
    for n in (0, 1, 2, 49, 50, 51, 501):
        held = line_runs._counted_lines(docs, "doc_id", "text", 2, n).orderBy("doc", "at").collect()
        assert [r["heads"][0] >= n for r in held] == [len(x.split()) >= n for x in [*spaced, ""]]


def test_a_comparison_holds_one_matrix_of_counts():
    import tracemalloc

    r = random.Random(4)
    base = np.array(sorted(r.sample(range(10**9), 60)), np.uint64)
    sets = [np.append(base[: 40 + i % 21], np.uint64(10**10 + i)) for i in range(1200)]
    plain = {(i, j) for i in range(0, 1200, 97) for j in range(i + 1, 1200) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - c)}
    tracemalloc.start()
    found = {p for p in near_copies.linked(sets, 80) if p[0] % 97 == 0}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == plain and peak < 50e6
    across = set(near_copies.linked(sets[:300], 80, 100))
    assert across == {(i, j) for i, j in near_copies.linked(sets[:300], 80) if i < 100 <= j}
    text = " ".join(f"w{r.randrange(9000)}" for _ in range(300_000)).encode()
    tracemalloc.start()
    shingle_sets([text], 5)
    shingle_sets([text[i : i + 3000] for i in range(0, len(text), 3000)], 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
