"""Decoding of disguises, the counts of the language model, and held-out accuracy of the scores."""

import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import char_model, toxicity

SF_DIR = "/root/testdata/sf0.1"
DISGUISED = ["1d10t", "!diot", "i d i o t", "iiidiooot", "m0r0n", "m-o-r-o-n", "st*pid", "$tup1d", "p4th3t1c", "l0$er", "tr@sh", "cl0wn", "5cum", "s c u m", "disgust1ng"]
MEANT = ["idiot", "idiot", "idiot", "idiot", "moron", "moron", "stupid", "stupid", "pathetic", "loser", "trash", "clown", "scum", "scum", "disgusting"]


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    return docs, labels, toxicity.fit(docs, labels)


def kind(letter):
    return char_model.kind_of(letter.lower())


def plain_counts(texts):
    found = Counter()
    for text in texts:
        word = ""
        for letter in text + " ":
            before = [0, 0, 0, *[kind(x) for x in word]][-3:]
            if word or kind(letter):
                found[tuple(before), kind(letter)] += 1
            word = word + letter if kind(letter) else ""
    return found


def test_counts_are_those_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(char_model, "SLICE", 7)
    texts = ["The ßcum, and THE rest", "", "a", "é" * 9, "x1y2 zz", "one two three four five six seven" * 3]
    local = char_model.Counts()
    for text in texts:
        local.add(text.encode())
    local.flush()
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    got = char_model.sequence_counts(F.col("text"), df)
    assert (got == char_model.within_words(local.counts)).all()
    grid = got.reshape((char_model.KINDS,) * char_model.ORDER)
    assert {(tuple(int(i) for i in at[:3]), int(at[3])): int(grid[tuple(at)]) for at in np.argwhere(grid)} == plain_counts(texts)


def test_chances_sum_to_one():
    counts = np.random.default_rng(1).integers(0, 3, char_model.SIZE)
    chances = np.exp(char_model.log_chances(counts)).reshape(-1, char_model.KINDS)
    assert np.allclose(chances.sum(axis=1), 1, atol=1e-4)


def every_reading(choices):
    if not choices:
        yield "", 0.0
        return
    for text, cost in choices[0]:
        for rest, more in every_reading(choices[1:]):
            yield text + rest, cost + more


@pytest.mark.parametrize("piece", ["1d10t", "sss4", "i.d.1", "0aa$b!", "x"])
def test_decoding_is_the_best_of_all_readings(fitted, piece):
    chances = fitted[2].chances

    def score(text, cost):
        now = 0
        for letter in text:
            code = now * char_model.KINDS + kind(letter)
            cost += float(chances[code]) if now or code else 0.0
            now = code % char_model.BEFORE if kind(letter) else 0
        return cost + (float(chances[now * char_model.KINDS]) if now else 0.0)

    best = max(score(*r) for r in every_reading(char_model.options(piece)))
    got = char_model.decode(piece, chances)
    assert any(text == got and abs(score(text, cost) - best) < 1e-6 for text, cost in every_reading(char_model.options(piece)))


def test_disguises_are_undone(fitted):
    chances = fitted[2].chances
    assert [char_model.restored_text(d, chances) for d in DISGUISED] == MEANT
    for plain in ["the quick brown fox.", "2024-01-05 12:30", "a b", "“naïve” façade"]:
        assert char_model.restored_text(plain, chances) == plain


def test_held_out_documents(fitted):
    docs, labels, model = fitted
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    met = scored.join(labels, "doc_id").where("held_out").select("predicted", "toxic", "score", "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in met)
    table = Counter((r["predicted"], r["toxic"]) for r in met)
    assert table[1, 1] / (table[1, 1] + table[0, 1]) > 0.85
    assert table[1, 0] / (table[1, 0] + table[0, 0]) < 0.01


def test_disguised_words_are_caught_and_the_rest_left(spark, fitted):
    docs, labels, model = fitted
    clean = [r["text"] for r in docs.join(labels.where("toxic = 0 and quality = 1"), "doc_id").where("lang = 'en' and length(text) between 300 and 900").orderBy("doc_id").limit(60).collect()]
    rows = [(i, t) for i, t in enumerate(clean)]
    for i, text in enumerate(clean):
        words = text.split(" ")
        for k in range(5):
            words.insert(7 * k % len(words), DISGUISED[(i + 4 * k) % len(DISGUISED)])
        rows.append((1000 + i, " ".join(words)))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert sum(got[i] for i in range(len(clean))) <= 1
    assert sum(got[1000 + i] for i in range(len(clean))) >= 0.9 * len(clean)


def test_labels_of_held_out_rows_do_not_matter(spark, fitted):
    docs, labels, _ = fitted
    few = docs.where("doc_id < 700").select("doc_id", "text")
    some = labels.where("doc_id < 700")
    turned = some.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(few, some, pieces=50), toxicity.fit(few, turned, pieces=50)
    assert a.pieces == b.pieces and (a.weights == b.weights).all()


def test_nulls_repeats_long_texts_and_taken_names(spark):
    rows = [(1, "you idiot " * 5, 1), (1, "you idiot " * 5, 1), (None, "idiot", 2), (2, None, 3), (3, "", 4), (4, "fine day", 5), (6, "nice day idiot", 6), (7, "w" * 200_000 + " 1" + "d1" * 300, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, Score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 1), (4, 0), (7, 0), (2, None), (None, 1), (99, 1), (8, 0)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, labels, pieces=10)
    got = toxicity.score(df, model, restore=True)
    assert got.columns == ["doc_id", "Score", "score_", "restored", "held_out", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= r["score_"] <= 1 for r in found)
    by_id = {r["Score"]: r for r in found}
    assert by_id[3]["score_"] == by_id[4]["score_"] and by_id[2]["held_out"] is False


def test_one_class_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string")
    schema = "doc_id bigint, toxic int"
    for labels, want in (([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0), ([], 0.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, schema))
        assert {r["score"] for r in toxicity.score(docs, model).collect()} == {want}
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, spark.createDataFrame([], schema))).count() == 0
