import zlib
from collections import Counter

import numpy as np
import pytest
from texts import groups, quality, shingles, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF_DIR = "/root/testdata/sf0.001"


def test_stages_like_plain_versions(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [shingles(r["text"], 5) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    before = {r["doc_id"]: r for r in docs.collect()}

    def ids(df):
        assert df.columns == docs.columns
        return sorted(r["doc_id"] for r in df.collect())

    good = [k for k, r in before.items() if not quality(r["text"])[-1]]
    step = stages["quality rules"](spark, docs, SF_DIR)
    assert ids(step) == sorted(good)

    rows = [(k, before[k]["text"]) for k in sorted(good)]
    _, roots, _ = groups(rows, 5, 80)
    once = sorted(rows[i][0] for i, r in enumerate(roots) if i == r)
    step = stages["n-gram Jaccard join"](spark, step, SF_DIR)
    assert ids(step) == once

    clean = [k for k in once if not any(i and 100 * len(i & shingles(before[k]["text"], 5)) >= 80 * len(i) for i in items)]
    step = stages["benchmark decontamination"](spark, step, SF_DIR)
    assert ids(step) == clean

    step = stages["mixing sources"](spark, step, SF_DIR)
    drawn = Counter(ids(step))
    assert set(drawn) <= set(clean) and max(drawn.values()) <= 3
    total = sum(len(words(before[k]["text"])) for k in clean)
    assert 0.5 * total < sum(n * len(words(before[k]["text"])) for k, n in drawn.items()) < 1.5 * total

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = stages["token files"](spark, step, SF_DIR).collect()
    assert Counter(r["doc_id"] for r in found) == drawn
    for r in found:
        values = [*tokenizer.encode(before[r["doc_id"]]["text"], add_special_tokens=False).ids, 1]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(values), zlib.crc32(np.array(values, "<u4").tobytes()))


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF_DIR).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
