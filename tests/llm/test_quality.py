import random

import duckdb
from oracle import differences
from texts import quality as plain

from tallyforge.llm import quality
from tallyforge.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_counts_like_plain_version(table_of):
    r = random.Random(4)
    some = [" ".join(r.choice(["a", "b", "c", "dé", "#x", "|"]) for _ in range(n)) for n in (0, 1, 2, 3, 5, 9, 60, 400)]
    fresh = ["\n".join(f"w{r.randrange(10**6)} y{i}" for i in range(n)) for n in (30, 80, 3000)]
    odd = [None, "", " \t\n", "one\n\none\n  \none", "x y z x y z x y", "a\x0bb\x0cc\x1cd e", "l1\nl1\nl1"]
    rows = [(i, t, "s", 1) for i, t in enumerate(some + fresh + odd)]
    docs = table_of(rows, "doc_id long, text string, source string, N_WORDS int")
    judged = quality.judge(docs)
    names = ["n_words_", *quality.COUNTS[1:], "base_failed"]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in judged.collect()} == {i: plain(t) for i, t, _, _ in rows}


def test_bad_host_takes_its_documents_along(table_of):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "junk", "bad.example") for i in range(80)] + [(80 + i, good, "bad.example") for i in range(20)]
    rows += [(1000 + i, good if i % 10 else "junk", f"h{i % 7}") for i in range(900)] + [(300, "junk", "single"), (301, good, None)]
    rows += [(400, "junk", "small"), (401, "junk", "small"), (402, good, "small")]
    docs = table_of(rows, "doc_id long, text string, source string")
    judged = {r["doc_id"]: r for r in quality.judge(docs, keep_text=False).collect()}
    kept = {k: r["kept"] for k, r in judged.items()}
    assert {k for k, r in judged.items() if not r["kept"] and not r["base_failed"]} == set(range(80, 100))
    assert not kept[300] and kept[301] and kept[402] and kept[1001] and not kept[1000]
    assert judged[99]["host_docs"] == 100 and 0.5 < judged[99]["host_rate"] < 0.8
    assert judged[402]["host_docs"] == 3 and 0.15 < judged[402]["host_rate"] < 2 / 3
    assert quality.accepted(docs).columns == docs.columns
    assert sorted(r["doc_id"] for r in quality.accepted(docs).collect()) == sorted(k for k, v in kept.items() if v)


def test_planted_host_like_sql(spark, tmp_path):
    """The registered query and its statement on the given documents and two hosts more, one of them bad."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(10**6 + i, "junk" if i % 4 else good, "bad.example") for i in range(60)]
    rows += [(2 * 10**6 + i, good if i % 8 else "junk", "fair.example") for i in range(60)]
    more = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.unionByName(more, allowMissingColumns=True).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = QUERIES["op6_host_quality"](spark, str(tmp_path))
    assert differences(found, con, ORACLES["op6_host_quality"]) is None
    assert {r["doc_id"] for r in found.where("NOT kept AND NOT base_failed").collect()} == {10**6 + i for i in range(0, 60, 4)}


def test_prior_shrinks_small_hosts():
    alpha, beta = quality.beta_prior(100, 1000, 50, 60.0)
    assert 2 <= alpha + beta <= 20 and abs(alpha / (alpha + beta) - 0.1) < 1e-9
    assert quality.beta_prior(0, 0, 0, 0.0) == (0.0, 2.0)
    assert quality.beta_prior(5, 5, 2, 5.0) == (2.0, 0.0)
    assert abs(quality.bad_rate(0.5) - 0.8) < 1e-9 and quality.bad_rate(0.0) == 0.0 and quality.bad_rate(0.95) < 1


def test_prior_is_recovered():
    r = random.Random(5)
    hosts = [(200, r.betavariate(3, 17)) for _ in range(3000)]
    counts = [(n, sum(r.random() < p for _ in range(n))) for n, p in hosts]
    failed, n = sum(f for _, f in counts), sum(n for n, _ in counts)
    alpha, beta = quality.beta_prior(failed, n, len(counts), sum(f * f / n for n, f in counts))
    assert abs(alpha - 3) < 0.5 and abs(beta - 17) < 2.5


def test_empty_table(table_of):
    assert quality.accepted(table_of([], "doc_id long, text string, source string")).count() == 0
