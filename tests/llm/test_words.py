from pyspark.sql import functions as F
from texts import shingles as plain

from tallyforge.llm.words import shingles, spare


def test_shingles_like_plain_version(table_of):
    texts = [None, "", " \t", "One", "a b", "A b C d E f", "x\x0by\x0cz w v u t", "é É a\xa0b c d e f", "r r r r r r r"]
    rows = table_of(list(enumerate(texts)), "i int, t string")
    for size in (1, 3, 5):
        found = rows.select("i", shingles(F.col("t"), size, joined=True).alias("s"), F.size(shingles(F.col("t"), size)).alias("n"))
        for r in found.collect():
            want = {" ".join(x) for x in plain(texts[r["i"]], size)}
            assert set(r["s"]) == want and len(r["s"]) == r["n"] == len(want)


def test_spare_names_differ_in_any_case(spark):
    assert spare(spark.range(1).selectExpr("id AS Size", "id AS size_"), "size", "SIZE", "x") == ["size__", "SIZE___", "x"]
