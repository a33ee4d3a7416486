"""From raw documents to token files: STAGES in order, each written as Parquet and read again by the next one.

All but the last stage return the columns of documents; the last one returns a row per written document copy, read
back from the token files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import decontaminate, mixing, near_copies, quality, token_files
from tallyforge.scratch import materialize

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
TOKENIZER, END_ID = "word_bpe_49k.json", 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the rules nor come from a host that nearly always does."""
    return quality.accepted(docs)


def near_copies_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_copies.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items, percent=SIMILAR_PERCENT, size=SHINGLE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the token files."""
    return token_files.read(token_files.write(docs, public_tokenizers.path(TOKENIZER), END_ID))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies_once),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mix_sources),
    ("token files", write_tokens),
]

# Near copies and tokens are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
