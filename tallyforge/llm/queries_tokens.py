"""Queries on tokens of documents."""

from __future__ import annotations

import public_tokenizers

from . import token_counts, token_files
from .registry import query, table

TOKENIZER = "word_bpe_49k.json"
FILE_END, FLAT_END = 1, 49407


@query("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_documents(docs, public_tokenizers.path(TOKENIZER), FLAT_END)


@query("op9_token_files")
def op9_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read(token_files.write(docs, public_tokenizers.path(TOKENIZER), FILE_END))
