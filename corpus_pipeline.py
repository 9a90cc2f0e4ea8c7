"""Cleaning and packing a corpus: quality, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are
written as Parquet and read again.  All stages but the last return the columns of ``documents``.
Edge cases (nulls, empty texts, repeated rows, empty tables) are those of the operators called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import stage, table
from docloom.llm.line_dedup import drop_repeated_lines
from docloom.llm.minhash import keep_one
from docloom.llm.packing import pack
from docloom.llm.quality import keep_good
from docloom.session import apply_settings

TOKENIZER = "word_bpe_49k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of low quality leave."""
    apply_settings(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat or nearly repeat an earlier one leave, and documents of which nothing is left."""
    apply_settings(spark)
    return drop_repeated_lines(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with similar shingle sets (0.8 or more) the least doc_id stays."""
    apply_settings(spark)
    return keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every remaining document in sequences of at most 4096 tokens."""
    apply_settings(spark)
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Scores, sketches and packing have no plain SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
