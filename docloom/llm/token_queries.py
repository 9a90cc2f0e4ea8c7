"""Query of the byte-level BPE codec; tokenisation has no SQL twin."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.bpe import bpe_round_trip
from docloom.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: number of tokens, digest of the ids, digest of the decoded bytes."""
    docs = table(spark, folder, "documents")
    coded = bpe_round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
ORACLES: dict[str, str] = {}
