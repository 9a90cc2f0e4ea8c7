"""Query of the packer; tokenisation has no SQL form."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import table
from docloom.llm.packing import pack

TOKENIZER = "word_bpe_49k.json"


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLES: dict[str, str] = {}
