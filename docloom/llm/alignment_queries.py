"""Query of the tokenizer alignment; tests hold it against the libraries and plain counting."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.alignment import align_tokenizers
from docloom.llm.common import table


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """All whole documents under a byte-level and a piece vocabulary."""
    return align_tokenizers(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLES: dict[str, str] = {}
