"""Query of the language-model scores; tests hold it against a plain count of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.backoff_lm import score_texts
from docloom.llm.common import table


def op12_backoff_lm(spark: SparkSession, folder: str) -> DataFrame:
    """All whole documents, scored by a model of those outside the held-out fold."""
    return score_texts(table(spark, folder, "documents"))


QUERIES = {"op12_backoff_lm": op12_backoff_lm}
ORACLES: dict[str, str] = {}
