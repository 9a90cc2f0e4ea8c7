"""Query of the quality classifier; scores of a trained model have no SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import table
from docloom.llm.quality import score_quality


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLES: dict[str, str] = {}
