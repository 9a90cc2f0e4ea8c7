"""Query of the near-duplicate operator; connected components have no plain SQL twin here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import table
from docloom.llm.minhash import near_duplicates


def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents at a similarity of 0.85: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(table(spark, folder, "documents"), num=85, den=100)


QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}
ORACLES: dict[str, str] = {}
