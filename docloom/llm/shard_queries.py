"""Query of the sharder; its random slots have no SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table
from docloom.llm.sharding import record_bytes, write_shards

SHARDS = 16


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, written in 16 shards and read back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return write_shards(docs, SHARDS).select(
        "doc_id", record_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )


QUERIES = {"op7_sharding": op7_sharding}
ORACLES: dict[str, str] = {}
