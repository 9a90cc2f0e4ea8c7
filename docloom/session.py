"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Joins on (doc_id, block_no) may reuse a hash partitioning on doc_id alone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # whole texts travel in Arrow batches: some thousand rows of them are enough
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """Session for tests and benchmarks; clusters bring their own sizing."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    return apply_settings(builder.getOrCreate(), builder)


def apply_settings(spark: SparkSession, _builder=None) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
