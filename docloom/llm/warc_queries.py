"""Query of the archives and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table
from docloom.llm.warc import REVISIT_BYTES, archive_and_read, resolved


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages, written as records and read back: payload length, digest, type, and what a revisit names."""
    pages = table(spark, folder, "pages").select(
        F.col("page_id").cast("long").alias("id"), "url", F.col("html").cast("binary").alias("payload")
    )
    return resolved(archive_and_read(spark, pages)).select(
        F.col("id").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", "refers_to",
    )


QUERIES = {"op8_warc": op8_warc}

ORACLES = {
    "op8_warc": f"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id IS NOT NULL
                 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first
  FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
""",
}
