"""Queries on ``embeddings``: nearest neighbours and exact greatest inner products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import stage, table
from docloom.llm.hilbert_ann import nearest_neighbours
from docloom.llm.lemp import hard_negatives
from docloom.llm.maxscore import top_inner_products
from docloom.llm.vectors import valid_vectors

NEAREST = 10
GREATEST = 5
POSITIVES, NEGATIVES = 5, 10
#: percentages of a positive's score between which a hard negative's lies
LOW, HIGH = 30, 90


def op2_hilbert_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose vec_id is divisible by 100 against all rows, by distance."""
    rows = valid_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", allow_zero=False)
    return nearest_neighbours(rows, F.col("vec_id") % 100 == 0, NEAREST)


def op4_maxscore_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose vec_id is divisible by 50 against all rows, by inner product of floor(256 x)."""
    rows = valid_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", allow_zero=True)
    whole = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("v"), "dim")
    return top_inner_products(whole, whole.where("vec_id % 50 = 0"), GREATEST)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """For rows whose vec_id is divisible by 100: rows of other labels at 30 to 90 % of a positive's product.

    Where vec_id is divisible by 7 the label moves on by one first.  Rows with a null label or without a
    valid vector take no part; of rows that repeat an id the least (label, vector) counts.
    """
    given = table(spark, folder, "embeddings")
    ids = F.col("vec_id").cast("long")
    moved = F.when(ids % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = valid_vectors(given.where("label is not null").withColumn("label", moved), "vec_id", "embedding", True, "label")
    whole = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("long")))
    single = whole.groupBy("vec_id").agg(F.min(F.struct("label", "v", "dim")).alias("x")).select("vec_id", "x.*")
    staged = stage(single, "lemp-rows")
    return hard_negatives(staged, staged.where("vec_id % 100 = 0"), POSITIVES, NEGATIVES, LOW, HIGH)


QUERIES = {"op11_hard_negatives": op11_hard_negatives, "op2_hilbert_neighbours": op2_hilbert_neighbours, "op4_maxscore_topk": op4_maxscore_topk}

ORACLES = {
    "op11_hard_negatives": f"""
WITH whole AS (
  SELECT vec_id, min({{'label': label, 'v': v}}) AS x FROM (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
  GROUP BY vec_id
),
scored AS MATERIALIZED (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.x.label = c.x.label AS same, CAST(list_dot_product(q.x.v, c.x.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x.v) = len(c.x.v)
),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
WHERE {LOW} * p.positive_score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.positive_score
QUALIFY rank <= {NEGATIVES}
""",
    "op4_maxscore_topk": f"""
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_dot_product(q.v, c.v) AS BIGINT)) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  GROUP BY q.vec_id, c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= {GREATEST}
""",
}
