"""Helpers on vector tables: valid rows, bounded blocks, merging of partial results."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(table: DataFrame, id_column: str, vector: str, allow_zero: bool, *more: str) -> DataFrame:
    """(vec_id, v, dim, and the columns ``more``): rows with an id whose vector is not null, not empty and all finite.

    Rows that repeat all of these count once.  Vectors of different lengths (``dim``) never
    meet; the operators treat each length as a table of its own.
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col(id_column).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(v) > 0)
    if not allow_zero:
        usable = usable & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    return (
        table.where(usable).select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"), *more).dropDuplicates()
        .withColumn("dim", F.size("v"))
    )


def part_of(column: str, parts: Column, seed: int) -> Column:
    """A hashed part number, 0 to ``parts - 1``."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), parts).cast("int")


def every_part(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))


def apart(frame: DataFrame) -> DataFrame:
    """All columns under names of their own (``q_...``): one table may be both sides of a cogroup."""
    return frame.select(*[F.col(c).alias(f"q_{c}") for c in frame.columns])


#: a part smaller than this is not worth a task of its own
_LEAST_ROWS = 1_024
#: more groups than this share tasks
MOST_TASKS = 50_000


def paired(rows: DataFrame, queries: DataFrame, part_rows: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Every part of ``rows`` with every block of ``queries`` of the same vector length, ready for a cogroup.

    Both sides have ``dim`` and ``vec_id``.  The left side gains ``part`` and ``block``; the right side's columns are
    all named ``q_...``.  Parts and blocks hold about ``part_rows`` and ``block_rows`` rows at most, whatever the ids
    are; a small table is cut into as many parts as keep the cores busy.  Both sides are exchanged by the number
    of groups, so that groups of few bytes and much work do not end up in one task.
    """
    spark = rows.sparkSession
    busy = 2 * spark.sparkContext.defaultParallelism
    count = lambda frame: {r.dim: r["count"] for r in frame.groupBy("dim").count().collect()}
    here, asked = count(rows), count(queries)  # one row a vector length
    cuts = [
        (dim, max(math.ceil(here[dim] / part_rows), min(busy, math.ceil(here[dim] / _LEAST_ROWS))), math.ceil(asked[dim] / block_rows))
        for dim in here.keys() & asked.keys()
    ]
    groups = min(max(1, sum(p * b for _, p, b in cuts)), MOST_TASKS)
    sizes = F.broadcast(spark.createDataFrame(cuts, "dim int, parts long, blocks long"))
    left = rows.join(sizes, "dim").withColumns(
        {"part": part_of("vec_id", F.col("parts"), 1), "block": every_part(F.col("blocks"))}
    ).drop("parts", "blocks")
    right = queries.join(sizes, "dim").withColumns(
        {"part": every_part(F.col("parts")), "block": part_of("vec_id", F.col("blocks"), 2)}
    ).drop("parts", "blocks")
    keys = ["dim", "part", "block"]
    return left.repartition(groups, *keys), apart(right).repartition(groups, *[f"q_{c}" for c in keys])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows."""
    array = column.combine_chunks()
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def best_per_query(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best of partial results, ties to the smaller id."""
    single = found.groupBy("query_id", "vec_id").agg((F.max if largest else F.min)("score").alias("score"))
    score = F.col("score").desc() if largest else F.col("score").asc()
    order = Window.partitionBy("query_id").orderBy(score, F.col("vec_id").asc())
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def ordered_best(ids: np.ndarray, scores: np.ndarray, k: int, largest: bool) -> np.ndarray:
    """Positions of the ``k`` best, ties to the smaller id."""
    keys = -scores if largest else scores
    if len(keys) > k:
        near = np.flatnonzero(keys <= np.partition(keys, k - 1)[k - 1])
    else:
        near = np.arange(len(keys))
    return near[np.lexsort((ids[near], keys[near]))[:k]]
