"""Helpers the operators share: staged tables and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.staging import staging_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(frame: DataFrame, name: str) -> DataFrame:
    """Write once (zstd) and go on from the table; a lost executor costs no recomputation."""
    spark = frame.sparkSession
    path = stage_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def fresh(frame: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``frame`` bears (compared without case)."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long pairs -> (node, root): root is the least node reachable.

    Alternating large-star and small-star steps; each round is one written table. Minima are
    aggregated before the exchange and joined back, so a hub with a third of all edges is an
    ordinary (splittable) join key. Nodes without an edge are absent. Ends when a round changes
    no pair; an error is raised if ``max_rounds`` did not suffice (it grows with the logarithm
    of the longest chain).
    """
    current = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}-0",
    )
    mark = _mark(current)
    for k in range(1, max_rounds + 1):
        current = stage(_small_star(_large_star(current)), f"{name}-{k}")
        now = _mark(current)
        if now == mark:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def _mark(pairs: DataFrame) -> tuple:
    row = pairs.agg(
        F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("v", "u") % 1000003).cast("long"))
    ).first()
    return tuple(row)


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(least, "u")
    lower = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return lower.unionByName(own).distinct()
