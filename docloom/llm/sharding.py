"""Sharding: a two-pass external shuffle into shards, DataFrame functions only.

Law.  A shard is chosen by rendezvous hashing of the key and the shard number: the highest of the
seeded hashes wins.  So key and shard count alone decide, and one more shard takes rows only
into itself, from all others alike.

Pass 1 scatters every shard's records uniformly over memory-sized buckets by a seeded hash of the
whole record; a shard of ``b`` bytes has ``ceil(b / bucket_bytes)`` buckets.  This exchange is
the only one that moves texts.

Pass 2 shuffles each bucket (Fisher-Yates, ``shuffle``) and writes it.  A bucket's place in its
shard is the running sum of bucket counts, so slots are gapless without a sort of the shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import stage_path

BUCKET_BYTES = 16 << 20
SEED = 20240601


def rendezvous(key, shards: int, seed: int = SEED):
    """Struct (h, s): the winning hash and shard of ``key``."""
    return F.array_max(
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(key, F.lit(seed), s).alias("h"), s.alias("s")))
    )


def record_bytes(text):
    """UTF-8 bytes of the text and one more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shuffled_shards(
    records: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``records`` with shard, slot and grown_shard (the shard if there were one more).

    Slots are 0, 1, 2, ... within a shard, in random order of the records.

    Nulls and edges: a null key is one more key value, so its records share a shard; a null text
    counts no bytes but one. Records that repeat are kept and have slots of their own; only those
    equal in key and text share a bucket. Columns of ``records`` named shard, slot or grown_shard
    get a leading underscore. An empty table gives no rows.
    """
    clash = {"shard", "slot", "grown_shard"}
    names, taken = [], {c.lower() for c in records.columns} | clash
    for c in records.columns:
        out = c
        while c.lower() in clash and out.lower() in taken:
            out = f"_{out}"
        taken.add(out.lower())
        names.append(out)
    key, text = names[records.columns.index(key)], names[records.columns.index(text)]
    base = records.toDF(*names)

    best = rendezvous(F.col(f"rec.{key}"), shards, seed)
    extra = F.xxhash64(F.col(f"rec.{key}"), F.lit(seed), F.lit(shards))
    tagged = (
        base.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("rec"))
        .withColumn("best", best)
        .select(
            "rec", F.col("best.s").alias("shard"),
            F.when(extra > F.col("best.h"), F.lit(shards)).otherwise(F.col("best.s")).alias("grown_shard"),
            F.xxhash64(F.col(f"rec.{text}"), F.col(f"rec.{key}"), F.lit(seed + 1)).alias("scatter"),
            record_bytes(F.col(f"rec.{text}")).alias("bytes"),
        )
    )
    buckets = tagged.groupBy("shard").agg(F.ceil(F.sum("bytes") / bucket_bytes).alias("buckets"))
    # one row per shard
    scattered = tagged.join(F.broadcast(buckets), "shard").withColumn("bucket", F.pmod("scatter", "buckets"))
    running = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before")
    )
    gathered = scattered.groupBy("shard", "bucket").agg(
        F.collect_list(F.struct("rec", "grown_shard")).alias("members")
    )
    return (
        gathered.join(before, ["shard", "bucket"])
        .select("shard", "before", F.posexplode(F.shuffle("members", F.lit(seed))).alias("pos", "m"))
        .select("m.rec.*", F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("pos")).cast("long").alias("slot"), F.col("m.grown_shard").cast("int").alias("grown_shard"))
    )


def write_shards(records: DataFrame, shards: int, path: str | None = None, **options) -> DataFrame:
    """Write one folder per shard and read them back; within a file records lie in slot order."""
    out = shuffled_shards(records, shards, **options)
    spark = records.sparkSession
    path = path or stage_path(spark, "shards")
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
