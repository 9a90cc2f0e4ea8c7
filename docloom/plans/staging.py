"""Cutting lineage between phases of a long job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []


def staging_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back to a
    folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, _LOCAL[key], ignore_errors=True)
    return _LOCAL[key]


def write_stage(frame: DataFrame, name: str) -> DataFrame:
    """Write a phase result once and go on from the table.

    Computed once (a checkpoint without caching computes twice), columnar, and readable
    again by every branch of the next phase after an executor is lost.
    """
    path = f"{staging_dir(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _WRITTEN.append(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def release_stages(spark: SparkSession) -> None:
    """Delete the stages written so far; for the end of a job, when all results are written."""
    for path in (_WRITTEN.pop() for _ in range(len(_WRITTEN))):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
