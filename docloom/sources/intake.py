"""Corpus scan and intake checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V
from docloom.operators.running import running_before


def corpus_scan(spark: SparkSession, path: str, order_by: str = "doc_id") -> DataFrame:
    """Ordered multi-file scan.  Order is data (``doc_order``), never row position.

    An integer order column is used as it is; nothing is ranked or shuffled.
    """
    return spark.read.parquet(path).withColumn("doc_order", F.col(order_by).cast("long"))


def binary_scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as ``(filename, size, content)``; sizes can be filtered before bytes are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(
        F.try_element_at(F.split("path", "/"), F.lit(-1)).alias("filename"),
        F.col("length").alias("size"), "path", "content",
    )


def dense_order(documents: DataFrame, order_by: str = "doc_id") -> DataFrame:
    """``doc_order`` 1..n by a unique integer column, without a global window."""
    counted = running_before(
        documents.select(order_by).withColumn("_one", F.lit(1)), order_by, "_one", "_before"
    )
    return documents.join(
        counted.select(order_by, (F.col("_before") + 1).alias("doc_order")), order_by
    )


_SIGNATURES = (
    (".pdf", (V.MAGIC_PDF_HEX,)),
    (".doc", (V.MAGIC_DOC_HEX, V.MAGIC_ZIP_HEX)),
    (".docx", (V.MAGIC_ZIP_HEX,)),
)


def _reason(
    extension: Column, signatures, max_bytes: int, max_files: int
) -> Column:
    head = F.upper(F.hex("head"))
    reason = (
        F.when(F.col("n_files") > max_files, F.lit("too_many_files"))
        .when(F.col("size") > max_bytes, F.lit("too_large"))
        .when(~extension.isin(*[s[0] for s in signatures]), F.lit("extension"))
        .when(F.col("size") == 0, F.lit("empty"))
    )
    for suffix, magics in signatures:
        fits = F.lit(False)
        for magic in magics:
            fits = fits | head.startswith(magic)
        reason = reason.when((extension == suffix) & ~fits, F.lit("content_mismatch"))
    return reason


def intake_validate(
    files: DataFrame,
    max_bytes: int = V.MAX_FILE_BYTES,
    max_files: int = V.MAX_FILES,
    signatures=_SIGNATURES,
) -> tuple[DataFrame, DataFrame]:
    """Split ``(submission, filename, size, head)`` into accepted and rejected rows.

    The first failing check names the reason.  Failing files are set aside instead of
    aborting the job.  Accepted files are at most ``max_bytes`` long: this is the bound
    the per-document windows and arrays downstream rely on.

    The per-submission count is a map-side aggregate joined back, not a window, so one
    huge submission is counted without gathering its files in a task.
    """
    counts = files.groupBy("submission").agg(F.count(F.lit(1)).alias("n_files"))
    # only oversized submissions change the outcome, and only they are joined
    crowded = counts.where(F.col("n_files") > max_files)
    extension = F.lower(F.regexp_extract("filename", r"(\.[^./\\]+)$", 1))
    joined = files.join(crowded, "submission", "left").withColumn(
        "n_files", F.coalesce("n_files", F.lit(1))
    )
    judged = joined.withColumn("reason", _reason(extension, signatures, max_bytes, max_files)).drop("n_files")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")
