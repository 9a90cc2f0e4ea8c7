import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """documents with the given (doc_id, text) rows."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def clash():
    """The same rows with columns that bear names the operators use themselves."""

    def add(frame):
        from pyspark.sql import functions as F

        for name in ("shard", "slot", "grown_shard", "score", "line_flags", "doc_key", "text_cut", "text_scored", "doc_id_gone", "h1", "bands", "predicted"):
            frame = frame.withColumn(name, F.lit("own"))
        return frame

    return add
