"""Quality of documents: nearest labelled neighbours in a latent-semantic space.

Terms.  A text is a bag of hashed terms, all from the text alone: the shape of each word (runs
of letters, digits and marks), shapes of neighbouring words, the word itself, and whether a word
repeats its predecessor.  Term weights are ``(1 + log tf) * idf``; document frequencies are
counted over all documents.

Space.  A truncated SVD of the labelled rows' term matrix gives ``DIMENSIONS`` directions.  Only
the labelled rows that train the model are bounded (``LABELLED``, about half of each label where
there are enough, chosen by a hash of their id); every document is scored against all of them.

Vote.  The labelled vectors are broadcast (at most ``LABELLED * DIMENSIONS`` numbers, plus the
projection of ``TERMS`` rows).  Each task computes exact cosine products block by block and
averages the labels of the ``NEIGHBOURS`` nearest, weighted by similarity and by how many training
rows a sampled row of its label stands for, so that scores do not follow the sample's mix.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import fresh

LABELLED = 2048
DIMENSIONS = 48
NEIGHBOURS = 15
THRESHOLD = 0.7
_FIELD = 4096
#: shapes, words, pairs of shapes, repeated words, words that differ from the one before
TERMS = 3 * _FIELD + 2
_PIECES = re.compile(r"[^\W\d_]+|\d+|.", re.DOTALL)


def shape(word: str) -> str:
    """``Word,`` -> ``Aa,``; ``x***`` -> ``a*``: runs of one kind are written once."""
    out = []
    for piece in _PIECES.findall(word):
        if piece[0].isalpha():
            kind = "a" if piece.islower() else "A" if piece.isupper() and len(piece) > 1 else "Aa" if piece[0].isupper() else "x"
        else:
            kind = "0" if piece[0].isdigit() else piece
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


class _Codes(dict):
    """Word -> 64 bits: the word's hash with its shape's in the low 12; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        own = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        form = xxhash.xxh3_64_intdigest(shape(word).encode("utf-8", "surrogatepass"))
        value = self[word] = own >> 12 << 12 | form % _FIELD
        return value


def term_counts(text: str | None, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Terms of a whole text and how often each occurs."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    codes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    shapes = (codes & np.uint64(_FIELD - 1)).astype(np.int64)
    own = (codes >> np.uint64(20)).astype(np.int64) % _FIELD
    pairs = (shapes[1:] * 31 + shapes[:-1] * 17 + 7) % _FIELD
    counts = np.bincount(np.concatenate((shapes, own + _FIELD, pairs + 2 * _FIELD)), minlength=TERMS)
    again = int((codes[1:] == codes[:-1]).sum())
    counts[TERMS - 2], counts[TERMS - 1] = again, len(words) - again
    terms = np.flatnonzero(counts)
    return terms, counts[terms].astype(np.float32)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, seen, rows = _Codes(), np.zeros(TERMS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            terms, _ = term_counts(text.as_py(), memo)
            seen[terms] += 1
            rows += 1
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1)), pa.array(np.append(seen[used], rows))], names=["term", "n"]
    )


def _weights(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[terms]
    # repetition is a matter of shares, not of length
    repeats = terms >= TERMS - 2
    w[repeats] = counts[repeats] / counts[repeats].sum() * math.sqrt(len(terms)) * 4
    norm = np.linalg.norm(w)
    return w / norm if norm else w


class Model:
    """What the driver fits and every task reads; bounded by the module's constants."""

    def __init__(self, idf, projection, vectors, labels, prior, stands):
        self.idf, self.projection, self.vectors, self.labels, self.prior = idf, projection, vectors, labels, prior
        self.stands = stands

    def vector(self, text: str | None, memo: dict) -> np.ndarray:
        terms, counts = term_counts(text, memo)
        if not len(terms):
            return np.zeros(self.projection.shape[1], np.float32)
        return _weights(terms, counts, self.idf) @ self.projection[terms]

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, weighted by similarity and the rows each stands for."""
        if not len(self.vectors):
            return np.full(len(vectors), self.prior)
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        products = (vectors / np.where(norms > 0, norms, 1)) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.vectors))
        near = np.argpartition(-products, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(products, near, 1), 0, 1).astype(np.float64) ** 2 * self.stands[near]
        total = weight.sum(1)
        voted = (weight * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, voted, self.prior), 0.0, 1.0)


def fit(texts: list[str | None], labels: list[float], stands: list[float], prior: float, df: np.ndarray, rows: int) -> Model:
    """Latent-semantic space of the labelled texts (at most ``LABELLED``), each standing for ``stands`` training rows."""
    labels, stands = np.asarray(labels, np.float64), np.asarray(stands, np.float64)
    idf = (np.log((1 + rows) / (1 + df)) + 0.2).astype(np.float32)
    memo = _Codes()
    matrix = np.zeros((len(texts), TERMS), np.float32)
    for k, text in enumerate(texts):
        terms, counts = term_counts(text, memo)
        if len(terms):
            matrix[k, terms] = _weights(terms, counts, idf)
    width = min(DIMENSIONS, len(texts))
    if not width:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, prior, stands)
    # randomised range finder with two power steps
    sketch = matrix @ np.random.default_rng(7).standard_normal((TERMS, min(width + 16, len(texts))), np.float32)
    for _ in range(2):
        sketch, _ = np.linalg.qr(matrix @ (matrix.T @ np.linalg.qr(sketch)[0]))
    _, _, right = np.linalg.svd(sketch.T @ matrix, full_matrices=False)
    projection = np.ascontiguousarray(right[:width].T)
    vectors = matrix @ projection
    norms = np.linalg.norm(vectors, axis=1)
    used = norms > 0
    return Model(idf, projection, vectors[used] / norms[used, None], labels[used], prior, stands[used])


def held_out(doc_id):
    """The fold no label is learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    """Fit on at most ``bound`` labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequencies = (
        texts.select("text").mapInArrow(_document_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    ).collect()  # at most TERMS + 1 rows
    df, rows = np.zeros(TERMS, np.float64), 0
    for row in frequencies:
        if row.term < 0:
            rows = row.n
        else:
            df[row.term] = row.n
    known = (
        labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.avg(F.col("quality").cast("double")).alias("label"))
        .where(~held_out(F.col("doc_id")))
        .join(texts.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
        .withColumn("turn", F.xxhash64("doc_id"))
    )
    # the bounded sample: ids first, texts of the chosen ids after
    all_low, all_rows, prior = known.agg(F.count_if(F.col("label") < 0.5), F.count("*"), F.avg("label")).first()
    low = known.where("label < 0.5").orderBy("turn", "doc_id").limit(bound // 2).collect()
    high = known.where("label >= 0.5").orderBy("turn", "doc_id").limit(bound - len(low)).collect()
    stands = [all_low / max(len(low), 1)] * len(low) + [(all_rows - all_low) / max(len(high), 1)] * len(high)
    chosen = spark.createDataFrame(
        [(r.doc_id, r.label, n) for r, n in zip(low + high, stands)], "doc_id long, label double, stands double"
    )
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("label").alias("label"), F.first("stands").alias("stands")
    ).orderBy("doc_id").collect()
    return fit(
        [r.text for r in sample], [r.label for r in sample], [r.stands for r in sample], 1.0 if prior is None else prior, df, rows
    )


def _parts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with the scores of their last column's texts."""
    memo = _Codes()
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            yield part, model.scores(np.stack([model.vector(x.as_py(), memo) for x in part.column(part.num_columns - 1)]))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _parts(batches, model):
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(scores, pa.float64())], names=[*part.schema.names[:-1], "score"]
            )

    return run


def score_quality(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Nulls and edges: a text without words (null, empty, blank) has no direction and gets the share
    of label 1 among all training rows; without any training row every score is 1, so nothing is
    rejected. A null doc_id is scored like any row and never trains. Labels that are null are
    ignored, repeated ones averaged. Only doc_id and text are read, so other columns cannot clash.
    """
    model = train(docs, labels, bound)
    scored = docs.select("doc_id", "text").mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` that are predicted good, all columns kept; nothing is exchanged."""
    model = train(docs, labels, bound)
    (text,) = fresh(docs, "text_scored")
    return docs.select("*", F.col("text").alias(text)).mapInArrow(_keeper(model), docs.schema)


def _keeper(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _parts(batches, model):
            kept = part.filter(pa.array(scores >= THRESHOLD))
            yield pa.RecordBatch.from_arrays(kept.columns[:-1], names=kept.schema.names[:-1])

    return run
