"""Language-model scores by a weighted backoff automaton over smoothed n-grams.

Model.  Words are runs of non-blank characters, A-Z lower-cased; a text ends with an end token.
Single tokens have add-half estimates, with one share for unknown words:

    P1(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

Pairs are smoothed towards them with a prior of ``MASS`` observations (a Dirichlet prior, so every
state's distribution sums to one):

    P(w | h) = (c(h w) + MASS * P1(w)) / (c(h) + MASS)

Automaton.  The states are the root, a start state and one for each word.  A pair (h, w) seen in
training is an arc from state h to state w with weight log10 P(w | h).  Every state has a failure arc
to the root with weight log10(MASS / (c(h) + MASS)), and the root an arc for every word, weight log10 P1;
an unknown word leads back to a state without arcs.  One traversal from left to right carries the
state, takes the arc or else failure and root arc, and adds the weights.

Scale.  The corpus is read once into slices of tokens (``slices.py``).  Counts of all words and pairs
are summed corpus-wide, none cut off, and each slice gets back the totals of its own words and pairs:
that part of the automaton which its texts can reach.  No task holds more of the model than that.
Words and pairs are known by 64-bit hashes: two of V words coincide with probability V * V / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stage
from docloom.llm.slices import (
    REQUESTS, SLICE_BYTES, answers_of, bucket_count, cut, mixed, requests, slice_id, stage_slices, told, totals,
)

#: Prior observations of a state (chosen on held-out text, see README).
MASS = 400.0
_WORD, _PAIR = 0, 1
#: no word holds white space
_END, _START = (np.uint64(xxhash.xxh3_64_intdigest(x)).astype(np.int64) for x in (b"\n", b" "))
_SLICE = "slice long, doc_id array<bigint>, held_out array<boolean>, sizes array<int>, tokens array<int>, words array<bigint>"


def held_out(doc_id: Column) -> Column:
    """The fold nothing is learned from: crc32 of the id's text, modulo 5, is 1; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text (with the end token): their number, their local ids, and the ids' hashes."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string())))
    words = lists.flatten()
    real = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    sizes = np.bincount(owner[real], minlength=len(lists)) + 1
    coded = words.filter(pa.array(real)).cast(pa.large_binary()).dictionary_encode()
    known = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known)).view(np.int64)
    tokens = np.full(int(sizes.sum()), len(known), np.int32)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(sizes) - 1] = False
    tokens[inner] = coded.indices.to_numpy()
    return sizes, tokens, np.append(hashes, _END)


def _read(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in cut(batches, 2, limit):
            sizes, tokens, words = tokens_of(part.column(2).combine_chunks())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([slice_id()]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([part.column(1).to_pylist()], pa.list_(pa.bool_())), *[
                        pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
                        for x, t in ((sizes, pa.int32()), (tokens, pa.int32()), (words, pa.int64()))
                    ],
                ],
                names=["slice", "doc_id", "held_out", "sizes", "tokens", "words"],
            )

    return run


class Slice:
    """The words of a slice's texts, and the distinct pairs in which they follow each other."""

    def __init__(self, row: dict):
        get = lambda name: row[name].values.to_numpy(zero_copy_only=False)
        self.held, self.sizes, self.tokens, self.words = get("held_out"), get("sizes"), get("tokens"), get("words")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.train = np.repeat(~self.held.astype(bool), self.sizes)
        states = len(self.words) + 1  # the words, and the start state
        state = np.empty(len(self.tokens), np.int64)
        state[1:] = self.tokens[:-1]
        state[self.starts] = states - 1
        codes, self.arc = np.unique(state * states + self.tokens, return_inverse=True)
        self.source, self.target = codes // states, codes % states
        hashes = np.append(self.words, _START)
        self.pairs = mixed(hashes[self.source], hashes[self.target])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and each pair occurs in training texts."""
        return (
            np.bincount(self.tokens[self.train], minlength=len(self.words)),
            np.bincount(self.arc[self.train], minlength=len(self.pairs)),
        )


class Automaton:
    """States, arcs and failure arcs that a slice can reach; weights are log10 probabilities."""

    def __init__(self, part: Slice, word_totals: np.ndarray, pair_totals: np.ndarray, tokens: int, words: int, mass: float):
        share = (word_totals + 0.5) / (tokens + 0.5 * (words + 1))
        self.root = np.log10(share)
        # every word is followed by a token; the start state is left once a text, like the end is reached
        seen = np.append(word_totals, word_totals[len(part.words) - 1])
        self.failure = np.log10(mass / (seen + mass))
        self.has_arc = pair_totals > 0
        self.arc = np.log10((pair_totals + mass * share[part.target]) / (seen[part.source] + mass))

    def traverse(self, part: Slice) -> np.ndarray:
        """Log-probability of each text.

        The state before a token is the word before it (the start state at a text's start), so the
        steps of all texts of a slice are taken at once: the arc, or else failure and root arc.
        """
        step = np.where(self.has_arc, self.arc, self.failure[part.source] + self.root[part.target])
        return np.add.reduceat(step[part.arc], part.starts)


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                part = Slice(row)
                words, pairs = part.counts()
                yield requests(row["slice"].as_py(), _WORD, part.words, words, buckets)
                yield requests(row["slice"].as_py(), _PAIR, part.pairs, pairs, buckets)

    return run


def _vocabulary(kind: int, keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Of words: how many there are in training texts (key 0), and their occurrences (key 1)."""
    return (np.array([0, 1]), np.array([np.count_nonzero(sums), sums.sum()])) if kind == _WORD else None


def _score(buckets: int, tokens: int, words: int, mass: float):
    def run(slices: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for k in range(slices.num_rows):
            row = {c: slices.column(c)[k] for c in slices.column_names}
            part = Slice(row)
            own = answers_of(answers, _WORD, part.words, buckets)
            automaton = Automaton(part, own, answers_of(answers, _PAIR, part.pairs, buckets), tokens, words, mass)
            add = lambda x: np.add.reduceat(x, part.starts)  # noqa: E731, B023
            out.append(pa.RecordBatch.from_arrays(
                [
                    row["doc_id"].values, row["held_out"].values, pa.array(part.sizes.astype(np.int64)),
                    pa.array(add((own > 0).astype(np.int64)[part.tokens])), pa.array(np.full(len(part.sizes), tokens)),
                    pa.array(add(automaton.root[part.tokens])), pa.array(automaton.traverse(part)),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            ))
        return pa.Table.from_batches(out) if out else _EMPTY

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_EMPTY = pa.table({
    name: pa.array([], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[kind])
    for name, kind in (x.split() for x in _SCORES.split(", "))
})


def score_texts(docs: DataFrame, mass: float = MASS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Nulls and edges: a null, empty or blank text is the end token alone.  A row with a null doc_id
    trains and is scored like any other; rows that repeat an id or a text each count.  Without
    training texts every word is unknown and has probability 1.  An empty table gives no rows.  A
    text of any length is one run of a slice.  Only doc_id and text are read, so other columns
    cannot clash.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")))
    slices = stage_slices(texts.mapInArrow(_read(slice_bytes), _SLICE), "lm-slices")
    buckets = bucket_count(slices.agg(F.sum(F.size("tokens").cast("long"))).first()[0])
    answers = stage(totals(slices.mapInArrow(_ask(buckets), REQUESTS), _vocabulary), "lm-totals")
    sizes = {r.key: r.n for r in told(answers, _WORD).groupBy("key").agg(F.sum("total").alias("n")).collect()}
    own = answers.where("slice is not null").select(*[F.col(c).alias(f"a_{c}") for c in ("slice", "kind", "bucket", "totals")])
    return slices.groupBy("slice").cogroup(own.groupBy("a_slice")).applyInArrow(
        _score(buckets, int(sizes.get(1, 0)), int(sizes.get(0, 0)), mass), _SCORES
    )
