"""Alignment of two tokenizers over a corpus, each distinct text once.

1. Rows are grouped by their full text (copies are combined before the exchange); from here on a text
   is one row with its number of copies.
2. Each distinct text is tokenised by a byte-level vocabulary A (with a space in front) and a piece
   vocabulary B (which adds that space itself).  Byte offsets at which a token of both ends cut the text
   into groups; all A and B tokens of a group are linked.
3. Pair counts: a pair of ids counts once a document.  Texts are read in slices (``slices.py``); a slice
   sends each pair it has once, with the copies of the texts that hold it, and gets corpus-wide
   totals back.  Each bucket also reports the highest count of each A id it has: one row an A id.
4. Measures of a text are joined to the documents by the text's digest.  A text with more than a
   thousandth of all rows (fewer than 1000 can be) is joined by broadcast, so no key is hot.

Inside a slice a text is cut before single spaces, where neither vocabulary joins anything (checked when
they are loaded; if one might, texts stay whole), and each distinct piece is tokenised once.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stage
from docloom.llm.slices import (
    REQUESTS, SLICE_BYTES, answers_of, bucket_count, cut, requests, slice_id, stage_slices, told, totals,
)

_SPACE = "▁"
#: before a space that follows something (but no space nor the sign that stands for one) and that no white space follows
_BREAK = re.compile(f"(?<=[^ {_SPACE}]) (?=\\S)")
_ODD = re.compile(f"[ {_SPACE}] | (?!\\S)")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_SLICE = (
    "slice long, digest array<binary>, copies array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in _COUNTS)
    + ", sha array<string>, ends array<int>, at array<int>, occ array<bigint>, pairs array<bigint>"
)
#: documents in a thousandth of which a text may have copies before it is joined by broadcast
HEAVY = 1000


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 as itself and the other bytes from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = byte_of_letter()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, number in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[number] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)
        ]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        split = '"use_regex":true' in self.a.to_str().replace(" ", "") and self.a.normalizer is None
        self.breaks = split and not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        width = len(str(max(len(self.a_bytes), len(pieces))))
        ids = [str(k) for k in range(10**width if width < 6 else max(len(self.a_bytes), len(pieces)))]
        #: ids written out after each separator, as rows of bytes filled up with zeros
        self.written = np.array([s + x for s in ",;|" for x in ids], f"S{width + 1}").view(np.uint8).reshape(3, len(ids), width + 1)

    def pieces(self, text: str) -> list[str]:
        """Parts of a text; each stands for itself with a space in front."""
        if not self.breaks:
            return [text]
        return text.split(" ") if _ODD.search(text) is None and text[0] != " " else _BREAK.split(text)


@functools.cache
def _vocabularies(byte_path: str, piece_path: str) -> Vocabularies:
    """One per worker process."""
    return Vocabularies(byte_path, piece_path)


class _Ids(dict):
    """Numbers its keys in the order they are asked for."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def _sums(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sum of each one's ``n``."""
    if not len(codes):
        return codes, n
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[starts], np.add.reduceat(n, starts)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the runs that begin at ``starts`` and have ``sizes``."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Aligned:
    """Distinct pieces of text under both vocabularies.

    ``good`` says that both vocabularies give back a piece's bytes; the others have no tokens.  ``counts`` has the
    numbers of A tokens, B tokens, groups and links; ``written`` the groups as text, ``;`` in front of each;
    piece ``k`` links the pairs ``pairs[at[first[k] : first[k + 1]]]``, ``occ`` times each.
    """

    def __init__(self, words: list[str], given: Vocabularies):
        spaced = [" " + w for w in words]
        a = [x.ids for x in given.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = given.b.encode(words, num_threads=1) if words else []
        a_of, b_of = given.a_bytes.__getitem__, given.b_bytes.__getitem__
        self.good = np.fromiter(
            (b"".join(map(a_of, x)) == w == b"".join(map(b_of, y)) for x, y, w in zip(a, b, (s.encode() for s in spaced), strict=True)),
            bool, len(words),
        )
        for k in np.flatnonzero(~self.good).tolist():
            a[k] = b[k] = ()
        sides = []
        for ids, size in ((a, given.a_size), (b, given.b_size)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(n.sum()))
            sides.append((n, flat, np.cumsum(size[flat])))
        (n_a, ids_a, ends_a), (n_b, ids_b, ends_b) = sides
        # both sides spell the same bytes, so ends of all pieces in a row can be compared
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a, in_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        owner = np.repeat(np.arange(len(words)), n_a)[np.searchsorted(in_a, np.arange(len(shared)))]
        links = np.bincount(in_a, minlength=len(shared)) * np.bincount(in_b, minlength=len(shared))
        n_links = np.zeros(len(words), np.int64)
        np.add.at(n_links, owner, links)
        self.counts = np.stack([n_a, n_b, np.bincount(owner, minlength=len(words)), n_links])
        self._write(given, ids_a, ids_b, in_a, in_b, n_a + n_b)
        self._link(ids_a, ids_b, in_a, in_b, owner, len(words))

    def _write(self, given: Vocabularies, ids_a, ids_b, in_a, in_b, n: np.ndarray) -> None:
        side = np.concatenate((2 * in_a, 2 * in_b + 1))
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate((ids_a, ids_b))[order]
        first = np.append(True, side[1:] != side[:-1])[: len(side)]
        letters = given.written[np.where(first, 1 + side % 2, 0), ids]
        real = letters != 0
        ends = np.concatenate(([0], np.cumsum(real.sum(1))))[np.concatenate(([0], np.cumsum(n)))].tolist()
        data = letters[real].tobytes()
        self.written = [data[i:j] for i, j in itertools.pairwise(ends)]

    def _link(self, ids_a, ids_b, in_a, in_b, owner: np.ndarray, words: int) -> None:
        a, n_a = np.unique(in_a << 32 | ids_a, return_counts=True)
        b, n_b = np.unique(in_b << 32 | ids_b, return_counts=True)
        group = a >> 32
        kinds = np.bincount(b >> 32, minlength=len(owner))
        first = np.cumsum(kinds) - kinds
        other = _spread(first[group], kinds[group])
        left = np.repeat(np.arange(len(a)), kinds[group])
        self.pairs, own = np.unique((a[left] & 0xFFFFFFFF) << 32 | b[other] & 0xFFFFFFFF, return_inverse=True)
        width = max(len(self.pairs), 1)
        codes, self.occ = _sums(owner[group[left]] * width + own, n_a[left] * n_b[other])
        self.at = codes % width
        self.first = np.searchsorted(codes // width, np.arange(words + 1))


def _read(byte_path: str, piece_path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = _vocabularies(byte_path, piece_path)
        for part in cut(batches, 1, limit):
            ids, texts, valid = _Ids(), [], []
            for raw in part.column(1).cast(pa.large_binary()).to_pylist():
                text = raw.decode("utf-8", "replace")
                valid.append(text.encode("utf-8") == raw)
                texts.append(list(map(ids.__getitem__, given.pieces(text))))
            yield _slice(part, texts, np.array(valid), Aligned(list(ids), given))

    return run


def _slice(part: pa.Table, texts: list[list[int]], valid: np.ndarray, words: Aligned) -> pa.RecordBatch:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.fromiter(itertools.chain.from_iterable(texts), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    good = valid & np.logical_and.reduceat(words.good[flat], starts)
    counts = np.add.reduceat(words.counts[:, flat], starts, axis=1) * good
    sha = [
        hashlib.sha256(b"".join(map(words.written.__getitem__, own))[1:]).hexdigest() if ok else ""
        for own, ok in zip(texts, good.tolist(), strict=True)
    ]
    owner = np.repeat(np.arange(len(texts)), sizes)
    kept = good[owner]
    used, times = np.unique(owner[kept] * len(words.good) + flat[kept], return_counts=True)
    text, word = used // len(words.good), used % len(words.good)
    runs = words.first[word + 1] - words.first[word]
    spots = _spread(words.first[word], runs)
    width = max(len(words.pairs), 1)
    codes, occ = _sums(np.repeat(text, runs) * width + words.at[spots], words.occ[spots] * np.repeat(times, runs))
    ends = np.searchsorted(codes // width, np.arange(len(texts)), "right")
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([slice_id()]), one(part.column(0).to_pylist(), pa.binary()), one(part.column(2).to_numpy(), pa.int64()),
            *[one(c, pa.int64()) for c in counts], one(sha, pa.string()), one(ends, pa.int32()),
            one(codes % width, pa.int32()), one(occ, pa.int64()), one(words.pairs, pa.int64()),
        ],
        names=["slice", "digest", "copies", *_COUNTS, "sha", "ends", "at", "occ", "pairs"],
    )


def _arrays(row: dict, *names: str) -> list[np.ndarray]:
    return [row[name].values.to_numpy(zero_copy_only=False) for name in names]


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                copies, ends, at, pairs = _arrays(row, "copies", "ends", "at", "pairs")
                n = np.zeros(len(pairs), np.int64)
                np.add.at(n, at, np.repeat(copies, np.diff(ends, prepend=0)))
                yield requests(row["slice"].as_py(), 0, pairs, n, buckets)

    return run


def _highest(kind: int, keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest total of each A id; keys are in order, so those of an A id are neighbours."""
    a = keys >> 32
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    return a[starts], np.maximum.reduceat(sums, starts)


_MEASURES = [*_COUNTS, "n_best", "count_sum"]


def _measure(buckets: int, best: np.ndarray):
    names = ["digest", "copies", *_MEASURES, "sha"]
    kinds = [pa.binary(), *[pa.int64()] * (len(_MEASURES) + 1), pa.string()]

    def run(slices: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for k in range(slices.num_rows):
            row = {c: slices.column(c)[k] for c in slices.column_names}
            ends, at, occ, pairs = _arrays(row, "ends", "at", "occ", "pairs")
            count = answers_of(answers, 0, pairs, buckets)
            hit = count == best[pairs >> 32] if len(pairs) else np.empty(0, bool)
            running = [np.concatenate(([0], np.cumsum(x))) for x in (occ * hit[at], occ * count[at])]
            out.append(pa.RecordBatch.from_arrays(
                [
                    row["digest"].values, row["copies"].values, *[row[c].values for c in _COUNTS],
                    *[pa.array(np.diff(x[ends], prepend=0)) for x in running], row["sha"].values,
                ],
                names=names,
            ))
        return pa.Table.from_batches(out) if out else pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})

    return run


def text_measures(docs: DataFrame, byte_path: str, piece_path: str, slice_bytes: int = SLICE_BYTES // 2) -> DataFrame:
    """digest, copies, n_a, n_b, n_groups, n_links, n_best, count_sum, sha: one row per distinct non-empty text.

    ``digest`` is the SHA-256 of the text; the other columns are those of ``align_tokenizers``.
    """
    texts = docs.where(F.col("text") != "").groupBy("text").agg(F.count("*").alias("copies")).select(
        _digest().alias("digest"), "text", "copies"
    )
    slices = stage_slices(texts.mapInArrow(_read(byte_path, piece_path, slice_bytes), _SLICE), "alignment-slices")
    buckets = bucket_count(slices.agg(F.sum(F.size("pairs").cast("long"))).first()[0])
    answers = stage(totals(slices.mapInArrow(_ask(buckets), REQUESTS), _highest), "alignment-totals")
    highest = told(answers, 0).groupBy("key").agg(F.max("total").alias("n")).collect()  # one row an id of vocabulary A
    best = np.zeros(max((r.key for r in highest), default=0) + 1, np.int64)
    for r in highest:
        best[r.key] = r.n
    own = answers.where("slice is not null").select(*[F.col(c).alias(f"a_{c}") for c in ("slice", "kind", "bucket", "totals")])
    return slices.groupBy("slice").cogroup(own.groupBy("a_slice")).applyInArrow(
        _measure(buckets, best), "digest binary, copies long, " + ", ".join(f"{c} long" for c in _MEASURES) + ", sha string"
    )


def _digest():
    return F.unhex(F.sha2("text", 256))


def align_tokenizers(docs: DataFrame, byte_path: str, piece_path: str, slice_bytes: int = SLICE_BYTES // 2) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs``.

    ``n_best`` counts the links whose pair has its A id's corpus-wide highest count (ties included), ``count_sum`` adds
    the counts of all links; a pair's count is the number of rows whose text links it.

    Nulls and edges: a text that is null, empty or not given back byte for byte by either vocabulary (also one that is not
    valid UTF-8) has zeros and an empty digest, and counts for no pair.  Rows that repeat an id or a text, and rows
    with a null id, count each.  A text of any length is one row.  An empty table gives no rows.  Only doc_id and
    text are read, so other columns cannot clash.
    """
    measures = stage(text_measures(docs, byte_path, piece_path, slice_bytes), "alignment-measures")
    rows = measures.agg(F.sum("copies")).first()[0] or 0
    values = [*_MEASURES, "sha"]
    heavy = measures.where(F.col("copies") * HEAVY > rows).select(F.col("digest").alias("h"), F.struct(*values).alias("x"))
    light = measures.where(F.col("copies") * HEAVY <= rows).select(F.col("digest").alias("l"), F.struct(*values).alias("y"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text") != "", _digest()).alias("d"))
    first = keyed.join(F.broadcast(heavy), F.col("d") == F.col("h"), "left")  # fewer than HEAVY rows
    # a row that has its measures, or no text, goes its own way: its key is no digest
    alone = F.unhex(F.hex(F.xxhash64("doc_id")))
    key = F.when(F.col("h").isNull() & F.col("d").isNotNull(), F.col("d")).otherwise(alone)
    joined = first.withColumn("d", key).join(light, F.col("d") == F.col("l"), "left").withColumn("z", F.coalesce("x", "y"))
    return joined.select(
        "doc_id", *[F.coalesce(f"z.{c}", F.lit(0)).cast("long").alias(c) for c in _MEASURES], F.coalesce("z.sha", F.lit("")).alias("groups_sha256")
    )
