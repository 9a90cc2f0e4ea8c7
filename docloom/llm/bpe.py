"""Byte-level BPE, encoding and decoding with DuckDB inside Spark tasks.

Encoding.  A text is split by the vocabulary's pattern.  A piece that is a token is done; any
other starts as one row for each byte (word, position, token).  A recursive query joins each word's
neighbouring tokens with the merge table, contracts the leftmost pair of the lowest rank, and goes
on with the words that still have a pair to merge; a word without one is final.  Every split of a
token into two tokens is a row of the merge table, as ranks alone decide in such vocabularies.

Each distinct piece of a slice of texts is merged once, and a worker keeps a bounded number of
pieces it has seen.  Rounds of the query grow with the length of a word, so a single piece of over
``LONG`` bytes (never a word) is merged by ``merge_long`` instead, with a heap.

Decoding.  Rows (document, position, token) are joined to the vocabulary and their bytes put
together by an ordered aggregate.

Tasks hold one slice of texts (``SLICE_CHARS``, or one longer text) and the bounded caches.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import gc
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG = 256
SLICE_CHARS = 6_000_000
SLICE_TOKENS = 1_000_000
#: Bytes of parts of texts and of pieces a worker remembers; either is emptied when full.
CACHED = 80 << 20
MERGED = 120 << 20
#: Bytes of an entry beside its characters and ids.
_ENTRY = 150
#: Marks after letters: a run of them is one match of the pattern.
_MARKS = ".,;:!?"
#: The characters with the Unicode property White_Space.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TWO_SPACES = re.compile(f"[{_SPACE}][{_SPACE}]")

# a row is one token of a word: where it begins and ends, and its id; places stay under 1024
_MERGE = """
WITH RECURSIVE live(w, p, q, id, done) AS (
  SELECT w, p, q, id, false FROM pieces
  UNION ALL (
    WITH tokens AS (SELECT w, p, q, id FROM live WHERE NOT done),
    -- the lowest rank, then the leftmost place, packed with where the pair is cut and ends
    chosen AS (
      SELECT a.w, min(CAST(merged AS BIGINT) * 1073741824 + a.p * 1048576 + a.q * 1024 + b.q) AS code
      FROM tokens a JOIN tokens b ON a.w = b.w AND a.q = b.p JOIN merges ON pair = CAST(a.id AS UINTEGER) * 65536 + b.id
      GROUP BY a.w
    ),
    contraction AS (
      SELECT w, (code >> 20) & 1023 AS first, (code >> 10) & 1023 AS cut, CAST(code & 1023 AS INTEGER) AS last,
             CAST(code >> 30 AS INTEGER) AS merged
      FROM chosen
    )
    SELECT t.w, t.p, CASE WHEN t.p = c.first THEN c.last ELSE t.q END, CASE WHEN t.p = c.first THEN c.merged ELSE t.id END,
           c.w IS NULL
    FROM tokens t LEFT JOIN contraction c ON t.w = c.w
    WHERE c.w IS NULL OR t.p <> c.cut
  )
)
SELECT w, list(id ORDER BY p) AS ids FROM live WHERE done GROUP BY w ORDER BY w
"""

_JOIN = """
SELECT d, string_agg(latin, '' ORDER BY p) AS text FROM tokens JOIN vocabulary USING (id) GROUP BY d ORDER BY d
"""


def _at_spaces(text: str) -> tuple[list[str], list[str]]:
    """What precedes the first space, and what follows each."""
    parts = text.split(" ")
    return parts[:1], parts[1:]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@contextlib.contextmanager
def _no_collection() -> Iterator[None]:
    """A slice makes very many lists and no cycles: searching for cycles would only walk the caches again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Cache(dict):
    """Text -> ids as bytes, with an estimate of the memory it takes."""

    size = 0

    def empty(self) -> None:
        self.clear()
        self.size = 0


class Codec:
    """Ranks, their merge table in DuckDB, and bounded caches of encoded parts of texts."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks, self.pattern = read_ranks(path), regex.compile(pattern)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("pairs of ids are packed into 32 bits")
        self.heads, self.spaced, self.merged = Cache(), Cache(), Cache()
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '400MB'; SET preserve_insertion_order = false")
        pairs, merged = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left << 16 | right)
                    merged.append(rank)
        self._load("merges", {"pair": pa.array(pairs, pa.uint32()), "merged": pa.array(merged, pa.int32())})
        self._load("vocabulary", {
            "id": pa.array(list(self.ranks.values()), pa.int32()),
            "latin": pa.array([t.decode("latin-1") for t in self.ranks]),
        })

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, sql: str, name: str, columns: dict) -> pa.Table:
        self.db.register(name, pa.table(columns))
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32 bit) of pieces that are no tokens."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(words), np.uint8)
        places = (np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        found = self._query(_MERGE, "pieces", {
            "w": pa.array(np.repeat(np.arange(len(words), dtype=np.int32), sizes)),
            "p": pa.array(places), "q": pa.array(places + 1),
            "id": pa.array(self.bytes[text]),
        }).column("ids").combine_chunks()
        data = found.flatten().to_numpy().astype("<i4").tobytes()
        ends = (4 * np.cumsum(found.value_lengths().to_numpy())).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same contraction for one very long piece: a heap of pairs over linked tokens."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        ends = list(range(1, len(piece) + 1))
        before, alive = list(range(-1, len(ids) - 1)), [True] * len(ids)
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = ends[i]
            if j < len(ids):
                rank = self.ranks.get(piece[i : ends[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ends[j]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            rank, i, end = heapq.heappop(heap)
            j = ends[i] if alive[i] else len(ids)
            if j >= len(ids) or ends[j] != end:
                continue  # one of the two has changed since
            ids[i], alive[j], ends[i] = rank, False, end
            if end < len(ids):
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([t for t, a in zip(ids, alive, strict=True) if a], "<i4").tobytes()

    def _pieces(self, before: str, part: str) -> list[str]:
        """Matches of the pattern; plain letters with marks after them need no pattern."""
        letters = part.rstrip(_MARKS)
        if letters.isascii() and letters.isalpha():
            return [before + letters, part[len(letters) :]] if len(letters) < len(part) else [before + letters]
        return self.pattern.findall(before + part)

    def _merge(self, pieces: set[str]) -> None:
        """Put the ids of new pieces into ``merged``."""
        words, raws = [], []
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.merged[piece] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.merged[piece] = self.merge_long(raw)
            else:
                words.append(piece)
                raws.append(raw)
        self.merged.update(zip(words, self.merge_words(raws), strict=True))

    def _learn(self, known: Cache, parts: set[str], before: str) -> None:
        """Ids of each part, read with ``before`` in front."""
        # not set.difference: that would walk through all of the cache, as it is a subclass of dict
        missing = [x for x in parts if x not in known]
        if known.size > CACHED:
            known.empty()
            missing = list(parts)
        if self.merged.size > MERGED:
            self.merged.empty()
        split = [self._pieces(before, x) for x in missing]
        new = {p for pieces in split for p in pieces if p not in self.merged}
        self._merge(new)
        self.merged.size += sum(_ENTRY + 2 * len(p) for p in new)
        merged = self.merged.__getitem__
        known.update(zip(missing, (merged(p[0]) if len(p) == 1 else b"".join(map(merged, p)) for p in split), strict=True))
        known.size += sum(_ENTRY + 3 * len(x) for x in missing)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text.

        Where no two white-space characters meet, every space begins a match of the pattern (alone or
        with what follows), so a text is cut before its spaces and each distinct part is split by
        the pattern once; other texts are split by the pattern as they are.
        """
        cut = [(self.pattern.findall(t), []) if _TWO_SPACES.search(t) else _at_spaces(t) for t in texts]
        self._learn(self.heads, set().union(*(heads for heads, _ in cut)), "")
        self._learn(self.spaced, set().union(*(spaced for _, spaced in cut)), " ")
        head, spaced = self.heads.__getitem__, self.spaced.__getitem__
        return [b"".join(map(head, first)) + b"".join(map(spaced, rest)) for first, rest in cut]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids."""
        sizes = np.array([len(x) for x in ids], np.int64)
        if not sizes.sum():
            return [b""] * len(ids)
        found = self._query(_JOIN, "tokens", {
            "d": pa.array(np.repeat(np.arange(len(ids), dtype=np.int32), sizes)),
            "p": pa.array(np.arange(sizes.sum(), dtype=np.int32)), "id": pa.array(np.concatenate(ids).astype(np.int32)),
        })
        out = [b""] * len(ids)
        for d, text in zip(found.column("d").to_pylist(), found.column("text").to_pylist(), strict=True):
            out[d] = text.encode("latin-1")
        return out


@functools.cache
def codec(path: str, pattern: str) -> Codec:
    """One per worker process."""
    return Codec(path, pattern)


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if total and total + size > most:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in _slices([len(t) for t in texts], SLICE_CHARS):
                with _no_collection():
                    ids = own.encode(texts[a:b])
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["doc_id", "ids"])

    return run


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            lists = batch.column(1)
            sizes = [n or 0 for n in lists.value_lengths().to_pylist()]
            for a, b in _slices(sizes, SLICE_TOKENS):
                part = lists.slice(a, b - a)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes[a:b])[:-1]
                data = pa.array(own.decode(np.split(flat, ends)), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), part, data], names=["doc_id", "ids", "data"]
                )

    return run


def bpe_encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: all tokens of every whole text, without special tokens.

    A null or empty text has no tokens; null and repeated doc_ids are passed on row by row; other
    columns are not read.
    """
    return _texts(docs).mapInArrow(_encode(path, pattern), "doc_id long, ids array<int>")


def bpe_decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, data binary: the bytes of each list of ids; a null list gives no bytes."""
    return tokens.select("doc_id", "ids").mapInArrow(_decode(path, pattern), "doc_id long, ids array<int>, data binary")


def bpe_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, data: encoding, then decoding, in one pass over the texts."""
    encode, decode = _encode(path, pattern), _decode(path, pattern)
    return _texts(docs).mapInArrow(lambda batches: decode(encode(batches)), "doc_id long, ids array<int>, data binary")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
