"""Packing documents into token sequences: hierarchical best fit.

1. Each task tokenises its documents, cuts those longer than a sequence into pieces, and packs
   its pieces by best fit decreasing.  Only piece sizes are held, never tokens of a partition.
2. Bins that are nearly full (``FULL`` of the capacity) are final.  The others climb a tree: the
   underfull bins of ``FAN`` groups meet in one task and are packed again, as items, by best fit.
   After the last level one group is left.
3. Every move is recorded as (bin, new bin, offset), and the moves are joined to the pieces.

What climbs is bounded.  Best fit leaves at most one bin of a group half empty or more, and two
bins over half never fit together, so beyond the bins up to half full a group passes on at most
``CARRY`` others (the emptiest): more could not find a partner.  The rest are final as they are.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stage

CAPACITY = 4096
FULL = 0.99
FAN = 8
CARRY = 4096
END_ID = 1


#: marks that may follow a word's letters; a run of them is one piece of its own to the tokenizer
_TAIL = ".,;:!?%$#&*|"


class _WordIds(dict):
    """Word -> its ids as little-endian bytes; emptied when full.

    Most words are letters and a run of marks.  Those two are pieces the tokenizer never merges
    across, so each distinct piece is tokenised once, many in one call: every piece's last token
    bears the end-of-word suffix, which tells the pieces' ids apart.  Any other word is
    tokenised by itself.
    """

    def __init__(self, path: str, limit: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.pieces = Tokenizer.from_file(path), limit, {"": b""}
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[number] = bool(suffix) and token.endswith(suffix)

    def learn(self, words: list[list[bytes]]) -> None:
        # not set.difference: that would walk through all of this dict, as it is a subclass
        missing = [w for w in set().union(*words) if w not in self]
        if len(self) + len(missing) > self.limit:
            self.clear()
            missing = list(set().union(*words))
        if len(self.pieces) + 2 * len(missing) > self.limit:
            self.pieces = {"": b""}
        plain, odd = [], []
        for word in missing:
            text = word.decode("utf-8", "replace")
            letters = text.rstrip(_TAIL)
            if not letters or letters.isalpha():
                plain.append((word, letters.lower() if letters.isascii() else letters, text[len(letters) :]))
            else:
                odd.append((word, text))
        self._tokenise(sorted({x for _, *parts in plain for x in parts}.difference(self.pieces)))
        for word, letters, tail in plain:
            self[word] = self.pieces[letters] + self.pieces[tail]
        for start in range(0, len(odd), 4096):
            part = odd[start : start + 4096]
            found = self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False)
            for (word, _), one in zip(part, found, strict=True):
                self[word] = np.array(one.ids, "<u4").tobytes()

    def _tokenise(self, pieces: list[str]) -> None:
        for start in range(0, len(pieces), 1000):
            part = pieces[start : start + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part) and (not len(ids) or ends[-1] == len(ids)):
                data, at = ids.tobytes(), 0
                for piece, end in zip(part, (4 * ends).tolist(), strict=True):
                    self.pieces[piece] = data[at:end]
                    at = end
            else:  # a vocabulary without that suffix on every last token
                for piece, one in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self.pieces[piece] = np.array(one.ids, "<u4").tobytes()


@functools.cache
def _word_ids(path: str) -> _WordIds:
    """One per worker process: loading a tokenizer takes most of a second."""
    return _WordIds(path)


def encoded(texts: list[bytes | None], ids: _WordIds) -> Iterator[bytes]:
    """Ids of whole texts, then the end id, as little-endian 32-bit numbers.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    words in a row; words are cut at ASCII white space only, which any tokenizer version treats
    as such, and each distinct word is tokenised once.
    """
    end = np.array([END_ID], "<u4").tobytes()
    for start in range(0, len(texts), 64):
        words = [t.split() if t else [] for t in texts[start : start + 64]]
        ids.learn(words)
        for own in words:
            yield b"".join(map(ids.__getitem__, own)) + end


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Best fit decreasing: bin and offset of each item, and the number of bins.

    ``open_rooms`` has a bit for each room some bin has left, so the tightest fit is the lowest
    bit at or above the item's size.
    """
    bins, offsets, used = [0] * len(sizes), [0] * len(sizes), 0
    waiting: dict[int, list[int]] = {}
    open_rooms = 0
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[k]
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = waiting[room].pop()
            if not waiting[room]:
                open_rooms &= ~(1 << room)
        else:
            own, room, used = used, capacity, used + 1
        bins[k], offsets[k] = own, capacity - room
        room -= size
        waiting.setdefault(room, []).append(own)
        open_rooms |= 1 << room
    return bins, offsets, used


def _pack_partition(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _word_ids(path)
        docs, pieces, starts, lengths, crcs = [], [], [], [], []
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for start in range(0, batch.num_rows, 512):
                names = batch.column(0).slice(start, 512).to_pylist()
                for name, own in zip(names, encoded(texts.slice(start, 512).to_pylist(), ids), strict=True):
                    for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[at : at + 4 * capacity]
                        docs.append(name)
                        pieces.append(piece)
                        starts.append(at // 4)
                        lengths.append(len(part) // 4)
                        crcs.append(zlib.crc32(part))
        bins, offsets, used = best_fit(lengths, capacity)
        fills = np.zeros(used, np.int64)
        np.add.at(fills, bins, lengths)
        group = TaskContext.get().partitionId()
        numbers = np.array(bins, np.int64) + (group << 32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array(numbers),
                pa.array(offsets, pa.int64()), pa.array(fills[bins] if bins else [], pa.int64()),
                pa.array([group] * len(docs), pa.int64()),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill", "grp"],
        )

    return run


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, grp long"


def _climbing(fills: np.ndarray, capacity: int) -> np.ndarray:
    """Which bins go up a level: see the module text."""
    up = fills < FULL * capacity
    over_half = np.flatnonzero(up & (2 * fills > capacity))
    up[over_half[np.argsort(fills[over_half], kind="stable")[CARRY:]]] = False
    return up


def _merge_group(capacity: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        order = np.lexsort((group.column("bin").to_numpy(), -group.column("fill").to_numpy()))
        names, fills = group.column("bin").to_numpy()[order], group.column("fill").to_numpy()[order]
        bins, offsets, used = best_fit(fills.tolist(), capacity)
        totals = np.zeros(used, np.int64)
        np.add.at(totals, bins, fills)
        leaders = np.full(used, np.iinfo(np.int64).max)
        np.minimum.at(leaders, bins, names)
        up = _climbing(totals, capacity)
        return pa.table(
            {
                "bin": names, "target": leaders[bins], "base": np.array(offsets, np.int64),
                "fill": totals[bins], "up": up[bins], "grp": np.full(len(names), key[0].as_py(), np.int64),
            }
        )

    return run


def _merged(underfull: DataFrame, capacity: int, level: int) -> DataFrame:
    return stage(
        underfull.withColumn("grp", F.floor(F.col("grp") / FAN).cast("long")).groupBy("grp").applyInArrow(
            _merge_group(capacity), "bin long, target long, base long, fill long, up boolean, grp long"
        ),
        f"packing-level-{level}",
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Place all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and one end id; only documents over ``capacity`` are cut.

    Nulls and edges: a null or empty text is the end id alone.  A null doc_id is placed like any
    other and stays null; rows that repeat are placed once each.  An empty table gives no rows.
    Other columns are not read.
    """
    placed = stage(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            _pack_partition(tokenizer_path, capacity), _PIECES
        ),
        "packing-pieces",
    )
    groups = placed.agg(F.max("grp")).first()[0]
    carried = placed.where(F.col("fill") < FULL * capacity).select("bin", "fill", "grp").distinct()
    moves = None
    level = 0
    while groups:
        level += 1
        groups //= FAN
        step = _merged(carried, capacity, level)
        now = step.select("bin", "target", "base")
        if moves is None:
            moves = now
        else:  # where the earlier bins are now
            later = now.select(F.col("bin").alias("target"), F.col("target").alias("next"), F.col("base").alias("more"))
            moves = moves.join(later, "target", "left").select(
                "bin", F.coalesce("next", "target").alias("target"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")
            )
        carried = step.where("up").select(F.col("target").alias("bin"), "fill", "grp").distinct()
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if moves is None:
        return placed.select(*kept, F.col("bin").alias("sequence_id"), "offset")
    return placed.join(stage(moves, "packing-moves"), "bin", "left").select(
        *kept, F.coalesce("target", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def sequences(docs: DataFrame, placed: DataFrame, tokenizer_path: str) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most one capacity of numbers each).

    ``doc_id`` must be unique in ``docs``.  Tokens are made again where they are needed, so the
    placement never has to carry them; a sequence is one bounded group.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _token_ids(tokenizer_path), "doc_id long, ids array<int>"
    )
    parts = placed.join(ids, "doc_id").select(
        "sequence_id", F.struct("offset", F.slice("ids", F.col("start") + 1, F.col("length")).alias("ids")).alias("part")
    )
    return parts.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["ids"])).alias("ids")
    )


def _token_ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _word_ids(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                own = [np.frombuffer(x, "<i4") for x in encoded(part.column(1).cast(pa.binary()).to_pylist(), ids)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own)))],
                    names=["doc_id", "ids"],
                )

    return run
