"""Corpus-wide counts for bounded slices of a corpus.

A slice is a bounded run of a task's rows; it is written as one row of a staged table, so whatever
happens to executors later, everybody reads the same slices.  Where a slice needs the corpus-wide
count of each of its keys, it sends every distinct key once, with its own count, to the task of the
key's bucket; there the counts of all slices meet, and each slice gets its totals back in the order
it asked.  A key that is in every text is one entry a slice.  The number of buckets follows the
number of keys, so a bucket stays bounded at any size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stage_path

SLICE_BYTES = 12 << 20
BUCKET_KEYS = 1 << 21
#: slices a file of the staged table holds: a reader takes a whole file at once
_FILE_SLICES = 4
_REQUEST = pa.schema([
    ("slice", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))
])
_ANSWER = "slice long, kind int, bucket int, keys array<bigint>, totals array<bigint>"


def slice_id() -> int:
    """A new number; only the written attempt of a task is ever read."""
    return uuid.uuid4().int >> 65


def cut(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Runs of rows whose texts (column ``text``) have about ``limit`` bytes, or one longer text."""
    held, size = [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        start = 0
        for row, own in enumerate(sizes.to_pylist()):
            if size and size + own > limit:
                held.append(batch.slice(start, row - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, row
            size += own
        held.append(batch.slice(start))
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def stage_slices(frame: DataFrame, name: str) -> DataFrame:
    """Write slices, a few to a file, and go on from the table."""
    path = stage_path(frame.sparkSession, name)
    frame.write.option("compression", "zstd").option("maxRecordsPerFile", _FILE_SLICES).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def bucket_count(keys: int | None) -> int:
    return max(1, math.ceil((keys or 0) / BUCKET_KEYS))


def mixed(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """Two 64-bit numbers as one, evenly spread."""
    k = (a.astype(np.uint64) ^ (a.astype(np.uint64) >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    k = k + (b.astype(np.uint64) if isinstance(b, np.ndarray) else np.uint64(b))
    k = (k ^ (k >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (k ^ (k >> np.uint64(29))).view(np.int64)


def asking_order(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a slice asks for its keys, and the bucket of each key in that order."""
    place = ((mixed(keys).view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(place, kind="stable")
    return order, place[order]


def requests(number: int, kind: int, keys: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket in which a slice has distinct ``keys``, counted ``n`` times."""
    order, place = asking_order(keys, buckets)
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    offsets = pa.array(np.append(starts, len(place)).astype(np.int32))
    rows = len(starts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, number, np.int64)), pa.array(np.full(rows, kind, np.int32)), pa.array(place[starts]),
            pa.ListArray.from_arrays(offsets, pa.array(keys[order].astype(np.int64))),
            pa.ListArray.from_arrays(offsets, pa.array(n[order].astype(np.int64))),
        ],
        schema=_REQUEST,
    )


REQUESTS = "slice long, kind int, bucket int, keys array<bigint>, n array<bigint>"


def totals(asked: DataFrame, summary: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray] | None]) -> DataFrame:
    """(slice, kind, bucket, totals) for each request; with a null slice, each bucket's ``summary``.

    ``summary(kind, distinct keys, their totals)`` may return two arrays (``keys``, ``totals``).
    """

    def merge(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lists = group.column("keys").combine_chunks()
        keys, n = lists.flatten().to_numpy(), group.column("n").combine_chunks().flatten().to_numpy()
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.ones(len(ordered), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        starts = np.flatnonzero(first)
        sums = np.add.reduceat(n[order], starts)
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(sums, np.diff(np.append(starts, len(keys))))
        offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(np.int32)
        rows = len(lists)
        none = pa.array([None] * rows, pa.list_(pa.int64()))
        answers = [group.column("slice").combine_chunks(), group.column("kind").combine_chunks(), group.column("bucket").combine_chunks(),
                   none, pa.ListArray.from_arrays(pa.array(offsets), pa.array(total))]
        names = ["slice", "kind", "bucket", "keys", "totals"]
        out = [pa.RecordBatch.from_arrays(answers, names=names)]
        kind, bucket = group.column("kind")[0].as_py(), group.column("bucket")[0].as_py()
        told = summary(kind, ordered[starts], sums)
        if told is not None:
            one = [pa.array([None], pa.int64()), pa.array([kind], pa.int32()), pa.array([bucket], pa.int32())]
            lists = [pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in told]
            out.append(pa.RecordBatch.from_arrays([*one, *lists], names=names))
        return pa.Table.from_batches(out)

    return asked.groupBy("kind", "bucket").applyInArrow(merge, _ANSWER)


def answers_of(group: pa.Table, kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """A slice's totals of one kind, in the order of ``keys``."""
    own = group.filter(pc.equal(group.column(next(c for c in group.column_names if c.endswith("kind"))), kind))
    place = own.column(next(c for c in own.column_names if c.endswith("bucket"))).to_numpy()
    lists = own.column(next(c for c in own.column_names if c.endswith("totals"))).take(pa.array(np.argsort(place))).combine_chunks()
    order, _ = asking_order(keys, buckets)
    found = lists.flatten().to_numpy()
    if len(found) != len(keys):
        raise ValueError("a slice must get one total for each of its keys")
    out = np.empty(len(keys), np.int64)
    out[order] = found
    return out


def told(answers: DataFrame, kind: int) -> DataFrame:
    """key, total: the buckets' summaries of one kind."""
    return answers.where(F.col("slice").isNull() & (F.col("kind") == kind)).select(
        F.explode(F.arrays_zip("keys", "totals")).alias("x")
    ).select(F.col("x.keys").alias("key"), F.col("x.totals").alias("total"))
