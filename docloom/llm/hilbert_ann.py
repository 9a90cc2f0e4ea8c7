"""Approximate nearest neighbours over shifted space-filling curves.

Each of ``CURVES`` curves projects the vectors to ``AXES`` orthogonal directions (together the
curves cover up to ``CURVES * AXES`` directions), shifts the grid by its own offset and orders the
cells along a Hilbert curve.  A curve's keys are cut into ``RANGES`` key ranges of about equal counts
(quantiles over all rows).  A query meets the rows of its own range and of ``REACH`` ranges on
either side, on every curve; all these windows merge, and rows are ranked by exact distance.

The window is a share of the rows, not a number of them: on vectors without any structure (as the
given ones) the curves bring a neighbour near only in tendency, and a fixed number would lose recall
as rows grow.  On clustered data a smaller ``reach`` serves.

A range is dealt to tasks in parts of at most about ``PART_ROWS`` rows by a hash of the id, so one
vector repeated by a third of all rows makes more parts, not a longer task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import stage
from docloom.llm.vectors import MOST_TASKS, apart, best_per_query, every_part, matrix, ordered_best, part_of

CURVES = 8
AXES = 8
BITS = 5
RANGES = 32
REACH = 4
PART_ROWS = 16_384
QUERY_BLOCK = 4_096
_SEED = 2024


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each grid cell (rows of small non-negative numbers) along the Hilbert curve.

    Inverse of the transposed-axes construction: undo excess rotations from the highest bit, Gray
    encode, and interleave; ``axes * bits`` must stay under 64.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(axes):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    keys = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            keys = keys << 1 | (x[i] >> b) & 1
    return keys


def directions(dim: int, curves: int, axes: int) -> np.ndarray:
    """``curves`` sets of orthonormal columns: (curves, dim, axes)."""
    rng = np.random.default_rng(_SEED + dim)
    axes = min(axes, dim)
    sets, pool = [], np.zeros((dim, 0))
    for _ in range(curves):
        if pool.shape[1] < axes:
            pool, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        sets.append(pool[:, :axes])
        pool = pool[:, axes:]
    return np.stack(sets)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, row numbers, vectors) for each vector length of a batch."""
    table = pa.Table.from_batches([batch])
    dims = table.column("dim").to_numpy()
    for dim in np.unique(dims):
        where = np.flatnonzero(dims == dim)
        yield int(dim), where, matrix(table.column("v").take(pa.array(where)))


def _moments(curves: int, axes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for dim, _, v in _by_dim(batch):
                p = np.einsum("nd,cda->nca", v, directions(dim, curves, axes))
                one = sums.setdefault(dim, [0, 0.0, 0.0])
                one[0] += len(v)
                one[1] += p.sum(0)
                one[2] += (p * p).sum(0)
        rows = [
            (dim, c * 1000 + a, n, float(s[c, a]), float(s2[c, a]))
            for dim, (n, s, s2) in sums.items() for c in range(s.shape[0]) for a in range(s.shape[1])
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64()))],
            names=["dim", "axis", "n", "s", "s2"],
        )

    return run


def _keyed(grids: dict[int, tuple[np.ndarray, np.ndarray]], curves: int, axes: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros((batch.num_rows, curves), np.int64)
            for dim, where, v in _by_dim(batch):
                mean, spread = grids[dim]
                shifts = np.random.default_rng(_SEED).random((curves, mean.shape[1]))
                p = np.einsum("nd,cda->nca", v, directions(dim, curves, axes))
                # three deviations to either side, and room of one cell's share for the shift
                grid = ((p - mean) / spread / 6 + 0.5) * (1 - 1 / (1 << bits)) * (1 << bits) + shifts
                cells = np.clip(grid, 0, (1 << bits) - 1).astype(np.int64)
                for c in range(curves):
                    keys[where, c] = hilbert_keys(cells[:, c], bits)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, keys.size + 1, curves, dtype=np.int32)), pa.array(keys.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "keys"])

    return run


def _nearest(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if rows.num_rows and queries.num_rows:
            ids, v = rows.column("vec_id").to_numpy(), matrix(rows.column("v"))
            for query_id, q in zip(queries.column("q_vec_id").to_pylist(), matrix(queries.column("q_v")), strict=True):
                scores = np.sqrt(np.square(v - q).sum(1))
                scores[ids == query_id] = np.inf
                best = ordered_best(ids, scores, k, largest=False)
                best = best[ids[best] != query_id]
                out_q.append(np.full(len(best), query_id))
                out_v.append(ids[best])
                out_s.append(scores[best])
        kinds = (np.int64, np.int64, np.float64)
        columns = [np.concatenate(x).astype(t) if x else np.empty(0, t) for x, t in zip((out_q, out_v, out_s), kinds, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns), strict=True)))

    return run


def nearest_neighbours(
    rows: DataFrame, is_query, k: int, curves: int = CURVES, axes: int = AXES, ranges: int = RANGES, reach: int = REACH
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the ``k`` nearest of the rows its windows hold.

    ``rows`` is (vec_id long, v array<double>, dim int) with valid vectors, ``is_query`` a condition on
    it.  A row never answers a query with its own id; ties go to the smaller id; fewer than ``k``
    candidates are all returned. Distances are exact. No rows give no rows.
    """
    moments = rows.mapInArrow(
        _moments(curves, axes), "dim int, axis int, n long, s double, s2 double"
    ).groupBy("dim", "axis").agg(*[F.sum(c).alias(c) for c in ("n", "s", "s2")]).collect()  # curves * axes rows a length
    grids: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in moments:
        shape = (curves, min(axes, r.dim))
        mean, spread = grids.setdefault(r.dim, (np.zeros(shape), np.ones(shape)))
        at = divmod(r.axis, 1000)
        mean[at] = r.s / r.n
        spread[at] = max(r.s2 / r.n - mean[at] ** 2, 0) ** 0.5 or 1.0
    keyed = stage(
        rows.mapInArrow(_keyed(grids, curves, axes, BITS), "vec_id long, v array<double>, dim int, keys array<long>"),
        "curves-keys",
    )
    placed = keyed.select("dim", "vec_id", is_query.alias("asks"), F.posexplode("keys").alias("curve", "key"))
    cuts = placed.groupBy("dim", "curve").agg(
        F.array_distinct(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20_000)).alias("cuts")
    )
    placed = stage(
        placed.join(F.broadcast(cuts), ["dim", "curve"]).select(
            "dim", "curve", "vec_id", "asks", F.size(F.filter("cuts", lambda c: c <= F.col("key"))).alias("range")
        ),
        "curves-ranges",
    )
    counts = placed.groupBy("dim", "curve", "range").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    asking = placed.where("asks").groupBy("dim").agg(F.ceil(F.count_distinct("vec_id") / QUERY_BLOCK).alias("blocks"))
    # at most curves * ranges rows a vector length
    groups = F.broadcast(counts.join(F.broadcast(asking), "dim"))
    tasks = min(int(groups.agg(F.sum(F.col("parts") * F.col("blocks"))).first()[0] or 1), MOST_TASKS)
    spots = ["dim", "curve", "range"]
    vectors = keyed.select("dim", "vec_id", "v")
    left = (
        placed.join(groups, spots)
        .select(*spots, part_of("vec_id", F.col("parts"), 1).alias("part"), every_part(F.col("blocks")).alias("block"), "vec_id")
        .join(vectors, ["dim", "vec_id"])
    )
    right = (
        placed.where("asks")
        .select("dim", "curve", "vec_id", F.explode(F.sequence(F.col("range") - reach, F.col("range") + reach)).alias("range"))
        .join(groups, spots)
        .select(*spots, every_part(F.col("parts")).alias("part"), part_of("vec_id", F.col("blocks"), 2).alias("block"), "vec_id")
        .join(vectors, ["dim", "vec_id"])
    )
    keys = [*spots, "part", "block"]
    asked = [f"q_{c}" for c in keys]
    # a stated number of partitions: groups of few bytes and much work would else end up in one task
    found = left.repartition(tasks, *keys).groupBy(*keys).cogroup(apart(right).repartition(tasks, *asked).groupBy(*asked)).applyInArrow(
        _nearest(k), "query_id long, vec_id long, score double"
    )
    return best_per_query(found, k, largest=False)
