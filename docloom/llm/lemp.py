"""Hard negatives by coordinate pruning in length buckets.

For an anchor q and a row p with angle alpha between them, ``q . p = |q| |p| cos(alpha)``.  A search for
inner products of at least ``theta`` looks at rows in buckets of falling length.  In a bucket whose
longest row has length l, a row can only qualify with ``cos(alpha) >= t = theta / (|q| l)``; if t is over
1, neither this bucket nor any shorter one holds an answer.  Otherwise the angle between p and the
axis of coordinate f differs by at most ``arccos t`` from that between q and the axis, so coordinate f
of p / |p| lies in

    [cos(min(pi, beta + arccos t)), cos(max(0, beta - arccos t))],   beta = arccos(q_f / |q|)

A bucket holds, for each coordinate, its rows' normalised values in sorted order.  The anchor's
``FOCUS`` largest coordinates each give a run of its list; the shortest run is taken and cut with the
feasible ranges of the others.  What is left is verified with exact integer products.  ``theta`` is
that of the k-th best answer so far and rises from bucket to bucket.

Two searches: an anchor's positives among the rows of its label; then, for each positive, the best
rows of other labels whose score lies between two percentages of the positive's.

Rows and anchors are dealt to bounded parts and blocks by a hash, whatever their labels, ids or
lengths are; each (part, block) pair is one task group, which sorts its rows into length buckets, and the
parts' answers are merged by rank.  Work is by its statement anchors times rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import stage
from docloom.llm.vectors import matrix, ordered_best, paired

PART_ROWS = 16_384
ANCHOR_BLOCK = 4_096
BUCKET_ROWS = 1_024
FOCUS = 6
#: room for rounding in the pruning bounds; answers are verified exactly
_SLACK = 1e-9


class Bucket:
    """Rows of similar length with a sorted list for each coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, lengths: np.ndarray):
        self.ids, self.labels, self.rows, self.longest = ids, labels, rows, float(lengths.max())
        self.units = rows / np.where(lengths > 0, lengths, 1)[:, None]
        self.order = np.argsort(self.units, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.units.T, self.order, 1)

    def feasible(self, unit: np.ndarray, focus: np.ndarray, t: float) -> np.ndarray:
        """Positions of all rows whose cosine with ``unit`` may be ``t`` or more."""
        if t <= -1:
            return np.arange(len(self.ids))
        spread = np.arccos(min(t, 1.0))
        beta = np.arccos(np.clip(unit[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, beta + spread)) - _SLACK
        high = np.cos(np.maximum(0, beta - spread)) + _SLACK
        runs = [
            (int(np.searchsorted(self.sorted[f], a)), int(np.searchsorted(self.sorted[f], b, "right")), f)
            for f, a, b in zip(focus.tolist(), low, high, strict=True)
        ]
        best = min(range(len(runs)), key=lambda k: runs[k][1] - runs[k][0])
        start, end, f = runs[best]
        found = self.order[f, start:end]
        for k, f in enumerate(focus):
            if k != best:
                own = self.units[found, f]
                found = found[(own >= low[k]) & (own <= high[k])]
        return found


class Part:
    """The length buckets of a set of rows, longest first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        square = (rows.astype(np.float64) ** 2).sum(1)
        order = np.lexsort((ids, -square))
        lengths = np.sqrt(square)
        # floats hold every sum of products exactly, as long as those stay under 2 ** 53
        self.exact = float(square.max(initial=0)) < 2**51
        self.buckets = [
            Bucket(ids[own], labels[own], rows[own], lengths[own])
            for own in (order[k : k + BUCKET_ROWS] for k in range(0, len(order), BUCKET_ROWS))
        ]

    def products(self, bucket: Bucket, found: np.ndarray, q: np.ndarray) -> np.ndarray:
        rows = bucket.rows[found]
        if self.exact and float((q.astype(np.float64) ** 2).sum()) < 2**51:
            return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        return rows @ q

    def reach(self, q: np.ndarray, usable, theta: list[int | None], keep) -> None:
        """Feed ``keep`` with the ids and scores of usable rows that may still matter; it returns the new theta.

        ``theta`` None stands for no bound.
        """
        length = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        if not length:
            # every product is 0: the first ids are the best, none can be left out
            for bucket in self.buckets:
                found = np.flatnonzero(usable(bucket))
                theta = keep(bucket.ids[found], np.zeros(len(found), np.int64))
            return
        unit = q / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        for bucket in self.buckets:
            if theta is None:
                found = np.arange(len(bucket.ids))
            else:
                t = theta / (length * bucket.longest) if bucket.longest else (0.0 if theta <= 0 else 2.0)
                if theta > 0 and t > 1 + _SLACK:
                    return  # shorter rows cannot reach it either
                if theta <= 0:
                    # a short row comes closer to a bound of 0 or less than a long one: length tells nothing
                    found = np.arange(len(bucket.ids)) if theta < 0 else bucket.feasible(unit, focus, 0.0)
                else:
                    found = bucket.feasible(unit, focus, t - _SLACK)
            found = found[usable(bucket)[found]]
            theta = keep(bucket.ids[found], self.products(bucket, found, q))


class _Best:
    """The ``k`` best (score, smaller id) pairs seen; ``low`` and ``high`` bound the scores that count."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None):
        self.k, self.low, self.high = k, low, high
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> int | None:
        """Takes what counts; returns the score a further row needs."""
        if self.low is not None:
            inside = (scores >= self.low) & (scores <= self.high)
            ids, scores = ids[inside], scores[inside]
        if len(ids):
            ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
            best = ordered_best(ids, scores, self.k, largest=True)
            self.ids, self.scores = ids[best], scores[best]
        return int(self.scores[-1]) if len(self.ids) == self.k else self.low


def _part(rows: pa.Table) -> Part:
    return Part(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), matrix(rows.column("v")))


def _table(columns: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    joined = [np.concatenate(c).astype(np.int64) if c else np.empty(0, np.int64) for c in columns]
    return pa.table(dict(zip(names, map(pa.array, joined), strict=True)))


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[], [], []]
        if rows.num_rows and anchors.num_rows:
            part = _part(rows)
            given = (anchors.column(f"q_{c}") for c in ("vec_id", "label"))
            for own, label, q in zip(*(c.to_pylist() for c in given), matrix(anchors.column("q_v")), strict=True):
                best = _Best(k)
                part.reach(q, lambda b: (b.labels == label) & (b.ids != own), None, best.add)  # noqa: B023
                for column, values in zip(out, (np.full(len(best.ids), own), best.ids, best.scores), strict=True):
                    column.append(values)
        return _table(out, ["query_id", "vec_id", "score"])

    return run


def bounds(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest integer score between ``low`` and ``high`` percent of a positive's."""
    return -((-low * positive) // 100), (high * positive) // 100


def _negatives(k: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if rows.num_rows and anchors.num_rows:
            part = _part(rows)
            given = [anchors.column(f"q_{c}").to_pylist() for c in ("vec_id", "label", "positives")]
            for own, label, positives, q in zip(*given, matrix(anchors.column("q_v")), strict=True):
                ranges = [(p, *bounds(p["score"], low, high)) for p in positives]
                wanted = [(p, _Best(k, least, most)) for p, least, most in ranges if least <= most]
                if not wanted:
                    continue
                # one traversal serves all positives: the lowest of their bounds counts
                add = lambda ids, scores: min(w.add(ids, scores) for _, w in wanted)  # noqa: E731, B023
                part.reach(q, lambda b: (b.labels != label) & (b.ids != own), min(w.low for _, w in wanted), add)  # noqa: B023
                for p, w in wanted:
                    n = len(w.ids)
                    values = np.full(n, own), np.full(n, p["vec_id"]), w.ids, np.full(n, p["score"]), w.scores
                    for column, own_values in zip(out, values, strict=True):
                        column.append(own_values)
        return _table(out, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` and ``anchors`` are (vec_id long, label long, v array<long>, dim int), one row an id, without
    nulls.  An anchor's positives are its ``positives`` best other rows of the same label; for each, the
    ``negatives`` best rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.  Best: greatest inner product,
    ties to the smaller id; fewer are all returned.  Vectors of different lengths never meet.  A positive
    with a negative score has no negatives (for ``low < high``).  Sums are exact while they fit 64 bits.
    An empty side gives no rows.
    """
    left, right = paired(rows, anchors, PART_ROWS, ANCHOR_BLOCK)
    keys = ["dim", "part", "block"]
    meet = lambda a, b: a.groupBy(*keys).cogroup(b.groupBy(*[f"q_{c}" for c in keys]))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = meet(left, right).applyInArrow(_positives(positives), "query_id long, vec_id long, score long")
    chosen = found.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= positives).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "score"))).alias("positives")
    )
    posed = stage(anchors.join(chosen, F.col("vec_id") == F.col("query_id")).drop("query_id"), "lemp-positives")
    left, right = paired(rows, posed, PART_ROWS, ANCHOR_BLOCK)
    answer = meet(left, right).applyInArrow(
        _negatives(negatives, low, high),
        "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long",
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return answer.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
