"""Exact top-k by inner product: MaxScore over shards of a signed inverted index.

A shard is a bounded set of rows.  Its term (d, +) lists the rows whose component d is positive,
(d, -) those where it is negative; a posting holds the absolute value.  For a query, the list with
the sign of its component adds to a row's score, the other one only subtracts, so

    bound(d) = |q_d| * greatest posting of the adding list

is an upper bound of what term d can add.  Terms are ordered by bound.  Once ``theta`` (the k-th
best exact score so far) is known, the last terms whose bounds together stay under it are
non-essential: a row in none of the essential lists cannot reach the top.  The essential postings
are traversed; the other terms are probed for the remaining rows, strongest first, as long as a
row's partial sum and the bounds still to come reach ``theta``.  Survivors get their exact score.

Queries come in bounded blocks; every (shard, block) pair is one task group, and the shards'
lists are merged per query.  Work is by its statement queries times rows; what travels is each
row once per block of ``QUERY_BLOCK`` queries and each query once per shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.vectors import best_per_query, matrix, ordered_best, paired

SHARD_ROWS = 16_384
QUERY_BLOCK = 4_096
_SEED_ROWS = 32
_PROBE_STEP = 4


class Shard:
    """Postings of one set of rows, and the rows themselves for probing."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.columns = np.ascontiguousarray(rows.T)
        self.lists = {}
        for d, column in enumerate(self.columns):
            for sign in (1, -1):
                own = np.flatnonzero(column * sign > 0)
                # strongest postings first: they seed the threshold
                self.lists[d, sign] = own[np.argsort(-column[own] * sign, kind="stable")]

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than the query's own."""
        terms = []
        for d in np.flatnonzero(q):
            sign = 1 if q[d] > 0 else -1
            postings = self.lists[int(d), sign]
            if len(postings):
                terms.append((abs(int(q[d])) * abs(int(self.columns[d][postings[0]])), int(d), postings))
        terms.sort(key=lambda t: (-t[0], t[1]))
        others = self.ids != query_id
        theta = None
        if terms:
            seed = np.unique(np.concatenate([t[2][:_SEED_ROWS] for t in terms[:4]]))
            seed = seed[others[seed]]
            if len(seed) >= k:
                theta = int(np.partition(self.rows[seed] @ q, len(seed) - k)[len(seed) - k])
        if theta is None or theta <= 0:
            # rows without any adding posting may compete: nothing can be left out
            alive = np.flatnonzero(others)
        else:
            alive = self._competitive(q, terms, theta, others)
        scores = self.rows[alive] @ q
        best = ordered_best(self.ids[alive], scores, k, largest=True)
        return self.ids[alive[best]], scores[best]

    def _competitive(self, q, terms, theta, others) -> np.ndarray:
        """Rows whose score may reach ``theta``; never drops one that does."""
        rest = np.concatenate((np.cumsum([t[0] for t in terms][::-1])[::-1], [0]))
        essential = int(np.argmax(rest < theta))  # terms from here on cannot reach theta together
        partial = np.zeros(len(self.ids), np.int64)
        seen = np.zeros(len(self.ids), bool)
        for _, d, postings in terms[:essential]:
            partial[postings] += self.columns[d][postings] * q[d]
            seen[postings] = True
        alive = np.flatnonzero(seen & others)
        for j in range(essential, len(terms), _PROBE_STEP):
            alive = alive[partial[alive] + rest[j] >= theta]
            for _, d, _ in terms[j : j + _PROBE_STEP]:
                partial[alive] += np.maximum(self.columns[d][alive] * q[d], 0)
        return alive[partial[alive] >= theta]


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if rows.num_rows and queries.num_rows:
            shard = Shard(rows.column("vec_id").to_numpy(), matrix(rows.column("v")))
            for query_id, q in zip(queries.column("q_vec_id").to_pylist(), matrix(queries.column("q_v")), strict=True):
                ids, scores = shard.top(query_id, q, k)
                out_q.append(np.full(len(ids), query_id))
                out_v.append(ids)
                out_s.append(scores)
        columns = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (out_q, out_v, out_s)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns), strict=True)))

    return run


def top_inner_products(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its ``k`` greatest inner products, all rows tried.

    Both inputs are (vec_id long, v array<long>, dim int) with non-null, non-empty vectors; a row never
    answers a query with its own id.  Ties go to the smaller id; fewer than ``k`` candidates are all
    returned.  Rows that repeat an id with another vector count with their best score.  Sums are
    exact while they fit 64 bits.  An empty side gives no rows.
    """
    left, right = paired(rows, queries, SHARD_ROWS, QUERY_BLOCK)
    keys = ["dim", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"q_{c}" for c in keys])).applyInArrow(
        _search(k), "query_id long, vec_id long, score long"
    )
    return best_per_query(found, k, largest=True)
