"""Hard negatives against all products."""

import numpy as np
import pytest
from docloom.llm import lemp
from docloom.llm.lemp import Part, hard_negatives

ROWS = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, anchors, positives, negatives, low, high):
    out = set()
    for a, label, v in anchors:
        own = sorted((-int(v @ w), i) for i, x, w in rows if x == label and i != a and len(w) == len(v))[:positives]
        others = sorted((-int(v @ w), i) for i, x, w in rows if x != label and i != a and len(w) == len(v))
        for s, p in own:
            fit = [(n, i) for n, i in others if low * -s <= 100 * -n <= high * -s][:negatives]
            out |= {(a, p, k, i, -s, -n) for k, (n, i) in enumerate(fit, 1)}
    return out


def clustered(seed, n, dim, scale):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((6, dim))
    v = centres[rnd.integers(0, 6, n)] + rnd.standard_normal((n, dim)) * 0.3
    return [(i, int(i * 7 % 4), np.floor(x * scale * rnd.uniform(0.2, 1)).astype(np.int64)) for i, x in enumerate(v)]


@pytest.mark.parametrize("scale", [3, 90])
def test_all_pairs(spark, monkeypatch, scale):
    monkeypatch.setattr(lemp, "BUCKET_ROWS", 16)
    rows = clustered(scale, 400, 8, scale) + [(1000, 0, np.zeros(8, np.int64)), (1001, 1, np.array([5, -2, 9])), (1002, 1, np.array([5, -2, 9]))]
    rows += [(2000 + k, k % 2, np.array([40, 1])) for k in range(40)]  # ties only
    frame = spark.createDataFrame([(i, x, v.tolist(), len(v)) for i, x, v in rows], "vec_id long, label long, v array<long>, dim int")
    asked = frame.where("vec_id % 10 = 0")
    got = [tuple(r) for r in hard_negatives(frame, asked, 3, 4, 30, 90).collect()]
    want = brute(rows, [r for r in rows if r[0] % 10 == 0], 3, 4, 30, 90)
    assert set(got) == want and len(got) == len(want) > 50
    wide = {tuple(r) for r in hard_negatives(frame, asked, 2, 3, 10, 100).collect()}
    assert wide == brute(rows, [r for r in rows if r[0] % 10 == 0], 2, 3, 10, 100)


def test_coordinates_prune_without_loss():
    rows = clustered(5, 3000, 16, 200)
    ids, labels, v = (np.array(x) for x in zip(*rows, strict=True))
    part, verified = Part(ids, labels, v), 0
    for q in v[:40]:
        best = lemp._Best(5)

        def keep(found, scores, best=best):
            nonlocal verified
            verified += len(found)
            return best.add(found, scores)

        part.reach(q, lambda b: b.ids >= 0, None, keep)
        order = np.lexsort((ids, -(v @ q)))[:5]
        assert best.ids.tolist() == ids[order].tolist()
    assert verified < 40 * len(v) * 0.8


def test_query_edges(spark, tmp_path):
    from docloom.llm.vector_queries import op11_hard_negatives

    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rnd.standard_normal(6)], int(i % 3), "own") for i in range(260)]
    rows += [(300, None, 1, "x"), (400, [1.0] * 6, None, "x"), (None, [1.0] * 6, 1, "x"), (500, [float("nan")] * 6, 1, "x"),
             (600, [float("inf")] + [1.0] * 5, 1, "x"), (700, [None] + [1.0] * 5, 1, "x"), (800, [], 1, "x"), rows[100], (100, [9.0] * 6, 9, "later")]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/embeddings.parquet")
    plain = [(i, (x + 1) % 10 if i % 7 == 0 else x, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v, x, _ in rows[:260]]
    got = [tuple(r) for r in op11_hard_negatives(spark, str(tmp_path)).collect()]
    want = brute(plain, [r for r in plain if r[0] % 100 == 0], 5, 10, 30, 90)
    assert set(got) == want and len(got) == len(want)
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op11_hard_negatives(spark, f"{tmp_path}/none").count() == 0
