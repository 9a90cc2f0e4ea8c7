"""Sharding, URL filters, archives, vectors and quality on small cases."""

import gzip
import hashlib
import zlib
from datetime import datetime

import numpy as np
import pytest
from docloom.llm import quality, warc
from docloom.llm.hilbert_ann import hilbert_keys, nearest_neighbours
from docloom.llm.maxscore import Shard, top_inner_products
from docloom.llm.sharding import shuffled_shards, write_shards
from docloom.llm.url_filter import judged, passing, validity_intervals
from docloom.llm.vectors import valid_vectors
from pyspark.sql import functions as F


# sharding


def test_shards(docs, clash):
    rows = [(k, "text %d" % k) for k in range(300)] + [(None, "null"), (None, None), (5, "text 5"), (5, "text 5"), (900, "x" * 90_000)]
    frame = clash(docs(rows))
    out = shuffled_shards(frame, 4, bucket_bytes=500)
    assert [c for c in out.columns if "shard" in c or "slot" in c] == ["_shard", "_slot", "_grown_shard", "shard", "slot", "grown_shard"]
    got = out.collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((i or -1, t or "") for i, t in rows)
    for s in range(4):
        slots = [r.slot for r in got if r["shard"] == s]
        assert sorted(slots) == list(range(len(slots)))
    assert len({r["shard"] for r in got if r.doc_id == 5}) == 1
    # one more shard takes rows only into itself
    grown = {r.doc_id: r["shard"] for r in shuffled_shards(docs(rows), 5).collect()}
    assert all(grown[r.doc_id] == r["grown_shard"] for r in got)
    assert all(r["grown_shard"] in (r["shard"], 4) for r in got)
    assert shuffled_shards(docs([]), 4).count() == 0


def test_written_shards(docs, tmp_path):
    out = write_shards(docs([(k, None if k % 7 == 0 else "t" * k) for k in range(100)]), 3, str(tmp_path / "shards"))
    assert out.count() == 100 and sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]


# url filters


EVENTS = [
    ("example.com", "block", "2024-01-10"), ("example.com", "drop", "2024-03-01"), ("good.example.com", "allow", "2024-01-01"),
    ("example.com/ads/", "block", "2024-01-01"), ("good.example.com/ads/", "block", "2024-02-01"), ("tie.org", "allow", "2024-01-01"),
    ("tie.org", "block", "2024-01-01"), ("tie.org", "block", "2024-01-01"), (None, "block", "2024-01-01"), ("open.org", "nonsense", "2024-01-01"),
    ("edge.org", "block", None),
]
CAPTURES = [
    (1, "http://example.com/x", "2024-01-09 23:59:59", "pass"), (2, "http://example.com/x", "2024-01-10 00:00:00", "block"),
    (3, "https://user@WWW.Example.com:80/x?q=/ads/#y", "2024-02-29 10:00:00", "block"), (4, "http://example.com", "2024-03-01 00:00:00", "pass"),
    (5, "http://good.example.com/", "2024-01-20 00:00:00", "allow"), (6, "http://good.example.com/ads/1", "2024-01-20 00:00:00", "allow"),
    (7, "http://good.example.com/ads/1", "2024-02-20 00:00:00", "block"), (8, "http://example.com/ads/x", "2025-02-20 00:00:00", "block"),
    (9, "http://tie.org", "2024-01-02 00:00:00", "block"), (10, None, "2024-01-02 00:00:00", "pass"), (11, "no url", "2024-01-02 00:00:00", "pass"),
    (12, "http://tie.org", None, "pass"), (13, "http://notexample.com/", "2024-01-20 00:00:00", "pass"), (None, "http://tie.org./", "2024-01-02 00:00:00", "block"),
    (14, "http://" + "a." * 3000 + "tie.org/" + "p/" * 3000, "2024-01-02 00:00:00", "block"),
]


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame(EVENTS, "key string, action string, day string").withColumn("day", F.col("day").cast("date"))


@pytest.fixture(scope="module")
def captures(spark):
    return spark.createDataFrame([c[:3] for c in CAPTURES], "capture_id long, url string, fetched string").withColumn(
        "fetched", F.col("fetched").cast("timestamp")
    )


def test_verdicts(captures, listed):
    assert {r.capture_id: r.verdict for r in judged(captures, listed).collect()} == {c[0]: c[3] for c in CAPTURES}
    kept = passing(captures, listed)
    assert kept.columns == captures.columns
    assert sorted(r.capture_id for r in kept.collect()) == sorted(c[0] for c in CAPTURES if c[0] and c[3] != "block")


def test_intervals(listed):
    rows = [(r.action, r.starts, r.ends.year) for r in validity_intervals(listed).where("key = 'example.com'").collect()]
    assert rows == [("block", datetime(2024, 1, 10), 2024)]


def test_empty_lists(captures, listed):
    assert {r.verdict for r in judged(captures, listed.limit(0)).collect()} == {"pass"}
    assert judged(captures.limit(0), listed).count() == 0


# archives


PAGES = [
    (1, "http://a/1", b"p" * 200), (2, "http://a/2\r\nX: y", b"p" * 200), (3, None, b"p" * 99), (4, "http://a/4", b"p" * 99), (5, "u", None), (6, "u", b""),
    (7, "u", b"\r\n\r\nWARC/1.0\r\n"), (8, "u", bytes(range(256)) * 4000), (9, "u", b"p" * 200), (None, "u", b"p" * 200), (1, "u", b"p" * 200),
]


def nested_payload():
    rng = np.random.default_rng(1)
    inner = [warc.page_record(str(900 + k), "inner", rng.bytes(3000), "d", 3000, None) for k in range(8)]
    return rng.bytes(500) + b"".join(inner) + rng.bytes(500)


@pytest.mark.parametrize("range_bytes", [64, 1000, 1 << 20])
def test_archives_are_read_whole(spark, tmp_path, range_bytes):
    rows = [*PAGES, (10, "nested", nested_payload())]
    pages = spark.createDataFrame(rows, "id long, url string, payload binary").repartition(3)
    folder, files = warc.write_archives(pages, f"file://{tmp_path}")
    records = warc.owned(warc.read_archives(files, folder, range_bytes)).cache()
    got = records.collect()
    assert len(got) == len(rows) == sum(r.records for r in files.collect())
    want = {(i, hashlib.sha256(p or b"").hexdigest(), len(p or b"")) for i, _, p in rows}
    assert {(r.id, r.digest, r.length) for r in warc.resolved(records).collect()} == want
    assert {(r.id, r.refers_to) for r in got if r.record_type == "revisit"} == {(2, 1), (9, 1)}
    for f in files.collect():  # any gzip reader reads them
        data = gzip.decompress(open(f.path, "rb").read())
        assert data.count(b"WARC-Record-ID") >= f.records
    records.unpersist()


def test_one_id_with_two_payloads(spark):
    one, other = b"a" * 200, b"b" * 300
    pages = spark.createDataFrame(
        [(1, "u", one), (1, "u", other), (2, "u", one), (3, "u", other), (3, "u", other)], "id long, url string, payload binary"
    )
    found = sorted(
        (r.id, r.length, r.digest, r.record_type, r.refers_to) for r in warc.resolved(warc.archive_and_read(spark, pages)).collect()
    )
    a, b = (hashlib.sha256(x).hexdigest() for x in (one, other))
    assert found == sorted(
        [(1, 200, a, "response", None), (1, 300, b, "response", None), (2, 200, a, "revisit", 1)] + [(3, 300, b, "revisit", 1)] * 2
    )


def test_a_revisit_without_its_response(spark):
    records = spark.createDataFrame(
        [(5, 9, "d", "revisit", 4, 10)], "id long, refers_to long, digest string, record_type string, length long, offset long"
    )
    assert [tuple(r) for r in warc.resolved(records).select("id", "length", "digest", "refers_to").collect()] == [(5, None, None, 9)]


def test_damaged_members_are_skipped():
    good = [warc.page_record(str(k), "u", b"body %d" % k * 50, "d", 0, None) for k in range(5)]
    bad = bytearray(b"".join(good))
    at = len(good[0]) + len(good[1])
    bad[at + 40 : at + 80] = b"\x00" * 40
    data = b"junk \x1f\x8b\x08 junk" + bytes(bad)

    class Source:
        def read_at(self, n, at):
            return data[at : at + n]

    for step in (7, 100, len(data)):
        found = [r for a in range(0, len(data), step) for r in warc.records_in(Source(), len(data), a, min(a + step, len(data)))]
        ids = [warc.parsed(c)["fields"]["warc-record-id"] for _, _, c in found]
        assert ids == ["<urn:page:0>", "<urn:page:1>", "<urn:page:3>", "<urn:page:4>"]


def test_no_pages(spark):
    assert warc.archive_and_read(spark, spark.createDataFrame([], "id long, url string, payload binary")).count() == 0


# vectors


def vector_rows():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((400, 12))
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    rows += [(1000 + k, v[7].tolist()) for k in range(150)]  # one vector many times
    rows += [(2000, None), (2001, []), (2002, [float("nan")] * 12), (2003, [1.0, None] * 6), (2004, [float("inf")] * 12), (2005, [0.0] * 12)]
    return [*rows, (3, v[3].tolist()), (None, v[3].tolist()), (3000, [1.0, 2.0]), (3001, [2.0, 1.0])]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(vector_rows(), "vec_id long, embedding array<double>")


def usable(zero):
    seen = {}
    for i, v in vector_rows():
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            seen[i] = np.array(v)
    return seen


def test_greatest_inner_products_are_exact(vectors):
    rows = valid_vectors(vectors, "vec_id", "embedding", True)
    whole = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("v"), "dim")
    got = {}
    for r in top_inner_products(whole, whole.where("vec_id % 20 = 0 or vec_id > 2004"), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    data = {i: np.floor(v * 256).astype(int) for i, v in usable(True).items()}
    for q in (q for q in data if q % 20 == 0 or q > 2004):
        scores = sorted(((-int(v @ data[q]), i) for i, v in data.items() if i != q and len(v) == len(data[q])))[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(scores, 1)]


def test_shard_with_only_negative_scores():
    shard = Shard(np.array([1, 2, 3]), np.array([[-5, -1], [-2, -2], [0, 0]]))
    ids, scores = shard.top(9, np.array([3, 1]), 2)
    assert ids.tolist() == [3, 2] and scores.tolist() == [0, -8]


def test_nearest_neighbours(vectors):
    rows = valid_vectors(vectors, "vec_id", "embedding", False)
    got = {}
    for r in nearest_neighbours(rows, F.col("vec_id") % 10 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    data, hits, all_ = usable(False), 0, 0
    for q in (q for q in data if q % 10 == 0):
        near = sorted((float(np.sqrt(np.square(v - data[q]).sum())), i) for i, v in data.items() if i != q and len(v) == len(data[q]))[:10]
        own = sorted(got[q])
        assert [k for k, _, _ in own] == list(range(1, len(own) + 1)) and [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        assert all(abs(s - np.linalg.norm(data[i] - data[q])) < 1e-12 for _, i, s in own)
        hits, all_ = hits + len({i for _, i, _ in own} & {i for _, i in near}), all_ + len(near)
    assert hits >= 0.9 * all_
    assert got[3000] == [(1, 3001, 2**0.5)]
    assert nearest_neighbours(rows.limit(0), F.col("vec_id") % 10 == 0, 10).count() == 0


def test_recall_on_the_given_vectors(spark):
    from docloom.llm.vector_queries import op2_hilbert_neighbours

    folder = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    v, ids = np.array(table.embedding.tolist(), float), table.vec_id.to_numpy()
    got, hits, all_ = op2_hilbert_neighbours(spark, folder).toPandas(), 0, 0
    for q, own in got.groupby("query_id"):
        d = np.sqrt(np.square(v - v[ids == q][0]).sum(1))
        d[ids == q] = np.inf
        near = ids[np.lexsort((ids, d))[:10]]
        hits, all_ = hits + len(set(near) & set(own.vec_id)), all_ + 10
    assert hits >= 0.9 * all_


def test_hilbert_curve_is_a_walk():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# quality


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    fold = [i for i in known if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in fold) and len(got) == docs.count()
    assert np.mean([got[i].predicted == known[i] for i in fold]) > 0.97
    assert np.mean([got[i].predicted for i in fold if known[i] == 1]) > 0.99
    # labels of the held-out fold change nothing
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    model, again = quality.train(docs, labels), quality.train(docs, turned)
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.labels, again.labels)


def test_votes_against_brute_force(spark):
    """Every text's vote recomputed pair by pair from the fitted vectors, in double precision."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model, got = quality.train(docs, labels), {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    known, memo, told = model.vectors.astype(float), quality._Codes(), 0
    for r in docs.select("doc_id", "text").collect():
        v = model.vector(r.text, memo).astype(float)
        length = float(np.sqrt(sum(x * x for x in v)))
        near = sorted(((float(v @ w) / length if length else 0.0, k) for k, w in enumerate(known)), reverse=True)
        if length and len(near) > quality.NEIGHBOURS and near[quality.NEIGHBOURS - 1][0] - near[quality.NEIGHBOURS][0] < 1e-6:
            continue  # a tie at the last place may fall either way
        votes = [(min(max(c, 0.0), 1.0) ** 2 * model.stands[k], model.labels[k]) for c, k in near[: quality.NEIGHBOURS]]
        total = sum(w for w, _ in votes)
        want = sum(w * label for w, label in votes) / total if total > 0 else model.prior
        assert abs(got[r.doc_id] - want) < 1e-4
        told += 1
    assert told > 0.9 * len(got)


def test_quality_edges(docs, clash, spark):
    good, bad = "Some plain words of prose, with a full stop. " * 5, "BUY!! NOW!! NOW!! ### $$$ " * 5
    rows = [(k, f"{good} {k}") for k in range(30)] + [(50 + k, f"{bad} {k}") for k in range(30)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, good * 2000), (None, bad), (0, rows[0][1])]
    labels = spark.createDataFrame(
        [(i, int(i < 50), None) for i, _ in rows[:60]] + [(0, 1, 0), (None, 0, 0), (3, None, 1), (777, 0, 1)], "doc_id long, quality int, toxic int"
    )
    frame = clash(docs(rows))
    got = quality.score_quality(frame, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert {r.predicted for r in got if r.doc_id is not None and r.doc_id < 50} == {1} and got[[r.doc_id for r in got].index(None)].predicted == 0
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id not in (100, 101, 102)) == sorted([*range(30), 103, 0])
    # nothing to learn from: nothing is rejected
    assert {r.score for r in quality.score_quality(frame, labels.limit(0)).collect()} == {1.0}
    assert quality.score_quality(docs([]), labels).count() == 0


def test_shape():
    assert [quality.shape(w) for w in ("Word,", "x***", "ABC!!", "12a", "|", "iPhone")] == ["Aa,", "a*", "A!", "0a", "|", "x"]


def test_quality_does_not_follow_the_sample(docs, spark):
    # one text under both labels, one in ten of them low: the sample holds as many low as high rows
    rows = [(i, "the same few words") for i in range(400)] + [(900, "")]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs(rows), labels, bound=20).collect()}
    trained = [i for i in range(400) if not got[i].held_out]
    share = sum(i % 10 > 0 for i in trained) / len(trained)
    assert sum(i % 10 == 0 for i in trained) >= 10 and abs(got[900].score - share) < 1e-9
    assert all(r.predicted == 1 and abs(r.score - share) < 0.15 for r in got.values())
