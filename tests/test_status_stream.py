"""Status on a stream: folding, expiry by timer and by gap, restarts."""

import datetime as dt

import pytest
from docloom.operators import status
from docloom.streaming import status_stream as stream

EVENT = "id string, event_ts timestamp, seq long, kind string, stage string, message string, done int, total int"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


EVENTS = [
    # a: still open; b: complete, then silent; c: never started; d: a gap ends it, a later start begins anew
    ("a", at(300), 1, "start", None, None, None, None), ("a", at(310), 2, "update", "ia", "m", 4, 10), ("a", at(355), 3, "update", "ia", "n", None, 8),
    ("b", at(0), 4, "start", None, None, None, None), ("b", at(10), 5, "update", "ia", "m", 3, 10), ("b", at(20), 6, "complete", None, "ok", None, None),
    ("c", at(340), 7, "update", "ia", "m", 4, 10),
    ("d", at(0), 8, "start", None, None, None, None), ("d", at(100), 9, "update", "ia", "m", 1, 2), ("d", at(320), 10, "start", None, None, None, None),
    ("d", at(330), 11, "update", "x", "m", 5, 8), ("d", at(340), 12, "error", None, "bad", None, None),
    # e: dead after a gap, whatever follows
    ("e", at(0), 13, "start", None, None, None, None), ("e", at(350), 14, "update", "ia", "m", 4, 10),
    # f: an update after completion reopens the progress, not the state
    ("f", at(330), 15, "start", None, None, None, None), ("f", at(340), 16, "complete", None, "ok", None, None), ("f", at(350), 17, "update", "x", "m", 1, 3),
]
WANT = {
    "a": (False, "processando", "ia", 4, 8, 50, at(355)), "b": (True, None, None, None, None, None, at(20)),
    "d": (False, "erro", "erro", 5, 8, 62, at(340)), "e": (True, None, None, None, None, None, at(0)),
    "f": (False, "concluido", "x", 1, 3, 33, at(350)),
}


def write(spark, rows, folder):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, base, per_trigger=None):
    schema = spark.createDataFrame([], EVENT).schema
    events = stream.read_events(spark, folder, schema, per_trigger=per_trigger)
    query = stream.merge_status(stream.live_status(events, "1 hour"), f"{base}/table", f"{base}/log")
    query.awaitTermination()
    rows = stream.newest_status(spark.read.parquet(f"{base}/table")).collect()
    return {r.id: (r.expired, r.status, r.stage, r.done, r.total, r.percent, r.updated_at) for r in rows}, query


def test_one_batch(spark, tmp_path):
    write(spark, EVENTS, f"{tmp_path}/in")
    got, query = run(spark, f"{tmp_path}/in", tmp_path)
    assert got == WANT
    # the store holds open jobs only: expired ones have left
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3


@pytest.mark.parametrize("size", [1, 4])
def test_restarts_and_small_batches(spark, tmp_path, size):
    ordered = sorted(EVENTS, key=lambda e: (e[1], e[2]))
    cut = len(ordered) // 2
    for k in range(0, cut, size):
        write(spark, ordered[k : min(k + size, cut)], f"{tmp_path}/in")
    run(spark, f"{tmp_path}/in", tmp_path, per_trigger=1)
    for k in range(cut, len(ordered), size):
        write(spark, ordered[k : k + size], f"{tmp_path}/in")
    # a new query goes on from the checkpoint, with the state and the watermark it left
    got, query = run(spark, f"{tmp_path}/in", tmp_path, per_trigger=1)
    assert got == WANT
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3


def test_equals_the_batch_fold(spark, tmp_path):
    recent = [e for e in EVENTS if e[0] not in "de"]
    write(spark, recent, f"{tmp_path}/in")
    got, _ = run(spark, f"{tmp_path}/in", tmp_path)
    want = {r.id: (r.status, r.stage, r.done, r.total, r.percent, r.updated_at) for r in status.latest_status(spark.createDataFrame(recent, EVENT)).collect()}
    assert {k: v[1:] for k, v in got.items() if not v[0]} == {k: v for k, v in want.items() if k != "b"}


def test_nothing(spark, tmp_path):
    write(spark, [], f"{tmp_path}/in")
    schema = spark.createDataFrame([], EVENT).schema
    query = stream.merge_status(stream.live_status(stream.read_events(spark, f"{tmp_path}/in", schema)), f"{tmp_path}/table", f"{tmp_path}/log")
    query.awaitTermination()
    assert query.exception() is None
