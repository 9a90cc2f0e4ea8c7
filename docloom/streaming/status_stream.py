"""Job status on an unbounded event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from docloom.functions import fixed_values as V


def read_events(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet", per_trigger: int | None = None) -> DataFrame:
    """Parquet event files as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


_RECORD = "status string, stage string, message string, done long, total long, finished boolean, updated long"
_STATUS = "expired boolean, status string, stage string, message string, done long, total long, percent int, updated_at timestamp"


class Record:
    """One job's status while its events come in order; times are microseconds."""

    def __init__(self, status, stage, message, done, total, finished, updated):
        self.status, self.stage, self.message, self.updated = status, stage, message, updated
        self.done, self.total, self.finished = done, total, finished

    @classmethod
    def fresh(cls, at: int) -> Record:
        return cls("processando", "envio", None, 0, 0, False, at)

    def take(self, kind: str, stage, message, done, total, at: int) -> None:
        """An update overwrites what it carries, completion forces 100 %, an error keeps the progress reached."""
        self.updated, self.message = at, message
        if kind == "complete":
            self.status, self.stage, self.finished = "concluido", "concluido", True
        elif kind == "error":
            self.status, self.stage = "erro", "erro"
        else:
            self.stage = stage
            self.total = self.total if total is None else total
            if done is not None:
                self.done, self.finished = done, False

    def row(self) -> tuple:
        done = self.total if self.finished else self.done
        percent = 100 if self.finished else round(self.done / self.total * 100) if self.total else 0
        return False, self.status, self.stage, self.message, done, self.total, percent, self.updated

    def state(self) -> tuple:
        return self.status, self.stage, self.message, self.done, self.total, self.finished, self.updated


def _frame(key: tuple, values: tuple) -> pd.DataFrame:
    out = pd.DataFrame([(*key, *values)], columns=["id", "expired", "status", "stage", "message", "done", "total", "percent", "updated_at"])
    return out.assign(updated_at=pd.to_datetime(out["updated_at"], unit="us")).astype({"done": "Int64", "total": "Int64", "percent": "Int32"})


def _fold(ttl: int):
    """One job's part of a micro-batch, or its timer: at most one row, the state it ends in."""
    gone = lambda at: (True, None, None, None, None, None, None, at)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        record = Record(*state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield _frame(key, gone(record.updated))
            return
        events = pd.concat(list(frames), ignore_index=True).sort_values(["event_ts", "seq"], kind="stable")
        times = events["event_ts"].to_numpy("datetime64[us]").astype("int64").tolist()
        plain = events[["kind", "stage", "message", "done", "total"]].astype(object)
        plain = plain.where(plain.notna(), None)
        last = None
        for at, (kind, stage, message, done, total) in zip(times, plain.itertuples(index=False), strict=True):
            if record is not None and at - record.updated > ttl:
                last, record = record.updated, None
            if kind == "start":
                record = Record.fresh(at)
            elif record is not None:
                record.take(kind, stage, message, None if done is None else int(done), None if total is None else int(total), at)
        if record is not None and state.getCurrentWatermarkMs() >= (record.updated + ttl) // 1000:
            last, record = record.updated, None
        if record is not None:
            state.update(record.state())
            state.setTimeoutTimestamp((record.updated + ttl) // 1000)
            yield _frame(key, record.row())
        else:
            if state.exists:
                state.remove()
            if last is not None:
                yield _frame(key, gone(last))

    return run


def live_status(events: DataFrame, ttl: str = V.STATUS_TTL, delay: str = "10 minutes") -> DataFrame:
    """Status per job as events arrive, with expiry (update mode): id, expired, status, stage, message, done, total,
    percent, updated_at.

    ``id, event_ts (timestamp), seq, kind, stage, message, done, total`` in.  Each micro-batch tells the state of every
    job it touches.  A job's record is one small state row with an event-time timer; once the watermark is past
    ``ttl`` after its last event, the state is removed and one row with ``expired`` tells so, its other fields null.
    A gap of more than ``ttl`` between two events also ends a record, however events are dealt to micro-batches.
    As in the batch fold, events before a start, or after expiry and before a new start, have no effect.
    Events more than ``delay`` late are dropped; those inside a micro-batch are put in order.
    """
    return (
        events.withWatermark("event_ts", delay)
        .select("id", "event_ts", "seq", "kind", "stage", "message", F.col("done").cast("long"), F.col("total").cast("long"))
        .groupBy("id")
        .applyInPandasWithState(
            _fold(_micros(ttl)), f"id {dict(events.dtypes)['id']}, {_STATUS}", _RECORD, "update", GroupStateTimeout.EventTimeTimeout
        )
    )


def _micros(interval: str) -> int:
    """``1 hour`` -> microseconds."""
    return pd.Timedelta(interval) // pd.Timedelta(1, "us")


def newest_status(saved: DataFrame) -> DataFrame:
    """The last word on every job from the table that ``merge_status`` writes."""
    fields = [c for c in saved.columns if c not in ("id", "batch")]
    return saved.groupBy("id").agg(F.max_by(F.struct(*fields), "batch").alias("s")).select("id", "s.*")


def closed_sessions(events: DataFrame, ttl: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Jobs whose status expired: ``ttl`` without events, told once the watermark passes.

    Append mode.  State for a job is dropped with its session, so the store holds only
    live jobs.  ``id, event_ts (timestamp), kind, stage`` in; one row per session out.
    """
    return (
        events.withWatermark("event_ts", delay)
        .groupBy("id", F.session_window("event_ts", ttl).alias("session"))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.max(F.struct("event_ts", "kind", "stage")).alias("last"),  # ties by kind and stage
            F.max("event_ts").alias("updated_at"),
        )
        .select("id", "session.start", "session.end", "n_events", "last.kind", "last.stage", "updated_at")
    )


def start_table(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a Parquet table, exactly once per checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).outputMode("append").start()


def merge_status(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write each micro-batch of changed job states under its batch id.

    A replayed batch rewrites its own folder, so readers that take the newest row per
    job see the same table after a restart.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).outputMode("update").start()
