"""Processing status: latest state per job from an event log, expiry, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V


def progress_percent(done: Column, total: Column) -> Column:
    """Rounded half to even; 0 without a total."""
    share = (done / F.nullif(total, F.lit(0))) * 100
    return F.coalesce(F.bround(share, 0), F.lit(0)).cast("int")


def latest_status(events: DataFrame) -> DataFrame:
    """Fold ``(id, event_ts, seq, kind, stage, message, done, total)`` to one row per id.

    Kinds: ``start`` resets the record, ``update`` overwrites the fields it carries,
    ``complete`` forces 100 %, ``error`` keeps the progress reached.  Events before the
    last start, or of ids never started, have no effect.

    Every field is its own ``max_by`` over a pair ordered by event time, so one partial
    aggregation per key does it: no window, no self join, and a job owning a third of
    the events costs its tasks nothing extra.
    """
    when = F.struct("event_ts", "seq")
    start, update = F.col("kind") == "start", F.col("kind") == "update"
    complete, error = F.col("kind") == "complete", F.col("kind") == "error"
    has_done, has_total = update & F.col("done").isNotNull(), update & F.col("total").isNotNull()

    def latest(value: Column, cond: Column) -> Column:
        return F.max(F.when(cond, F.struct(when.alias("at"), value.alias("v"))))

    agg = events.groupBy("id").agg(
        F.max(F.when(start, when)).alias("started"),
        latest(F.col("total"), start).alias("n_files"),
        latest(F.struct("stage", "message"), update).alias("upd"),
        latest(F.col("message"), complete).alias("fin"),
        latest(F.col("message"), error).alias("err"),
        latest(F.col("done"), has_done).alias("done"),
        latest(F.col("total"), has_total).alias("total"),
    )
    alive = agg.where(F.col("started").isNotNull())
    for name in ("upd", "fin", "err", "done", "total"):
        alive = alive.withColumn(name, F.when(F.col(name)["at"] > F.col("started"), F.col(name)))
    total = F.coalesce(F.col("total.v"), F.lit(0))
    fin_at, err_at, upd_at = F.col("fin.at"), F.col("err.at"), F.col("upd.at")
    done_after = F.col("done.at").isNotNull() & (fin_at.isNull() | (F.col("done.at") > fin_at))
    finished_last = fin_at.isNotNull() & ~done_after
    done = F.when(finished_last, total).otherwise(F.coalesce(F.col("done.v"), F.lit(0)))
    last_at = F.greatest(F.col("started"), upd_at, fin_at, err_at)
    status = (
        F.when(fin_at.isNull() & err_at.isNull(), F.lit("processando"))
        .when(err_at.isNull() | (fin_at > err_at), F.lit("concluido"))
        .otherwise(F.lit("erro"))
    )
    stage = (
        F.when(last_at == upd_at, F.col("upd.v.stage"))
        .when(last_at == fin_at, F.lit("concluido"))
        .when(last_at == err_at, F.lit("erro"))
        .otherwise(F.lit("envio"))
    )
    message = (
        F.when(last_at == upd_at, F.col("upd.v.message"))
        .when(last_at == fin_at, F.col("fin.v"))
        .when(last_at == err_at, F.col("err.v"))
    )
    return alive.select(
        "id", status.alias("status"), stage.alias("stage"), message.alias("message"),
        done.alias("done"), total.alias("total"),
        F.when(finished_last, F.lit(100)).otherwise(progress_percent(done, total)).alias("percent"),
        last_at["event_ts"].alias("updated_at"),
    )


def expire_status(status: DataFrame, now: Column, ttl: str = V.STATUS_TTL) -> DataFrame:
    """Drop records untouched for longer than the time to live."""
    return status.where(F.col("updated_at") >= now - F.expr(f"INTERVAL {ttl}"))
