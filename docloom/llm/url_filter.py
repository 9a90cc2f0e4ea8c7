"""URL filters: dated list entries, as-of joined to captures; DataFrame functions only.

A list is a log of dated events: (key, action, day), where ``key`` is a host ("example.com", which also
covers its subdomains) or a host and path prefix ("example.com/ads/"), and ``action`` is ``block``,
``allow`` or ``drop`` (the key leaves the list).  An event holds until the key's next one, so each
becomes a validity interval.  A capture (id, url, fetch time) is judged by the entries active when
it was fetched: of the keys that match its URL the most specific active one decides - a longer host
over a shorter one, any path prefix over its bare host, the longer prefix over the shorter.  With
none active the capture passes.

The join is an equi join.  An interval is written once for each period (``PERIOD_DAYS``) that it
touches, and a capture has one row per candidate key - its host suffixes and, on its full host,
its path prefixes - each with the period of its fetch.  So captures meet only intervals of their key
and period, however long a key's history is, and a host with a third of all captures is an
ordinary join key whose partition Spark may split (both sides are plain exchanges).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD_DAYS = 32
#: An entry that is still active ends here (exclusive).
OPEN_END = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null where there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    host = F.lower(F.regexp_replace(authority, r"\.+$", ""))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path without query and fragment, at least "/"."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def candidate_keys(url: Column) -> Column:
    """Structs (key, depth): all keys that match a URL; the greater depth decides.

    Depth is the number of host labels for hosts, and the full host's plus the prefix's number
    of segments, times 1000, for path prefixes (so any prefix beats any host).
    """
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.struct(
            F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".").alias("key"), k.cast("long").alias("depth")
        ),
    )
    # "/a/b/c.html" -> "/a/", "/a/b/", "/a/b/c.html"
    parts = F.filter(F.split(path, r"(?<=/)"), lambda x: x != "")
    paths = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda k: F.struct(
            F.concat(host, F.array_join(F.slice(parts, F.lit(1), k), "")).alias("key"), ((k + 1) * 1000).cast("long").alias("depth")
        ),
    )
    return F.when(host.isNull(), F.array().cast("array<struct<key:string,depth:bigint>>")).otherwise(F.concat(hosts, paths))


def _period(time: Column) -> Column:
    return F.floor(F.unix_timestamp(time) / (86400 * PERIOD_DAYS))


def validity_intervals(events: DataFrame) -> DataFrame:
    """(key, action, starts, ends): each event until the key's next; ``drop`` events only end others.

    Of events of one key at one time the strictest counts: block, then allow, then drop.  Events
    with a null key, action or day are ignored.
    """
    ranked = events.where("key is not null and action in ('block', 'allow', 'drop') and day is not null").groupBy(
        "key", F.col("day").cast("timestamp").alias("starts")
    ).agg(F.max(F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)).alias("rank"))
    following = Window.partitionBy("key").orderBy("starts")
    return (
        ranked.withColumn("ends", F.coalesce(F.lead("starts").over(following), F.lit(OPEN_END).cast("timestamp")))
        .where("rank > 0")
        .select("key", F.when(F.col("rank") == 2, "block").otherwise("allow").alias("action"), "starts", "ends")
    )


def judged(captures: DataFrame, events: DataFrame) -> DataFrame:
    """capture_id, verdict (block, allow or pass), key (that decided, else null): one row per id.

    ``captures`` is (capture_id, url, fetched timestamp).

    Nulls and edges: a null url, one without a host, or a null fetch time passes. Rows that repeat
    an id are judged together: the deepest entry of any of them decides, ties to block. A null id
    is one more id. Periods before the first capture or after the last hold no rows of intervals.
    """
    asked = captures.select(
        "capture_id", "fetched", F.explode_outer(candidate_keys(F.col("url"))).alias("c")
    ).select("capture_id", "fetched", F.col("c.key").alias("key"), F.col("c.depth").alias("depth"), _period(F.col("fetched")).alias("period"))
    # intervals are cut to the span of the captures, so an open end makes no endless rows
    first, last = captures.agg(F.min(F.unix_timestamp("fetched")), F.max(F.unix_timestamp("fetched"))).first()
    low, high = F.timestamp_seconds(F.lit(first or 0)), F.timestamp_seconds(F.lit((last or 0) + 1))
    intervals = validity_intervals(events).where((F.col("starts") <= high) & (F.col("ends") > low)).select(
        F.col("key").alias("listed"), "action", "starts", "ends",
        F.explode(
            F.sequence(_period(F.greatest("starts", low)), _period(F.least("ends", high)))
        ).alias("listed_period"),
    )
    met = asked.join(
        intervals,
        (F.col("key") == F.col("listed")) & (F.col("period") == F.col("listed_period"))
        & (F.col("fetched") >= F.col("starts")) & (F.col("fetched") < F.col("ends")),
        "left",
    )
    best = F.max(
        F.when(F.col("action").isNotNull(), F.struct("depth", (F.col("action") == "block").alias("strict"), "key", "action"))
    )
    return met.groupBy("capture_id").agg(best.alias("best")).select(
        "capture_id", F.coalesce("best.action", F.lit("pass")).alias("verdict"), F.col("best.key").alias("key")
    )


def passing(captures: DataFrame, events: DataFrame) -> DataFrame:
    """The captures that are not blocked, all columns kept."""
    blocked = judged(captures, events).where("verdict = 'block'").select(F.col("capture_id").alias("_blocked_id"))
    return captures.join(blocked, F.col("capture_id").eqNullSafe(F.col("_blocked_id")), "left_anti")
