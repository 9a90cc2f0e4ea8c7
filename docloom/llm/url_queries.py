"""Query of the URL filters and its SQL twin.

The tables hold no list and no fetch times, so both are derived from ``pages``: every host, and every
host with its first path segment, gets three dated events drawn from the md5 of its key; page ids
give the fetch times of a year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import table
from docloom.llm.url_filter import host_of, judged, path_of

_START = "2024-01-01"


def captures_of(pages: DataFrame) -> DataFrame:
    hours = F.col("page_id") * 7919 % (365 * 24)
    start = F.unix_timestamp(F.lit(f"{_START} 00:00:00").cast("timestamp"))
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.timestamp_seconds(start + hours * 3600).alias("fetched"))


def events_of(pages: DataFrame) -> DataFrame:
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    keys = pages.select(F.explode(F.array(host, F.concat(host, F.regexp_extract(path, r"^(/[^/]*/?)", 1)))).alias("key"))
    digits = lambda at: F.conv(F.substring(F.md5(F.col("key").cast("binary")), at, 4), 16, 10).cast("int")
    events = [
        F.struct(
            F.date_add(F.lit(_START).cast("date"), (digits(1 + 8 * k) % 120 + 120 * k).cast("int")).alias("day"),
            F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("drop")), digits(5 + 8 * k) % 3 + 1).alias("action"),
        )
        for k in range(3)
    ]
    return keys.where("key is not null").distinct().select("key", F.explode(F.array(*events)).alias("e")).select("key", "e.day", "e.action")


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """All pages: the verdict on each capture and the list key that decided."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judged(captures_of(pages), events_of(pages)).withColumnRenamed("capture_id", "page_id")


QUERIES = {"op6_url_filter": op6_url_filter}

_DIGITS = "CAST('0x' || substr(md5(key), {at}, 4) AS INTEGER)"
_EVENTS = " UNION ALL ".join(
    f"SELECT key, DATE '{_START}' + ({_DIGITS.format(at=1 + 8 * k)} % 120 + {120 * k}) AS day, "
    f"['block', 'allow', 'drop'][{_DIGITS.format(at=5 + 8 * k)} % 3 + 1] AS action FROM keys"
    for k in range(3)
)

ORACLES = {
    "op6_url_filter": f"""
WITH parts AS (
  SELECT page_id, TIMESTAMP '{_START}' + to_hours(CAST(page_id * 7919 % (365 * 24) AS BIGINT)) AS fetched,
         nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '\\.+$', '')), '') AS host,
         coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path
  FROM pages
),
keys AS (
  SELECT DISTINCT key FROM (
    SELECT host AS key FROM parts UNION ALL SELECT host || regexp_extract(path, '^(/[^/]*/?)', 1) FROM parts)
  WHERE key IS NOT NULL
),
events AS MATERIALIZED ({_EVENTS}),
candidates AS (
  SELECT page_id, fetched, array_to_string(string_split(host, '.')[-k:], '.') AS key, k AS depth
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM parts WHERE host IS NOT NULL)
  UNION ALL
  SELECT page_id, fetched, host || array_to_string(pieces[1:k], ''), (k + 1) * 1000
  FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS k FROM (
    SELECT *, regexp_extract_all(path, '[^/]*/|[^/]+$') AS pieces FROM parts WHERE host IS NOT NULL))
),
active AS (
  SELECT c.page_id, c.key, c.depth, arg_max(e.action, e.day) AS action
  FROM candidates c JOIN events e ON c.key = e.key AND e.day <= c.fetched
  GROUP BY c.page_id, c.key, c.depth
),
best AS (
  SELECT page_id, arg_max(key, depth) AS key, arg_max(action, depth) AS action FROM active WHERE action <> 'drop' GROUP BY page_id
)
SELECT p.page_id, coalesce(b.action, 'pass') AS verdict, b.key FROM pages p LEFT JOIN best b ON p.page_id = b.page_id
""",
}
