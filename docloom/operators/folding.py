"""Order-dependent grouping inside a document.

Some group boundaries depend on a state that earlier boundaries reset (accumulated size,
the heading in force).  Windows cannot express that, so the rows of one document are
collected, folded with ``aggregate`` and cut with ``slice``.  A document is bounded by
the intake limit, the fold state is a few scalars, and only group starts are emitted.
Given input partitioned by ``doc_id`` nothing is exchanged and nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_document(
    frame: DataFrame,
    order: str,
    descriptors: dict[str, Column],
    initial: dict[str, Column],
    step: Callable[[Column, Column], tuple[Column, dict[str, Column]]],
    out: str,
    key: str = "doc_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``out``: the group number (from 1) of each row.

    ``step(state, descriptor)`` returns whether the row opens a group and the new state.
    The first row of a document always opens one.  ``keep`` names the columns to go on, all of
    them by default; others only serve the descriptors.
    """
    columns = [c for c in (frame.columns if keep is None else keep) if c != key]
    entry = F.struct(
        F.col(order).alias("_o"),
        F.struct(*[c.alias(n) for n, c in descriptors.items()]).alias("_d"),
        F.struct(*columns).alias("_r"),
    )
    gathered = frame.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("_rows"))
    start = F.struct(
        *[c.alias(n) for n, c in initial.items()],
        F.lit(0).alias("_pos"),
        F.expr("array()").cast("array<int>").alias("_starts"),
    )

    def merge(acc: Column, row: Column) -> Column:
        opens, state = step(acc, row["_d"])
        opens = opens | (acc["_pos"] == 0)
        return F.struct(
            *[state[n].alias(n) for n in initial],
            (acc["_pos"] + 1).alias("_pos"),
            F.when(opens, F.array_append(acc["_starts"], acc["_pos"] + 1)).otherwise(acc["_starts"]).alias("_starts"),
        )

    starts = gathered.withColumn("_starts", F.aggregate("_rows", start, merge, lambda a: a["_starts"]))
    groups = F.transform(
        F.col("_starts"),
        lambda s, i: F.slice(
            F.col("_rows"), s,
            F.coalesce(F.get(F.col("_starts"), i + 1), F.size("_rows") + 1) - s,
        ),
    )
    # the key column itself is passed on, so the partitioning on it stays known
    return (
        starts.select(key, F.posexplode(groups).alias("_g", "_members"))
        .select(key, "_g", F.explode("_members").alias("_m"))
        .select(key, *[F.col("_m._r")[c].alias(c) for c in columns], (F.col("_g") + 1).alias(out))
    )
