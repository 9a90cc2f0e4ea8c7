"""Table cells to text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V
from docloom.functions import text as T


def table_rows_to_lines(cells: DataFrame, table: str = "table_id", row: str = "row_no") -> DataFrame:
    """``(table, row, cell_no, cell)`` to one ``• a | b`` line per row with any content."""
    filled = cells.withColumn("cell", T.squeeze(T.text_or_empty(F.col("cell")))).where("cell <> ''")
    ordered = F.sort_array(F.collect_list(F.struct("cell_no", "cell")))
    return filled.groupBy(table, row).agg(
        F.concat(F.lit("• "), F.array_join(F.transform(ordered, lambda c: c["cell"]), " | ")).alias("line")
    )


def step_table_fold(cells: DataFrame) -> DataFrame:
    """Procedure tables to ``PASSO n | text`` lines; other tables to bullet lines.

    ``cells(table_id, row_no, cell_no, cell)`` with ``cell_no`` from 1 and every cell of
    the grid present.  A table is a procedure when a header names what to do and a
    description, when a numeric first cell is followed by an action verb, or when a
    three-column row opens with an activity or a how/why label.  In those tables headers
    go, rows without a first cell continue the step above, a text row just above a bare
    step number belongs to that step, activities keep only their first cell, and a
    how/why cell is cut in two.

    Returns ``(table_id, row_no, part_no, line, operational)``.
    """
    raw = T.text_or_empty(F.col("cell"))
    grid = cells.groupBy("table_id", "row_no").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("cell_no", raw.alias("cell")))), lambda c: c["cell"]
        ).alias("raw")
    )
    first, second = F.get("raw", F.lit(0)), F.get("raw", F.lit(1))
    has = lambda term: F.exists("raw", lambda c: F.contains(T.match_key(c), F.lit(term)))
    shape = (
        ((has("O QUE FAZER") | has("PASSO")) & has("DESCRICAO"))
        | (
            (F.size("raw") >= 2)
            & T.strip(first).rlike(T.cs(r"^\d+$"))
            & T.strip(second).rlike(T.ci(V.ACTION_START))
        )
        | (
            (F.size("raw") == 3)
            & (first != "")
            & (
                first.rlike(T.cs(V.TABLE_ACTIVITY))
                | T.match_key(first).rlike("^(?:COMO FAZER|PORQUE FAZER)")
            )
        )
    )
    whole = Window.partitionBy("table_id")
    rows = Window.partitionBy("table_id").orderBy("row_no")
    flagged = grid.select("*", shape.alias("_shape")).select(
        "*",
        F.max("_shape").over(whole).alias("operational"),
        F.count(F.lit(1)).over(whole).alias("_n_rows"),
    )
    keeps_breaks = F.col("operational") | (
        (F.col("_n_rows") == 1) & F.exists("raw", lambda c: c.rlike(r"(?Udm)" + V.LIST_ITEM))
    )
    tidy = F.when(
        keeps_breaks,
        F.transform("raw", lambda c: T.join_visual_lines(T.split_lines(c))),
    ).otherwise(F.transform("raw", T.squeeze))
    table = flagged.select("table_id", "row_no", "operational", tidy.alias("cells"))
    # neighbours are grid neighbours, so an all-empty row still separates
    a, b = F.get("cells", F.lit(0)), F.coalesce(F.get("cells", F.lit(1)), F.lit(""))
    ahead = table.select(
        "*",
        a.alias("a"), b.alias("b"), T.match_key(a).alias("key"),
        F.lead("cells").over(rows).alias("_next"),
    )
    digits = T.cs(r"^\d+$")
    next_a = F.get("_next", F.lit(0))
    next_b = F.coalesce(F.get("_next", F.lit(1)), F.lit(""))
    wide = F.col("operational") & (F.size("cells") >= 2)
    empty = F.size(F.filter("cells", lambda c: c != "")) == 0
    kind = (
        F.when(empty, F.lit("empty"))
        .when(wide & F.contains("key", F.lit("O QUE FAZER")), F.lit("banner"))
        .when(
            wide & (F.col("key") == "PASSO")
            & F.exists("cells", lambda c: F.contains(T.match_key(c), F.lit("DESCRICAO"))),
            F.lit("header"),
        )
        .when(
            wide & (F.col("a") == "") & (F.col("b") != "")
            & next_a.rlike(digits) & (next_b == ""),
            F.lit("ahead"),
        )
    )
    kinds = ahead.select("*", kind.alias("_k0"))
    # the text waiting for a bare step number: the latest "ahead" row not yet consumed
    upto = rows.rowsBetween(Window.unboundedPreceding, -1)
    numeric = F.col("_k0").isNull() & wide & F.col("a").rlike(digits)
    waiting = F.last(
        F.when(F.col("_k0") == "ahead", F.col("b")).when(numeric, F.lit("")), ignorenulls=True
    ).over(upto)
    waited = kinds.select("*", F.coalesce(waiting, F.lit("")).alias("_waiting"))
    is_step = numeric & ((F.col("b") != "") | (F.col("_waiting") != ""))
    step_text = F.when(F.col("b") != "", F.col("b")).otherwise(F.col("_waiting"))
    second_kind = (
        F.when(F.col("_k0").isNotNull(), F.col("_k0"))
        .when(is_step, F.lit("step"))
        .when(wide & (F.col("a") == "") & (F.col("b") != ""), F.lit("tail"))
        .when(
            wide & F.col("a").rlike(T.cs(V.TABLE_ACTIVITY))
            & (F.size(F.filter("cells", lambda c, i: (i > 0) & (c != ""))) > 0),
            F.lit("activity"),
        )
        .when(wide & F.col("key").startswith("COMO FAZER"), F.lit("how"))
        .otherwise(F.lit("bullet"))
    )
    shown = waited.select("*", second_kind.alias("kind")).where(~F.col("kind").isin("empty", "header", "ahead"))
    bullet = F.concat(F.lit("• "), F.array_join(F.filter("cells", lambda c: c != ""), " | "))
    own = (
        F.when(F.col("kind") == "step", F.concat(F.lit("PASSO "), F.col("a"), F.lit(" | "), step_text))
        .when(F.col("kind") == "banner", F.lit("O QUE FAZER EXECUTANTE ONDE REGISTRAR"))
        .when(F.col("kind") == "activity", F.col("a"))
        .when(F.col("kind") == "how", F.col("a"))
        .otherwise(bullet)
    )
    # a tail row continues the line above only when that line is a step
    leader = F.when(F.col("kind") != "tail", F.col("kind"))
    lines = shown.select("*", own.alias("own")).select(
        "*", F.last(leader, True).over(rows.rowsBetween(Window.unboundedPreceding, 0)).alias("_lead")
    )
    glued = F.coalesce((F.col("kind") == "tail") & (F.col("_lead") == "step"), F.lit(False))
    islands = lines.select(
        "*", glued.alias("_glued"), F.sum((~glued).cast("int")).over(rows).alias("_island")
    )
    merged = islands.groupBy("table_id", "_island").agg(
        F.min("row_no").alias("row_no"),
        F.max("operational").alias("operational"),
        F.min_by("kind", "row_no").alias("kind"),
        F.array_join(
            F.transform(
                F.sort_array(
                    F.collect_list(
                        F.struct("row_no", F.when(F.col("_glued"), F.col("b")).otherwise(F.col("own")).alias("t"))
                    )
                ),
                lambda e: e["t"],
            ),
            " ",
        ).alias("line"),
    )
    parts = F.when(
        F.col("kind") == "how",
        F.filter(
            F.transform(F.split("line", T.ci(r"(?=PORQUE\s+FAZER\s*:)"), 2), T.strip), lambda x: x != ""
        ),
    ).otherwise(F.array("line"))
    return merged.select(
        "table_id", "row_no", "operational", F.posexplode(parts).alias("part_no", "line")
    )
