"""Page layout assembly: text outside tables plus serialised tables, by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V


def layout_assemble(spans: DataFrame, boxes: DataFrame, cell: float = 128.0) -> DataFrame:
    """Text spans whose centre lies in a table box give way to the table's own text.

    ``spans(doc_id, page, x0, y0, x1, y1, text)``, ``boxes(doc_id, page, box_id, x0, y0,
    x1, y1, text)``.  Boxes under 40 units tall are not tables.  The containment test is
    an equi join on (document, page, vertical grid row) with the exact test as residue,
    so a page with many spans and boxes spreads over several keys and no two sets are
    paired whole.  A span has one grid row; a box is listed in each row it crosses.

    Returns ``(doc_id, page, y, x, text)``; order by ``y`` then ``x`` to read a page.
    """
    tall = boxes.where(F.col("y1") - F.col("y0") >= V.MIN_TABLE_HEIGHT)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    placed = spans.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(
        "*", cx.alias("_cx"), cy.alias("_cy"), F.floor(cy / cell).cast("int").alias("_row")
    )
    grid = tall.select(
        F.col("doc_id"), F.col("page"),
        F.col("x0").alias("bx0"), F.col("x1").alias("bx1"),
        F.col("y0").alias("by0"), F.col("y1").alias("by1"),
        F.explode(
            F.sequence(F.floor(F.col("y0") / cell).cast("int"), F.floor(F.col("y1") / cell).cast("int"))
        ).alias("_row"),
    )
    s, g = placed.alias("s"), grid.alias("g")
    outside = s.join(
        g,
        (F.col("s.doc_id") == F.col("g.doc_id"))
        & (F.col("s.page") == F.col("g.page"))
        & (F.col("s._row") == F.col("g._row"))
        & F.col("s._cx").between(F.col("g.bx0"), F.col("g.bx1"))
        & F.col("s._cy").between(F.col("g.by0"), F.col("g.by1")),
        "left_anti",
    ).select("doc_id", "page", F.col("y0").alias("y"), F.col("x0").alias("x"), F.trim("text").alias("text"))
    tables = tall.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(
        "doc_id", "page", F.col("y0").alias("y"), F.col("x0").alias("x"), "text"
    )
    return outside.unionByName(tables)


def page_text(layout: DataFrame) -> DataFrame:
    """Reading-order text per page.  A page is bounded by the size of its document."""
    ordered = F.sort_array(F.collect_list(F.struct("y", "x", "text")))
    return layout.groupBy("doc_id", "page").agg(
        F.array_join(F.transform(ordered, lambda e: e["text"]), "\n\n").alias("text")
    )
