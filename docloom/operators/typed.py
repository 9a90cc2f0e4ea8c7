"""Typed lines: document type and per-type line classification (windows only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V
from docloom.functions import text as T
from docloom.operators.lines import by_document

# ordered (label, pattern): the first match in the head of the text wins
TYPE_RULES = (
    (V.DOC_ANNEX_A, T.ci(r"\bANEXO\s+A\b")),
    (V.DOC_ANNEX_B, T.ci(r"\bANEXO\s+B\b")),
    (V.DOC_PE, r"(?imUd)" + V.PE_SECTION),
)

TYPED_COLUMNS = (
    "doc_id", "doc_order", "filename", "document_type", "block_order", "block_type",
    "content", "section", "hierarchy", "needs_ai",
)


def document_type(documents: DataFrame, rules=TYPE_RULES, default: str = V.DOC_UNKNOWN) -> DataFrame:
    """First matching rule over the whole text.

    Headings already marked ``## `` and headings below the first line also count, so a
    document types the same before and after heading markup.
    """
    branch = F.when(F.lit(False), F.lit(""))
    for label, pattern in rules:
        branch = branch.when(F.col("text").rlike(pattern), F.lit(label))
    return documents.withColumn("document_type", branch.otherwise(F.lit(default)))


def markdown_lines(typed_documents: DataFrame, exchange: bool = True) -> DataFrame:
    """Non-empty tidy lines without heading marks; ``line_no`` counts only these."""
    source = by_document(typed_documents) if exchange else typed_documents
    tidy = source.withColumn(
        "_lines",
        F.filter(
            F.transform(
                T.split_lines(F.col("text")),
                lambda x: T.strip(F.regexp_replace(T.normalize_ws(x), "^## ", "")),
            ),
            lambda x: x != "",
        ),
    )
    keep = [c for c in typed_documents.columns if c != "text"]
    return tidy.select(*keep, F.posexplode("_lines").alias("_p", "line")).select(
        *keep, (F.col("_p") + 1).cast("int").alias("line_no"), "line"
    )


def _finish(frame: DataFrame) -> DataFrame:
    return frame.select(*[c for c in TYPED_COLUMNS if c in frame.columns])


def classify_sectioned(lines: DataFrame) -> DataFrame:
    """Section headings open a section and clear the mode; how/why marker lines set the
    mode and disappear; the rest takes the mode, else information."""
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    heading, key = F.col("_heading"), F.col("_key")
    how, why = F.contains(key, F.lit("COMO FAZER")), F.contains(key, F.lit("PORQUE FAZER"))
    event = (
        F.when(heading, F.lit(V.L_INFO)).when(how, F.lit(V.L_EXEC)).when(why, F.lit(V.L_INFO))
    )
    told = lines.select("*", F.col("line").rlike(T.ci(V.PE_SECTION)).alias("_heading"), T.match_key(F.col("line")).alias("_key"))
    marked = told.select(
        "*", (~heading & (how | why)).alias("_marker"),
        event.alias("_event"), F.when(heading, F.col("line")).alias("_section"),
    )
    carried = marked.select(
        "*",
        F.coalesce(F.last("_section", True).over(upto), F.lit("")).alias("section"),
        F.coalesce(F.last("_event", True).over(upto), F.lit(V.L_INFO)).alias("_mode"),
    ).where(~F.col("_marker") & (F.col("_heading") | (F.length("line") >= 3)))
    out = carried.select(
        "*",
        F.row_number().over(doc).alias("block_order"),
        F.when(F.col("_heading"), F.lit(V.L_TITLE)).otherwise(F.col("_mode")).alias("block_type"),
        F.col("line").alias("content"),
        F.lit("").alias("hierarchy"),
        (
            ~F.col("_heading")
            & (F.col("section") == "")
            & (F.length("line") > V.AMBIGUOUS_SECTIONLESS_CHARS)
        ).alias("needs_ai"),
    )
    return _finish(out)


def classify_outline(lines: DataFrame) -> DataFrame:
    """Numbered lines by depth, notices as information, the rest as execution."""
    number = T.outline_number(F.col("line"))
    notice = T.match_key(F.col("line")).rlike("^(?:" + "|".join(V.NOTICE_PREFIXES) + ")")
    level = T.outline_level(F.col("hierarchy"))
    out = (
        lines.withColumn("hierarchy", number)
        .withColumn("section", F.lit(""))
        .withColumn("block_order", F.col("line_no"))
        .withColumn(
            "block_type",
            F.when(notice, F.lit(V.L_INFO))
            .when(F.col("hierarchy") == "", F.lit(V.L_EXEC))
            .when(level <= 2, F.lit(V.L_TITLE))
            .when(level == 3, F.lit(V.L_SUBTITLE))
            .otherwise(F.lit(V.L_EXEC)),
        )
        .withColumn(
            "content",
            F.when(F.col("hierarchy") == "", F.col("line")).otherwise(T.outline_rest(F.col("line"))),
        )
        .withColumn("needs_ai", (F.col("hierarchy") == "") & (F.length("content") > V.AMBIGUOUS_CHARS))
    )
    return _finish(out)


def classify_flat(lines: DataFrame, flag_long: Column | None = None) -> DataFrame:
    """Everything is information; ``block_order`` keeps the line index, gaps included."""
    long_line = F.length("line") > V.AMBIGUOUS_CHARS
    out = (
        lines.where(F.length("line") >= 3)
        .withColumn("block_order", F.col("line_no"))
        .withColumn("block_type", F.lit(V.L_INFO))
        .withColumn("content", F.col("line"))
        .withColumn("section", F.lit(""))
        .withColumn("hierarchy", F.lit(""))
        .withColumn("needs_ai", F.lit(False) if flag_long is None else flag_long & long_line)
    )
    return _finish(out)


def classify_documents(documents: DataFrame, rules=TYPE_RULES) -> DataFrame:
    """Type each document, then classify its lines by the rules of that type.

    Only sectioned documents need windows; the other branches stay row-local and are
    never shuffled.
    """
    typed = document_type(documents, rules)
    sectioned = typed.where(F.col("document_type") == V.DOC_PE)
    outline = typed.where(F.col("document_type") == V.DOC_ANNEX_B)
    flat = typed.where(~F.col("document_type").isin(V.DOC_PE, V.DOC_ANNEX_B))
    is_generic = F.col("document_type") != V.DOC_ANNEX_A
    return (
        classify_sectioned(markdown_lines(sectioned))
        .unionByName(classify_outline(markdown_lines(outline, exchange=False)))
        .unionByName(classify_flat(markdown_lines(flat, exchange=False), is_generic))
    )


def apply_label_overrides(typed_lines: DataFrame, labels: DataFrame) -> DataFrame:
    """External labels ``(doc_id, position, label)`` replace ambiguous lines' types.

    ``position`` is the 0-based rank of the line among its document's ambiguous lines;
    labels outside the allowed set are ignored.  Only ambiguous lines reach the join.
    """
    rank = Window.partitionBy("doc_id").orderBy("block_order")
    unsure = typed_lines.where("needs_ai").withColumn("position", F.row_number().over(rank) - 1)
    valid = labels.where(F.col("label").isin(*V.LINE_TYPES)).groupBy("doc_id", "position").agg(
        F.max("label").alias("label")
    )
    fixed = (
        unsure.join(valid, ["doc_id", "position"], "left")
        .withColumn("block_type", F.coalesce("label", "block_type"))
        .select(*typed_lines.columns)
    )
    return typed_lines.where(~F.col("needs_ai")).unionByName(fixed)


