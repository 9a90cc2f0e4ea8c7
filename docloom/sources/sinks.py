"""Sinks: matrix CSV, typed-line CSV, spreadsheet projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V
from docloom.functions import text as T

BOM = "\ufeff"


def _id_text() -> Column:
    return F.coalesce(F.col("row_id").cast("string"), F.lit(""))


def matrix_csv_projection(rows: DataFrame) -> DataFrame:
    cells = ("item", "description", "task_type", None, "hta", "task_text")
    return rows.select(
        *[
            (_id_text() if source is None else T.cell_text(F.col(source))).alias(name)
            for source, name in zip(cells, V.MATRIX_CSV_COLUMNS)
        ]
    )


def matrix_sheet_projection(rows: DataFrame) -> DataFrame:
    """Spreadsheet layout: same cells, hierarchy number first, other headings."""
    cells = ("hta", "item", "description", "task_type", None, "task_text")
    return rows.select(
        *[
            (_id_text() if source is None else T.cell_text(F.col(source))).alias(name)
            for source, name in zip(cells, V.MATRIX_SHEET_COLUMNS)
        ]
    )


def _with_bom(frame: DataFrame) -> DataFrame:
    first = frame.columns[0]
    return frame.withColumnRenamed(first, BOM + first)


def write_matrix_csv(
    rows: DataFrame,
    path: str,
    order: tuple[str, ...] = ("doc_order", "block_no", "row_no"),
    single_file: bool = False,
    mode: str = "errorifexists",
) -> None:
    """Semicolon CSV with header and byte-order mark, cells tidied, breaks kept.

    Rows are range-partitioned and sorted by output order, so part files read in name
    order are the whole matrix in order; every part carries the header.  ``single_file``
    funnels everything through one task and is meant for small results only.
    """
    ordered = rows.orderBy(*order)
    out = _with_bom(matrix_csv_projection(ordered))
    if single_file:
        out = _with_bom(matrix_csv_projection(rows.coalesce(1).sortWithinPartitions(*order)))
    _csv(out, ";", path, mode)


def write_block_csv(typed_lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Comma CSV of typed lines in document order."""
    cells = (
        "doc_order", "filename", "document_type", "block_order", "block_type", "section",
        "hierarchy", "content",
    )
    ordered = typed_lines.orderBy("doc_order", "block_order")
    out = ordered.select(*[F.col(c).alias(n) for c, n in zip(cells, V.BLOCK_CSV_COLUMNS)])
    _csv(_with_bom(out), ",", path, mode)


def _csv(frame: DataFrame, separator: str, path: str, mode: str) -> None:
    (
        frame.write.mode(mode)
        .option("header", True)
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("lineSep", "\n")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
