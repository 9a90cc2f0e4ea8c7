"""Query of the line dedup and its SQL twin (all pairs of close length, plain edit distance)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import table
from docloom.llm.line_dedup import PER_EDIT, TAU, line_classes


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of all documents: where their class starts, their links, whether they stay."""
    return line_classes(table(spark, folder, "documents"))


# DuckDB's distance counts bytes: letters of two bytes are first written as one
_WIDE = "ÄÇÈÉÊÍÑÓÖÜßáâäçèéêíîñóöúüàôû"
_NARROW = " || ".join(f"chr({code})" for code in (*range(1, 9), *range(14, 28), *range(28, 32), 127, 96))
_PLAIN = f"translate(line, '{_WIDE}', {_NARROW})"

ORACLES = {
    "op1_line_dedup": rf"""
WITH lines AS MATERIALIZED (
  SELECT doc_id, line_no, line, length(line) AS n, regexp_matches(line, '[^ \t\n\x0B\f\r]') AS counts FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS line_no
    FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
),
texts AS MATERIALIZED (
  SELECT line, any_value(n) AS n, any_value({_PLAIN}) AS plain, arg_min(doc_id, (doc_id, line_no)) AS doc_id,
         arg_min(line_no, (doc_id, line_no)) AS line_no
  FROM lines WHERE counts GROUP BY line
),
pairs AS MATERIALIZED (
  SELECT a.line AS la, b.line AS lb, a.doc_id AS da, a.line_no AS na, b.doc_id AS db, b.line_no AS nb
  FROM texts a JOIN (SELECT *, unnest(range(n - {TAU}, n + {TAU + 1})) AS near FROM texts) b
    ON a.n = b.near AND a.line < b.line
  WHERE least(a.n, b.n) >= {PER_EDIT} AND levenshtein(a.plain, b.plain) <= least({TAU}, least(a.n, b.n) // {PER_EDIT})
),
ends AS (
  SELECT la AS line, db AS doc_id, nb AS line_no FROM pairs UNION ALL SELECT lb, da, na FROM pairs
),
classes AS (
  SELECT t.line, least((t.doc_id, t.line_no), coalesce(min((e.doc_id, e.line_no)), (t.doc_id, t.line_no))) AS first,
         count(e.line) AS n_links
  FROM texts t LEFT JOIN ends e ON t.line = e.line GROUP BY t.line, t.doc_id, t.line_no
)
SELECT l.doc_id, CAST(l.line_no AS INTEGER) AS line_no, coalesce(c.first[1], l.doc_id) AS first_doc_id,
       CAST(coalesce(c.first[2], l.line_no) AS INTEGER) AS first_line_no, coalesce(c.n_links, 0) AS n_links,
       c.first IS NULL OR (c.first[1] = l.doc_id AND c.first[2] = l.line_no) AS kept
FROM lines l LEFT JOIN classes c ON l.counts AND l.line = c.line
""",
}

QUERIES = {"op1_line_dedup": op1_line_dedup}
