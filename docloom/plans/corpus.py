"""Structured inputs that Spark derives from the given tables.

The given documents are plain prose.  ``manual_documents`` interleaves every line of
every document with the headings, lists and labels of a manual, so the structural
operators have structure to work on; no line is lost and the result grows with the table.
Each derivation has a SQL twin for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.lines import map_lines


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: a reader cannot cut a row group; writers make them about this large
ROW_GROUP_BYTES = 128 << 20
#: what one task gets of a table that is dealt out; later steps on the key keep this partitioning, so it bounds them too
PART_BYTES = 8 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def spread(frame: DataFrame, key: str = "doc_id") -> DataFrame:
    """Deal a table of fewer row groups than cores to all cores, in parts that do not grow with it.

    The bytes are those of the plan's own statistics, so nothing is listed or read.  Tables with enough row groups
    stay as they are: row-local work on them needs no exchange.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return frame.repartition(max(cores, -(-size // PART_BYTES)), key) if size < cores * ROW_GROUP_BYTES else frame


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Row-local line split: doc_id, line_no, line."""
    return map_lines(documents(spark, folder).select("doc_id", "text"))


LINES_SQL = """
lines AS (
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS line_no
    FROM documents)
)"""

# one entry per position in a cycle of twelve lines: what precedes the line, what leads it
_CYCLE = (
    (1, "{s}. OBJETIVO", ""), (2, None, ""), (3, "", ""), (4, None, "{s}.1 - "),
    (5, "COMO FAZER", ""), (6, None, "{s}.1.1.1 "), (7, "PORQUE FAZER", ""), (8, None, "- "),
    (9, None, "- "), (10, "Página 1 de 2", ""), (11, None, "Abrir "), (0, "INTERNA", ""),
)


def _spark_cycle() -> str:
    arms = []
    for k, before, lead in _CYCLE:
        fill = lambda t: "concat('" + t.replace("{s}", "', cast(s as string), '") + "')"
        own = f"concat({fill(lead)}, x)" if lead else "x"
        arms.append(f"when {k} then array({fill(before) + ', ' if before is not None else ''}{own})")
    return "case pmod(i + 1, 12) " + " ".join(arms) + " end"


def manual_documents(spark: SparkSession, folder: str) -> DataFrame:
    """documents -> (doc_id, doc_order, filename, text) with manual structure."""
    cycle = _spark_cycle().replace("cast(s as string)", "cast((i div 12) + 1 as string)")
    body = F.expr(f"array_join(flatten(transform(split(text, '\\n'), (x, i) -> {cycle})), '\\n')")
    return documents(spark, folder).select(
        "doc_id", F.col("doc_id").alias("doc_order"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        body.alias("text"),
    )


def _sql_cycle() -> str:
    arms = []
    for k, before, lead in _CYCLE:
        fill = lambda t: "concat('" + t.replace("{s}", "', (line_no - 1) // 12 + 1, '") + "')"
        own = f"concat({fill(lead)}, line)" if lead else "line"
        arms.append(f"WHEN {k} THEN [{fill(before) + ', ' if before is not None else ''}{own}]")
    return "CASE line_no % 12 " + " ".join(arms) + " END"


MANUAL_LINES_SQL = f"""{LINES_SQL},
manual_parts AS (
  SELECT doc_id, line_no, unnest(p) AS line, generate_subscripts(p, 1) AS part
  FROM (SELECT doc_id, line_no, {_sql_cycle()} AS p FROM lines)
),
manual_lines AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part) AS INTEGER) AS line_no, line
  FROM manual_parts
)"""


def manual_lines(spark: SparkSession, folder: str) -> DataFrame:
    return map_lines(manual_documents(spark, folder).select("doc_id", "text"))


def line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-empty line of the corpus as a block of its own."""
    return lines(spark, folder).where("line <> ''").select(
        "doc_id", F.col("line_no").alias("block_no"), F.col("line").alias("text")
    )


# order keys sort by code point on both sides
KEY_SQL = "trim(regexp_replace(upper(replace(strip_accents({0}), 'ß', 'SS')), '[ \\t]+', ' ', 'g'))"


def key_sql(expression: str) -> str:
    """SQL twin of ``match_key``."""
    return KEY_SQL.format(expression)
