"""Queries over the given tables: output, status, rules, batches, reconciliation, numbering."""

from __future__ import annotations

import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import actions as A
from docloom.functions import fixed_values as V
from docloom.functions import text as T
from docloom.operators import batching as P
from docloom.operators import hierarchy as H
from docloom.operators import lines as L
from docloom.operators import output as O
from docloom.operators import reconcile as M
from docloom.operators import rowgen as X
from docloom.operators import rules as R
from docloom.operators import status as G
from docloom.plans import matrix as plan
from docloom.plans.corpus import LINES_SQL, documents, key_sql, line_blocks, lines, table
from docloom.sources import rulebook, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- output ------------------------------------------------------------------------
# every line of the corpus is a matrix row; type and item follow from its number

_TYPE_SQL = """CASE line_no % 5 WHEN 0 THEN 'Padrão/Anexo' WHEN 1 THEN 'Título/Subtítulo' WHEN 2 THEN 'Ignorar'
               WHEN 3 THEN 'Outro' ELSE 'Execução' END"""
_ROWS_SQL = f"""{LINES_SQL},
    raw AS (SELECT doc_id, doc_id AS doc_order, line_no AS block_no, 1 AS row_no,
                   CASE WHEN line_no % 10 = 0 THEN ' P ' ELSE '' END AS item,
                   CASE WHEN line_no % 15 = 0 THEN '  ' ELSE line END AS description,
                   {_TYPE_SQL} AS task_type, '' AS hta, line AS task_text FROM lines),
    tidy AS (SELECT doc_id, doc_order, block_no, row_no, trim(item) AS item, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS description,
                    CASE WHEN task_type = 'Outro' THEN 'Informação' ELSE task_type END AS task_type, hta,
                    trim(regexp_replace(task_text, '\\s+', ' ', 'g')) AS task_text
             FROM raw WHERE task_type <> 'Ignorar'),
    normal AS (SELECT * FROM tidy WHERE description <> '' OR (task_type = 'Padrão/Anexo' AND item <> '')),
    firsts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item, description, task_type, hta, task_text ORDER BY block_no, row_no) AS rn FROM normal) WHERE rn = 1),
    numbered AS (SELECT *, CASE WHEN task_type <> 'Padrão/Anexo' THEN
                   sum(CASE WHEN task_type <> 'Padrão/Anexo' THEN 1 ELSE 0 END) OVER (ORDER BY doc_order, block_no, row_no ROWS UNBOUNDED PRECEDING) END AS row_id FROM firsts)"""


def raw_rows(spark, sf):
    n = F.col("line_no")
    k = n % 5
    return lines(spark, sf).select(
        "doc_id", F.col("doc_id").alias("doc_order"), n.alias("block_no"), F.lit(1).alias("row_no"),
        F.when(n % 10 == 0, " P ").otherwise("").alias("item"),
        F.when(n % 15 == 0, "  ").otherwise(F.col("line")).alias("description"),
        F.when(k == 0, V.T_ANNEX).when(k == 1, V.T_TITLE).when(k == 2, V.T_IGNORE).when(k == 3, "Outro")
        .otherwise(V.T_EXEC).alias("task_type"),
        F.lit("").alias("hta"), F.col("line").alias("task_text"),
    )


@query("normalize_rows", f"WITH {_ROWS_SQL} SELECT * FROM normal")
def normalize_rows(spark, sf):
    return O.normalize_rows(raw_rows(spark, sf))


@query("dedupe_keep_first", f"WITH {_ROWS_SQL} SELECT * FROM firsts")
def dedupe_keep_first(spark, sf):
    return O.dedupe_keep_first(O.normalize_rows(raw_rows(spark, sf)))


@query("assign_row_ids", f"WITH {_ROWS_SQL} SELECT doc_id, block_no, row_no, CAST(row_id AS BIGINT) AS row_id FROM numbered")
def assign_row_ids(spark, sf):
    unique = O.dedupe_keep_first(O.normalize_rows(raw_rows(spark, sf)))
    # ids need no texts, so none are written
    narrow = unique.select("doc_id", "doc_order", *O.POSITION, "task_type")
    return O.assign_row_ids(narrow).select("doc_id", "block_no", "row_no", "row_id")


_SUBMITTED_SQL = """
    WITH stats AS (
      SELECT o_custkey AS submission_id, o_orderkey AS doc_id, o_orderkey % 5 AS doc_order, o_orderkey % 4 AS n,
             o_orderkey % 3 * (o_orderkey % 50) AS r, CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey % 1000 ELSE 0 END AS a,
             o_orderkey % 2 AS x FROM orders)"""


def submitted(spark, sf):
    """Orders as documents of their customer's submission; order values repeat."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("submission_id"), k.alias("doc_id"), (k % 5).alias("doc_order"), (k % 4).alias("n"),
        (k % 3 * (k % 50)).alias("r"), F.when(k % 97 == 0, k % 1000).otherwise(0).alias("a"), (k % 2).alias("x"),
    )


@query(
    "submission_offset",
    f"""{_SUBMITTED_SQL},
    p AS (SELECT *, sum(greatest(n, x)) OVER w AS big_n, greatest(a, CASE WHEN n > 0 THEN r + n ELSE 0 END) AS c FROM stats
          WINDOW w AS (PARTITION BY submission_id ORDER BY doc_order, doc_id ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT *, big_n + greatest(0, max(c - big_n) OVER (
            PARTITION BY submission_id ORDER BY doc_order, doc_id ROWS UNBOUNDED PRECEDING)) AS peak FROM p)
    SELECT submission_id, doc_id,
           CAST(coalesce(lag(peak) OVER (PARTITION BY submission_id ORDER BY doc_order, doc_id), 0) + 1 AS BIGINT) AS root FROM m""",
)
def submission_offset(spark, sf):
    return H.cross_document_offset(submitted(spark, sf), ("submission_id",)).select("submission_id", "doc_id", "root")


@query(
    "submission_row_ids",
    f"""{_SUBMITTED_SQL},
    rows AS (SELECT s.submission_id, s.doc_id, s.doc_order, l_linenumber AS row_no, l_returnflag = 'R' AS annex
             FROM stats s JOIN lineitem ON doc_id = l_orderkey)
    SELECT submission_id, doc_id, CAST(row_no AS BIGINT) AS row_no,
           CAST(CASE WHEN NOT annex THEN count(*) FILTER (NOT annex) OVER (
             PARTITION BY submission_id ORDER BY doc_order, doc_id, row_no ROWS UNBOUNDED PRECEDING) END AS BIGINT) AS row_id
    FROM rows""",
)
def submission_row_ids(spark, sf):
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("row_no"), F.lit(1).alias("block_no"),
        F.when(F.col("l_returnflag") == "R", V.T_ANNEX).otherwise(V.T_EXEC).alias("task_type"),
    )
    rows = submitted(spark, sf).select("submission_id", "doc_id", "doc_order").join(items, "doc_id")
    done = O.assign_row_ids(rows, position=("doc_id", *O.POSITION), scope=("submission_id",))
    return done.select("submission_id", "doc_id", "row_no", "row_id")


_CELLS = ("item", "description", "task_type", "coalesce(CAST(row_id AS VARCHAR), '')", "hta", "task_text")
_SHEET = ("hta", "item", "description", "task_type", "coalesce(CAST(row_id AS VARCHAR), '')", "task_text")


def _named(cells, names):
    return ", ".join(f'{c} AS "{n}"' for c, n in zip(cells, names))


@query("matrix_csv_projection", f"WITH {_ROWS_SQL} SELECT {_named(_CELLS, V.MATRIX_CSV_COLUMNS)} FROM numbered")
def matrix_csv_projection(spark, sf):
    return sinks.matrix_csv_projection(O.assign_row_ids(O.dedupe_keep_first(O.normalize_rows(raw_rows(spark, sf)))))


@query("matrix_sheet_projection", f"WITH {_ROWS_SQL} SELECT {_named(_SHEET, V.MATRIX_SHEET_COLUMNS)} FROM numbered")
def matrix_sheet_projection(spark, sf):
    return sinks.matrix_sheet_projection(O.assign_row_ids(O.dedupe_keep_first(O.normalize_rows(raw_rows(spark, sf)))))


# --- rules -------------------------------------------------------------------------
# language-neutral categories and rules over real lines

_CATEGORY_SQL = """CASE WHEN contains(line, '|') THEN 'table_row' WHEN contains(line, '@') THEN 'contact'
               WHEN regexp_matches(line, '(?i)licen[sc]e') THEN 'licence' ELSE 'prose' END"""
_SCOPE_SQL = "CASE line_no % 4 WHEN 0 THEN 'anexo_b' WHEN 1 THEN 'anexo_arquivo_c' WHEN 2 THEN 'tabela_2' ELSE 'documento_principal' END"
_RULE_ROWS = (
    (1, "table", 10, "geral", r"\|", "Informação", "table_row", "a | b", None),
    (2, "contact", 20, "anexo", r"(?i)[a-z0-9.]+@[a-z0-9.]+", "Ignorar", "contact", None, None),
    (3, "licence", 30, "geral", r"(?i)licen[sc]e", "Título/Subtítulo", "licence", "licence", "{}"),
    (4, "question", 15, "geral", r"\?", "Execução", "geral", None, "{}"),
    (5, "annex b", 5, "anexo_b", r"(?i)^the ", "Execução", "prose", None, None),
    (6, "body", 40, "documento_principal", "", "Informação", "prose", "x", None),
    (7, "broken", 1, "geral", r"([", "Ignorar", "geral", None, None),
    (8, "table 2", 50, "tabela_2", r"(?i)tion", "Informação", "", None, None),
)
_RULES_SQL = (
    "rules(rule_id, name, ord, scope, pattern, task_type, category, example_in, example_out) AS (VALUES "
    + ", ".join(
        "(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")"
        for r in _RULE_ROWS
    )
    + ")"
)
_BLOCKS_SQL = f"""{LINES_SQL}, {_RULES_SQL},
    blocks AS (SELECT doc_id, line_no AS block_no, line AS text, {_CATEGORY_SQL} AS category, {_SCOPE_SQL} AS scope FROM lines WHERE line <> ''),
    kinds AS (SELECT DISTINCT scope, category FROM blocks),
    compat AS (
      SELECT k.scope AS b_scope, k.category AS b_category, r.*,
             CASE WHEN r.category = k.category THEN 0 WHEN r.category IN ('', 'geral') THEN 1 ELSE 2 END AS priority
      FROM kinds k JOIN rules r ON (r.scope IN ('geral', k.scope) OR (r.scope <> '' AND starts_with(k.scope, r.scope || '_')))
       AND (r.scope = k.scope OR r.scope = 'anexo' OR starts_with(k.scope, r.scope || '_') OR r.category IN ('', 'geral', k.category))),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY b_scope, b_category ORDER BY priority, ord, rule_id) AS rule_rank FROM compat)"""


def rule_table(spark):
    rows = [(*r, True) for r in _RULE_ROWS]
    return rulebook.usable_rules(spark.createDataFrame(rows, rulebook.RULE_SCHEMA))


def labelled_blocks(spark, sf):
    line = F.col("text")
    k = F.col("block_no") % 4
    return line_blocks(spark, sf).select(
        "*",
        F.when(F.contains(line, F.lit("|")), "table_row").when(F.contains(line, F.lit("@")), "contact")
        .when(line.rlike("(?i)licen[sc]e"), "licence").otherwise("prose").alias("category"),
        F.when(k == 0, "anexo_b").when(k == 1, "anexo_arquivo_c").when(k == 2, "tabela_2")
        .otherwise("documento_principal").alias("scope"),
    )


@query(
    "compatible_rules",
    f"WITH {_BLOCKS_SQL} SELECT b_scope AS scope, b_category AS category, rule_id FROM compat",
)
def compatible_rules(spark, sf):
    kinds = R.block_kinds(labelled_blocks(spark, sf))
    return R.compatible_rules(kinds, rule_table(spark)).select("scope", "category", F.col("r_rule_id").alias("rule_id"))


@query(
    "rank_rules",
    f"WITH {_BLOCKS_SQL} SELECT b_scope AS scope, b_category AS category, rule_id, rule_rank FROM ranked WHERE rule_id <> 7 OR true",
)
def rank_rules(spark, sf):
    # the broken rule keeps its rank: only its pattern is unusable
    kinds = R.block_kinds(labelled_blocks(spark, sf))
    ranked = R.rank_rules(R.compatible_rules(kinds, rule_table(spark)))
    return ranked.select("scope", "category", F.col("r_rule_id").alias("rule_id"), "rule_rank")


_USABLE = "rule_id <> 7 AND pattern <> ''"


@query(
    "rule_text_match",
    f"""WITH {LINES_SQL}, {_RULES_SQL}
    SELECT rule_id, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM lines
    JOIN (SELECT * FROM rules WHERE {_USABLE}) ON regexp_matches(line, pattern) GROUP BY rule_id""",
)
def rule_text_match(spark, sf):
    # the whole rule table travels as one value and is tried on each line in place
    tried = rule_table(spark).agg(F.collect_list(F.struct("rule_id", "pattern")).alias("r")).scalar()
    each = lines(spark, sf).withColumn("_rules", tried).select(
        "doc_id", F.explode(F.filter("_rules", lambda r: R.rule_text_match(F.col("line"), r["pattern"]))).alias("r")
    )
    hits = each.select("doc_id", "r.rule_id")
    return hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


_ORIENT_SQL = f"""{_BLOCKS_SQL},
    tried AS (
      SELECT b.doc_id, b.block_no, r.*,
             (r.category IN ('', 'geral', b.category) AND {_USABLE.replace('rule_id', 'r.rule_id').replace('pattern', 'r.pattern')}
              AND regexp_matches(b.text, CASE WHEN r.rule_id = 7 THEN '$^' ELSE r.pattern END)) AS by_text,
             (r.category = b.category AND r.task_type <> 'Ignorar') AS by_kind
      FROM blocks b JOIN ranked r ON r.b_scope = b.scope AND r.b_category = b.category),
    lead_rule AS (
      SELECT doc_id, block_no, name, rule_id, task_type FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id, block_no ORDER BY CASE WHEN by_text THEN 0 ELSE 1 END, rule_rank) AS rn
        FROM tried WHERE by_text OR by_kind) WHERE rn = 1),
    oriented AS (
      SELECT b.*, l.name AS rule, l.rule_id, l.task_type,
             CASE WHEN l.task_type = 'Ignorar' THEN 'ignorar' ELSE 'converter' END AS action
      FROM blocks b LEFT JOIN lead_rule l USING (doc_id, block_no))"""


@query("orient_blocks", f"WITH {_ORIENT_SQL} SELECT doc_id, block_no, rule, rule_id, task_type, action FROM oriented")
def orient_blocks(spark, sf):
    return R.orient_blocks(labelled_blocks(spark, sf), rule_table(spark)).select(
        "doc_id", "block_no", "orientation.rule", "orientation.rule_id", "orientation.task_type", "orientation.action"
    )


@query(
    "category_rule_counts",
    f"""WITH {_ORIENT_SQL},
    keyed AS (SELECT *, {key_sql('text')} AS k FROM oriented),
    common AS (SELECT k FROM keyed GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
    SELECT doc_id, category, rule, count(*) AS n_lines, sum(length(text)) AS n_chars
    FROM keyed WHERE k NOT IN (SELECT k FROM common) GROUP BY doc_id, category, rule""",
)
def category_rule_counts(spark, sf):
    """Lines per document, category and leading rule, boilerplate left out."""
    blocks = labelled_blocks(spark, sf).withColumn("line", F.col("text")).withColumn("line_no", F.col("block_no"))
    kept = L.drop_boilerplate(blocks, 3).drop("line", "line_no")
    return (
        R.orient_blocks(kept, rule_table(spark))
        .groupBy("doc_id", "category", F.col("orientation.rule").alias("rule"))
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))
    )


_BATCH_SQL = f"""{_BLOCKS_SQL}, batched AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - 1) // 8 + 1 AS batch_no FROM blocks)"""


def _eights(blocks):
    """Batches by count alone: enough for operators that only need a batch key."""
    return P.pack_batches(blocks, max_chars=10**9)


@query(
    "rules_per_batch",
    f"""WITH {_BATCH_SQL},
    seen AS (SELECT doc_id, batch_no, rule_id, min(block_no * 1000 + rule_rank) AS first_at
             FROM batched b JOIN ranked r ON r.b_scope = b.scope AND r.b_category = b.category GROUP BY ALL)
    SELECT doc_id, batch_no, rule_id, row_number() OVER (PARTITION BY doc_id, batch_no ORDER BY first_at) AS position FROM seen""",
)
def rules_per_batch(spark, sf):
    return R.rules_per_batch(_eights(labelled_blocks(spark, sf)), rule_table(spark)).select(
        "doc_id", "batch_no", "rule_id", "position"
    )


@query(
    "examples_per_batch",
    f"""WITH {_BATCH_SQL}
    SELECT DISTINCT doc_id, batch_no, name, example_in, example_out
    FROM batched b JOIN ranked r ON r.b_scope = b.scope AND r.b_category = b.category
    WHERE coalesce(example_in, '') <> '' OR coalesce(example_out, '') <> ''""",
)
def examples_per_batch(spark, sf):
    rules = rule_table(spark)
    found = R.rules_per_batch(_eights(labelled_blocks(spark, sf)), rules)
    return R.examples_per_batch(found, rules).select("doc_id", "batch_no", "name", "example_in", "example_out")


@query(
    "top_examples",
    """
    SELECT document_type, example_id, position FROM (
      SELECT lang AS document_type, doc_id AS example_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS position
      FROM documents JOIN labels USING (doc_id) WHERE quality = 1) WHERE position <= 5""",
)
def top_examples(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    examples = documents(spark, sf).join(good, "doc_id").select(
        F.col("lang").alias("document_type"), F.col("doc_id").alias("example_id")
    )
    return R.top_examples(examples).select("document_type", "example_id", "position")


# --- batches ------------------------------------------------------------------------

_PACK_SQL = f"""{LINES_SQL},
    b AS (SELECT doc_id, line_no AS block_no, length(line) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM lines WHERE line <> ''),
    packed AS (
      SELECT doc_id, block_no, i, n AS chars, 1 AS cnt, 1 AS batch_no FROM b WHERE i = 1
      UNION ALL
      SELECT b.doc_id, b.block_no, b.i,
             CASE WHEN p.chars + b.n > 12000 OR p.cnt >= 8 THEN b.n ELSE p.chars + b.n END,
             CASE WHEN p.chars + b.n > 12000 OR p.cnt >= 8 THEN 1 ELSE p.cnt + 1 END,
             CASE WHEN p.chars + b.n > 12000 OR p.cnt >= 8 THEN p.batch_no + 1 ELSE p.batch_no END
      FROM packed p JOIN b ON b.doc_id = p.doc_id AND b.i = p.i + 1)"""


@query("pack_batches", f"WITH RECURSIVE {_PACK_SQL} SELECT doc_id, block_no, batch_no FROM packed")
def pack_batches(spark, sf):
    return P.pack_batches(line_blocks(spark, sf)).select("doc_id", "block_no", "batch_no")


@query(
    "step_accounting",
    f"""WITH RECURSIVE {_PACK_SQL},
    d AS (SELECT doc_id % 50 AS submission, doc_id, max(batch_no) AS n FROM packed GROUP BY ALL)
    SELECT submission, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_batches,
           CAST(count(*) + 2 + 2 * sum(n) AS BIGINT) AS total_steps, count(*) + 1 AS steps_before_batches
    FROM d GROUP BY submission""",
)
def step_accounting(spark, sf):
    batches = P.pack_batches(line_blocks(spark, sf)).withColumn("submission", F.col("doc_id") % 50)
    return P.step_accounting(batches)


@query(
    "prompt_payload",
    f"""WITH RECURSIVE {_PACK_SQL}, t AS (SELECT packed.*, line FROM packed JOIN lines ON lines.doc_id = packed.doc_id AND line_no = block_no)
    SELECT doc_id, batch_no, list(block_no ORDER BY block_no) AS orders, list(line ORDER BY block_no) AS texts FROM t GROUP BY ALL""",
)
def prompt_payload(spark, sf):
    """Payloads are read back from their JSON, so the check covers its content."""
    blocks = labelled_blocks(spark, sf)
    shaped = R.orient_blocks(blocks, rule_table(spark)).select(
        "*", F.lit("f.pdf").alias("filename"), F.col("doc_id").alias("doc_order"), F.lit("").alias("item"),
        F.lit(None).cast("struct<item:string,hta:string,op_group:string>").alias("context"),
        F.lit("").alias("section_ctx"), F.lit(False).alias("title_flag"), F.lit(False).alias("list_flag"),
    )
    packed = P.pack_batches(shaped)
    found = R.rules_per_batch(packed, rule_table(spark))
    payload = P.prompt_payload(packed, found, R.examples_per_batch(found, rule_table(spark)))
    back = F.from_json("payload", "struct<ordensBlocoPermitidas:array<int>,blocos:array<struct<texto:string>>>")
    return payload.withColumn("_p", back).select(
        "doc_id", "batch_no", F.col("_p.ordensBlocoPermitidas").alias("orders"),
        F.transform("_p.blocos", lambda b: b["texto"]).alias("texts"),
    )


# --- reconciliation -----------------------------------------------------------------

def _responses(spark, sf):
    """One model response per document, written by the corpus itself."""
    k = F.col("doc_id") % 4
    entry = F.concat(
        F.lit('{"'), F.when(k == 1, "ordem").otherwise("ordemBloco"), F.lit('":'), F.lit("1,"),
        F.lit('"descricao":'), F.to_json(F.array("lang")).substr(F.lit(2), F.length(F.to_json(F.array("lang"))) - 2),
        F.lit(',"tipoTarefa":"'), F.when(k == 3, "Outro").otherwise("Execução"), F.lit('"}'),
    )
    body = F.concat(F.lit('{"'), F.when(k == 2, "itens").otherwise("linhas"), F.lit('":['), entry, F.lit("]}"))
    return documents(spark, sf).select(
        "doc_id", F.lit(1).alias("batch_no"), F.lit(1).alias("attempt"),
        F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("response"),
    )


@query(
    "parse_responses",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 1 END AS block_no, CASE WHEN doc_id % 4 < 2 THEN lang END AS description,
              CASE WHEN doc_id % 4 >= 2 THEN 'invalid_response' END AS error FROM documents""",
)
def parse_responses(spark, sf):
    good, bad = M.parse_responses(_responses(spark, sf))
    none = F.lit(None).cast("string")
    return good.select("doc_id", "block_no", "description", none.alias("error")).unionByName(
        bad.select("doc_id", F.lit(None).cast("int").alias("block_no"), none.alias("description"), "error")
    )


@query(
    "repair_orders",
    """
    WITH asked AS (SELECT l_orderkey AS doc_id, l_linenumber + CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 8 END AS block_no FROM lineitem GROUP BY ALL),
    n AS (SELECT doc_id, count(*) AS n, list(block_no ORDER BY block_no) AS orders FROM asked GROUP BY doc_id),
    answers AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS row_no,
                  CASE WHEN doc_id % 2 = 0 THEN block_no - 8 ELSE block_no + doc_id % 5 END AS block_no FROM asked),
    j AS (SELECT a.*, n.n, n.orders, list_contains(orders, a.block_no) AS known, a.block_no BETWEEN 1 AND n.n AS loc,
                 orders = range(1, n.n + 1) AS seq FROM answers a JOIN n USING (doc_id)),
    f AS (SELECT *, bool_or(NOT seq AND NOT known AND loc) OVER (PARTITION BY doc_id) AS is_local FROM j)
    SELECT doc_id, row_no, CASE WHEN is_local AND loc THEN orders[block_no] WHEN known THEN block_no END AS block_no
    FROM f WHERE (is_local AND loc) OR known""",
)
def repair_orders(spark, sf):
    from pyspark.sql import Window

    k = F.col("l_orderkey")
    asked = table(spark, sf, "lineitem").select(
        k.alias("doc_id"), F.lit(1).alias("batch_no"),
        (F.col("l_linenumber") + F.when(k % 3 == 0, 0).otherwise(8)).cast("int").alias("block_no"),
    ).distinct()
    order = Window.partitionBy("doc_id").orderBy("block_no")
    answers = asked.withColumn("row_no", F.row_number().over(order)).withColumn(
        "block_no",
        F.when(F.col("doc_id") % 2 == 0, F.col("block_no") - 8).otherwise(F.col("block_no") + F.col("doc_id") % 5).cast("int"),
    )
    return M.repair_orders(answers, asked).select("doc_id", "row_no", "block_no")


_STEMS = """list_distinct(list_transform(list_filter({0}, lambda w: length(w) >= 4 AND w NOT IN (%s)), lambda w: substr(w, 1, 5)))""" % ", ".join(
    repr(w) for w in V.GENERIC_WORDS
)


@query(
    "grounded_rows",
    f"""
    WITH p AS (
      SELECT d.doc_id, b.item_id AS block_no,
             regexp_extract_all(lower(strip_accents(b.text)), '[a-z0-9]+') AS own,
             regexp_extract_all(lower(strip_accents(d.text)), '[a-z0-9]+') AS src
      FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT max(item_id) + 1 FROM benchmark)),
    s AS (SELECT *, {_STEMS.format('own')} AS a, {_STEMS.format('src')} AS b FROM p)
    SELECT doc_id, block_no FROM s
    WHERE len(own) > 0 AND len(src) > 0 AND (contains(array_to_string(src, ' '), array_to_string(own, ' '))
      OR (len(a) > 0 AND len(list_intersect(a, b)) / len(a) >= 0.5))""",
)
def grounded_rows(spark, sf):
    """Benchmark passages offered as rows for documents: kept where the text supports them."""
    items = table(spark, sf, "benchmark").agg(F.max("item_id") + 1).scalar()
    blocks = documents(spark, sf).select("doc_id", (F.col("doc_id") % items).alias("block_no"), "text")
    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("block_no"), F.col("text").alias("description"))
    rows = blocks.select("doc_id", "block_no").join(passages, "block_no").select(
        "doc_id", "block_no", "description", F.lit(V.T_INFO).alias("task_type"), F.lit("").alias("task_text")
    )
    return M.grounded_rows(rows, blocks).select("doc_id", "block_no")


@query(
    "uncovered_blocks",
    "SELECT c_custkey AS block_no FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey + o_orderkey % 3 * 1000000 = c_custkey)",
)
def uncovered_blocks(spark, sf):
    blocks = table(spark, sf, "customer").select(F.col("c_custkey").alias("block_no"))
    rows = table(spark, sf, "orders").select((F.col("o_custkey") + F.col("o_orderkey") % 3 * 1_000_000).alias("block_no"))
    return M.uncovered_blocks(blocks, rows, ["block_no"])


@query(
    "coverage_report",
    """
    WITH b AS (SELECT DISTINCT c_custkey % 25 AS batch_no, c_custkey AS block_no FROM customer),
    r AS (SELECT DISTINCT o_custkey % 25 AS batch_no, o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 25000000 END AS block_no FROM orders)
    SELECT coalesce(b.batch_no, r.batch_no) AS batch_no,
           CAST(sum(CASE WHEN r.block_no IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
           CAST(sum(CASE WHEN b.block_no IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown,
           (sum(CASE WHEN r.block_no IS NULL OR b.block_no IS NULL THEN 1 ELSE 0 END) > 0) AS failed
    FROM b FULL OUTER JOIN r ON b.batch_no = r.batch_no AND b.block_no = r.block_no GROUP BY 1""",
)
def coverage_report(spark, sf):
    k = F.col("c_custkey")
    blocks = table(spark, sf, "customer").select((k % 25).alias("batch_no"), k.alias("block_no"))
    o = F.col("o_custkey")
    # three orders of four speak of blocks nobody sent
    block = o + F.when(F.col("o_orderkey") % 4 == 0, 0).otherwise(25_000_000)
    rows = table(spark, sf, "orders").select((o % 25).alias("batch_no"), block.alias("block_no"))
    return M.coverage_report(blocks, rows, ["batch_no"])


def _line_rows(spark, sf, keep, tag):
    return line_blocks(spark, sf).where(keep).select(
        "doc_id", "block_no", F.lit(1).alias("row_no"), F.lit("").alias("item"), F.col("text").alias("description"),
        F.lit(V.T_INFO).alias("task_type"), F.lit("").alias("hta"), F.lit(tag).alias("task_text"),
    )


@query(
    "fallback_union",
    f"""WITH {LINES_SQL}
    SELECT doc_id, line_no AS block_no, CASE WHEN line_no % 5 = 0 THEN 'fixed' WHEN line_no % 2 = 0 THEN 'first'
             WHEN line_no % 3 = 0 THEN 'second' ELSE 'fallback' END AS origin
    FROM lines WHERE line <> ''""",
)
def fallback_union(spark, sf):
    return M.fallback_union(
        _line_rows(spark, sf, "block_no % 5 = 0", "fixed"),
        _line_rows(spark, sf, "block_no % 5 <> 0 and block_no % 2 = 0", "first"),
        _line_rows(spark, sf, "block_no % 5 <> 0 and block_no % 3 = 0", "second"),
        _line_rows(spark, sf, "block_no % 5 <> 0", "fallback"),
    ).select("doc_id", "block_no", F.col("task_text").alias("origin"))


@query(
    "granularity_guard",
    """
    WITH m AS (SELECT o_custkey AS doc_id, 1 AS block_no, o_orderkey AS row_no, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth,
                 count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT doc_id, 'item ' || doc_id AS item, row_no, 'answer ' || row_no AS task_text FROM m WHERE n >= doc_id % 7 AND doc_id % 7 > 0 AND nth <= doc_id % 7
    UNION ALL
    SELECT c_custkey, 'own', k, 'fallback' FROM customer, range(1, 8) t(k)
    WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) < o_custkey % 7) AND k <= c_custkey % 7
    UNION ALL
    SELECT c_custkey, 'own', 1, 'info' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey IN (SELECT o_custkey FROM orders)""",
)
def granularity_guard(spark, sf):
    """Orders as model rows of one block per customer; the fallback expects key mod 7 actions."""
    text = lambda c: F.col(c).cast("string")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.lit(1).alias("block_no"), F.col("o_orderkey").alias("row_no"),
        F.lit("").alias("item"), F.lit("d").alias("description"), F.lit(V.T_EXEC).alias("task_type"),
        F.lit("9.").alias("hta"), F.concat(F.lit("answer "), text("o_orderkey")).alias("task_text"),
    )
    k = F.col("c_custkey")
    customers = table(spark, sf, "customer")
    blocks = customers.select(
        k.alias("doc_id"), F.lit(1).alias("block_no"), F.lit("instrucao_operacional").alias("category"),
        F.concat(F.lit("item "), k.cast("string")).alias("item"), F.lit("").alias("section_ctx"), F.lit("text").alias("b_descr"),
    )
    n = (k % 7).cast("int")
    fallback = customers.select(
        k.alias("doc_id"), F.lit(1).alias("block_no"),
        F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1))).cast("array<bigint>")).alias("row_no"), F.lit("own").alias("item"),
        F.lit("d").alias("description"), F.when(n == 0, V.T_INFO).otherwise(V.T_EXEC).alias("task_type"),
        F.lit("").alias("hta"), F.when(n == 0, "info").otherwise("fallback").alias("task_text"),
    )
    return M.granularity_guard(rows, blocks, fallback).select("doc_id", "item", "row_no", "task_text")


@query(
    "fill_detected_item",
    """
    SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 3 = 0 THEN 'own' ELSE s_nationkey || '.' || s_suppkey END AS item,
           CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey || '.' || s_suppkey || ' - ' || s_name ELSE s_name END AS description
    FROM supplier""",
)
def fill_detected_item(spark, sf):
    number = F.concat(F.col("s_nationkey").cast("string"), F.lit("."), F.col("s_suppkey").cast("string"))
    base = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.lit(1).alias("block_no"), number.alias("n"), "s_name")
    rows = base.select(
        "doc_id", "block_no", F.when(F.col("doc_id") % 3 == 0, "own").otherwise("").alias("item"),
        F.concat("n", F.lit(" - "), "s_name").alias("description"), F.lit(V.T_TITLE).alias("task_type"),
    )
    return M.fill_detected_item(rows, base.select("doc_id", "block_no", F.col("n").alias("item"))).select("doc_id", "item", "description")


@query(
    "order_and_prune",
    f"""WITH {_ROWS_SQL}
    SELECT doc_id, block_no, 1 AS row_no FROM raw WHERE trim(description) <> '' OR (task_type = 'Padrão/Anexo' AND trim(item) <> '')""",
)
def order_and_prune(spark, sf):
    return M.order_and_prune(raw_rows(spark, sf)).select("doc_id", "block_no", "row_no")


# --- summaries and failures ---------------------------------------------------------

@query(
    "debug_summary",
    f"WITH {_BLOCKS_SQL} SELECT doc_id, category, scope, count(*) AS n_blocks FROM blocks GROUP BY ALL",
)
def debug_summary(spark, sf):
    return O.debug_summary(labelled_blocks(spark, sf))


@query(
    "debug_blocks",
    f"""WITH {_BATCH_SQL},
    hits AS (SELECT doc_id, batch_no, rule_id, name, coalesce(example_in, '') <> '' OR coalesce(example_out, '') <> '' AS example,
                    min(block_no * 1000 + rule_rank) AS first_at
             FROM batched b JOIN ranked r ON r.b_scope = b.scope AND r.b_category = b.category GROUP BY ALL),
    given AS (SELECT doc_id, batch_no, list(name ORDER BY first_at) AS rules, count(*) FILTER (WHERE example) AS n_examples FROM hits GROUP BY ALL)
    SELECT doc_id, batch_no, block_no, category, scope, coalesce(rules, []) AS rules, coalesce(n_examples, 0) AS n_examples
    FROM batched LEFT JOIN given USING (doc_id, batch_no) WHERE doc_id % 4 < 2 OR batch_no <> 1""",
)
def debug_blocks(spark, sf):
    """Rules and examples per block; a document's first batch is left out where its response is wrong."""
    rules = rule_table(spark)
    packed = _eights(labelled_blocks(spark, sf))
    found = R.rules_per_batch(packed, rules)
    errors = M.parse_responses(_responses(spark, sf))[1]
    return O.debug_blocks(packed, found, R.examples_per_batch(found, rules), errors)


@query(
    "failure_report",
    f"""WITH RECURSIVE {_PACK_SQL}
    SELECT doc_id, batch_no, list(block_no ORDER BY block_no) AS block_nos, 'invalid_response' AS error
    FROM packed WHERE doc_id % 4 >= 2 AND batch_no = 1 GROUP BY ALL""",
)
def failure_report(spark, sf):
    packed = P.pack_batches(line_blocks(spark, sf)).select(
        "doc_id", F.lit("f").alias("filename"), F.col("doc_id").alias("doc_order"), "batch_no", "block_no"
    )
    errors = M.parse_responses(_responses(spark, sf))[1]
    return O.failure_report(packed, errors).select("doc_id", "batch_no", "block_nos", "error")


@query(
    "coverage_failures",
    f"""WITH RECURSIVE {_PACK_SQL},
    told AS (SELECT packed.doc_id, batch_no, block_no, regexp_matches(line, '[0-9|]') AS silent
             FROM packed JOIN lines ON lines.doc_id = packed.doc_id AND lines.line_no = packed.block_no)
    SELECT doc_id, batch_no, list(block_no ORDER BY block_no) AS block_nos,
           'uncovered_blocks: ' || string_agg(CAST(block_no AS VARCHAR), ', ' ORDER BY block_no) FILTER (WHERE silent) AS error
    FROM told
    GROUP BY doc_id, batch_no HAVING bool_or(silent)""",
)
def coverage_failures(spark, sf):
    """Batches that fail because lines with digits or bars got no row."""
    packed = P.pack_batches(line_blocks(spark, sf)).select(
        "doc_id", F.lit("f").alias("filename"), F.col("doc_id").alias("doc_order"), "batch_no", "block_no", "text"
    )
    answered = packed.where(~F.col("text").rlike("[0-9|]"))
    report = O.failure_report(packed.drop("text"), plan.coverage_errors(packed, answered))
    return report.select("doc_id", "batch_no", "block_nos", "error")


@query(
    "run_outcome",
    f"""WITH RECURSIVE {_PACK_SQL}
    SELECT doc_id, count(DISTINCT batch_no) AS n_batches, CAST(CASE WHEN doc_id % 4 >= 2 THEN 1 ELSE 0 END AS BIGINT) AS n_failed,
           (doc_id % 4 >= 2) AS partial FROM packed GROUP BY doc_id""",
)
def run_outcome(spark, sf):
    packed = P.pack_batches(line_blocks(spark, sf))
    return O.run_outcome(packed, M.parse_responses(_responses(spark, sf))[1])


# --- status ------------------------------------------------------------------------

_EVENT_SQL = """
    ev AS (SELECT user_id AS id, ts AS event_ts, event_id AS seq,
             CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'update' END AS kind,
             event_type AS stage, props AS message,
             CASE WHEN event_type = 'view' THEN event_id % 17 END AS done, CASE WHEN event_type IN ('view', 'signup') THEN 17 + event_id % 3 END AS total
           FROM events),
    s AS (SELECT id, max(event_ts) AS started FROM ev WHERE kind = 'start' GROUP BY id),
    live AS (SELECT ev.*, started FROM ev JOIN s USING (id) WHERE event_ts > started),
    a AS (SELECT s.id, s.started,
            max(event_ts) AS last_any, arg_max(kind, event_ts) AS last_kind, arg_max(stage, event_ts) AS last_stage,
            max(CASE WHEN kind = 'complete' THEN event_ts END) AS fin, max(CASE WHEN kind = 'error' THEN event_ts END) AS err,
            max(CASE WHEN kind = 'update' AND done IS NOT NULL THEN event_ts END) AS done_at,
            arg_max(done, event_ts) FILTER (WHERE kind = 'update' AND done IS NOT NULL) AS done,
            arg_max(total, event_ts) FILTER (WHERE kind = 'update' AND total IS NOT NULL) AS total
          FROM s LEFT JOIN live USING (id, started) GROUP BY ALL),
    status AS (
      SELECT id, CASE WHEN fin IS NULL AND err IS NULL THEN 'processando' WHEN err IS NULL OR fin > err THEN 'concluido' ELSE 'erro' END AS status,
             CASE coalesce(last_kind, 'start') WHEN 'update' THEN last_stage WHEN 'complete' THEN 'concluido' WHEN 'error' THEN 'erro' ELSE 'envio' END AS stage,
             CASE WHEN fin IS NOT NULL AND (done_at IS NULL OR done_at <= fin) THEN coalesce(total, 0) ELSE coalesce(done, 0) END AS done,
             coalesce(total, 0) AS total,
             CASE WHEN fin IS NOT NULL AND (done_at IS NULL OR done_at <= fin) THEN 100
                  WHEN coalesce(total, 0) = 0 THEN 0 ELSE CAST(round_even(coalesce(done, 0) / total * 100, 0) AS INTEGER) END AS percent,
             coalesce(last_any, started) AS updated_at
      FROM a)"""


# a record ends at the first gap of more than a day
EXPIRING_SQL = _EVENT_SQL.replace(
    "    a AS (SELECT s.id", """    gaps AS (SELECT *, event_ts - coalesce(lag(event_ts) OVER (PARTITION BY id ORDER BY event_ts), started) > INTERVAL 1 DAY AS gap FROM live),
    broken AS (SELECT id, min(event_ts) AS since FROM gaps WHERE gap GROUP BY id),
    kept AS (SELECT live.* FROM live LEFT JOIN broken USING (id) WHERE since IS NULL OR event_ts < since),
    a AS (SELECT s.id""",
).replace("FROM s LEFT JOIN live", "FROM s LEFT JOIN kept")


def status_events(spark, sf):
    return as_status_events(table(spark, sf, "events"))


def as_status_events(events):
    """Sign-ups start a job, purchases complete it; batch or stream."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("event_ts"), F.col("event_id").alias("seq"),
        F.when(kind == "signup", "start").when(kind == "purchase", "complete").when(kind == "error", "error").otherwise("update").alias("kind"),
        kind.alias("stage"), F.col("props").alias("message"),
        F.when(kind == "view", F.col("event_id") % 17).alias("done"),
        F.when(kind.isin("view", "signup"), 17 + F.col("event_id") % 3).alias("total"),
    )


@query("latest_status", f"WITH {_EVENT_SQL} SELECT * FROM status")
def latest_status(spark, sf):
    return G.latest_status(status_events(spark, sf)).drop("message")


@query(
    "expire_status",
    f"""WITH {_EVENT_SQL}
    SELECT id, updated_at FROM status WHERE updated_at >= (SELECT max(updated_at) FROM status) - INTERVAL 6 HOUR""",
)
def expire_status(spark, sf):
    status = G.latest_status(status_events(spark, sf)).select("id", "updated_at")
    now = status.agg(F.max("updated_at").alias("now")).scalar()
    return G.expire_status(status, now, "6 hours")


@query(
    "progress_percent",
    """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE CAST(round_even((event_id % 8) / (event_id % 9) * 100, 0) AS INTEGER) END AS percent
       FROM events""",
)
def progress_percent(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", G.progress_percent(k % 8, k % 9).alias("percent"))


# --- row generation -----------------------------------------------------------------

@query(
    "to_infinitive",
    f"""WITH {LINES_SQL}, l AS (SELECT *, trim(line, ' ;,.·') AS x FROM lines WHERE line <> '')
    SELECT doc_id, line_no, CASE line_no % 3 WHEN 0 THEN 'Abrir ' WHEN 1 THEN 'Registrar ' ELSE 'Bloquear ' END || x ||
      CASE WHEN regexp_matches(x, '[.!?]$') THEN '' ELSE '.' END AS action FROM l WHERE x <> ''""",
)
def to_infinitive(spark, sf):
    k, line = F.col("line_no") % 3, F.col("line")
    bare = T.strip_chars(line, " ;,.·")
    lead = F.when(k == 0, "abra ").when(k == 1, "COMO FAZER: registrando ").otherwise("deverá ser bloqueado ")
    source = lines(spark, sf).select("doc_id", "line_no", bare.alias("bare"), lead.alias("lead")).where("bare <> ''")
    return X.to_infinitive(source.withColumn("src", F.concat("lead", "bare")), "src", "action").select("doc_id", "line_no", "action")


def _plain_lines(spark, sf):
    """Lines as ``x``, letters and single blanks only; a filter would work every line out twice, so empty ones explode to nothing."""
    # letters listed one by one share a table lookup
    x = F.trim(F.regexp_replace(F.regexp_replace("line", f"[^{string.ascii_letters} ]+", ""), " {2,}", " "))
    return lines(spark, sf).select("doc_id", "line_no", F.explode(T.let(x, lambda v: F.when(v != "", F.array(v)))).alias("x"))


_PLAIN_SQL = "regexp_replace(regexp_replace(line, '[^a-zA-Z ]', '', 'g'), ' +', ' ', 'g')"


@query(
    "split_conditional_bullets",
    f"""WITH {LINES_SQL}, p AS (SELECT doc_id, line_no, trim({_PLAIN_SQL}) AS x FROM lines), q AS (SELECT * FROM p WHERE x <> '')
    SELECT doc_id, line_no, 0 AS pos, 'Caso ' || x AS part FROM q
    UNION ALL SELECT doc_id, line_no, 1, 'Quando ' || x || ' e fechar' FROM q""",
)
def split_conditional_bullets(spark, sf):
    rows = _plain_lines(spark, sf)
    text = F.concat(F.lit("• Caso "), F.col("x"), F.lit("; • Quando "), F.col("x"), F.lit(" e fechar;"))
    return rows.select("doc_id", "line_no", F.posexplode(X.split_conditional_bullets(text)).alias("pos", "part"))


@query(
    "split_list_items",
    f"""WITH {LINES_SQL}, p AS (SELECT doc_id, line_no, trim({_PLAIN_SQL}) AS x FROM lines), q AS (SELECT * FROM p WHERE x <> '')
    SELECT doc_id, line_no, 0 AS pos, '' AS marker, 'Lista ' || x || ':' AS descr FROM q
    UNION ALL SELECT doc_id, line_no, 1, '', '- ' || x FROM q
    UNION ALL SELECT doc_id, line_no, 2, 'b', '• b. ' || x || ';' FROM q
    UNION ALL SELECT doc_id, line_no, 3, 'c', 'c) ' || x FROM q""",
)
def split_list_items(spark, sf):
    rows = _plain_lines(spark, sf)
    items = F.array(
        F.concat(F.lit("Lista "), F.col("x"), F.lit(":")), F.concat(F.lit("- "), F.col("x")),
        F.concat(F.lit("• b. "), F.col("x"), F.lit("; c) "), F.col("x")),
    )
    return rows.select("doc_id", "line_no", F.posexplode(X.split_list_items(items)).alias("pos", "i")).select(
        "doc_id", "line_no", "pos", "i.marker", "i.descr"
    )


@query(
    "key_value_pairs",
    f"""WITH {LINES_SQL}, p AS (SELECT doc_id, line_no, list_transform(string_split(line, '|'), lambda c: trim(c)) AS c,
                                      lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt, line FROM lines)
    SELECT doc_id, line_no, c[1] AS k, trim(regexp_replace(array_to_string(c[2:], ' | ') || CASE WHEN nxt IS NULL OR contains(nxt, '|') THEN '' ELSE ' ' || trim(nxt) END, ' +', ' ', 'g')) AS v
    FROM p WHERE contains(line, '|')""",
)
def key_value_pairs(spark, sf):
    """Table lines of the corpus, each with the line below it."""
    from pyspark.sql import Window

    doc = Window.partitionBy("doc_id").orderBy("line_no")
    paired = L.split_lines(documents(spark, sf).select("doc_id", "text")).withColumn("below", F.lead("line").over(doc))
    rows = paired.where(F.contains("line", F.lit("|")))
    follows = F.when(F.col("below").isNull() | F.contains("below", F.lit("|")), "").otherwise(F.col("below"))
    pairs = X.key_value_pairs(F.filter(F.array(F.col("line"), follows), lambda x: x != ""))
    return rows.select("doc_id", "line_no", F.get(pairs, F.lit(0)).alias("p")).select(
        "doc_id", "line_no", "p.k", F.trim(F.regexp_replace(F.regexp_replace("p.v", r" *\| *", " | "), " +", " ")).alias("v")
    )


@query(
    "split_actions",
    f"""WITH {LINES_SQL}, p AS (SELECT doc_id, line_no, trim({_PLAIN_SQL}) AS x FROM lines), q AS (SELECT * FROM p WHERE x <> '')
    SELECT doc_id, line_no AS block_no, 1 AS row_no, 'Coletar ' || x || ', caso haja ' || x || '.' AS task_text FROM q
    UNION ALL SELECT doc_id, line_no, 2, 'Abrir ' || x || '.' FROM q
    UNION ALL SELECT doc_id, line_no, 3, 'Fechar ' || x || '.' FROM q""",
)
def split_actions(spark, sf):
    rows = _plain_lines(spark, sf).withColumnRenamed("line_no", "block_no")
    text = F.concat(
        F.lit("Caso haja "), F.col("x"), F.lit(", recomenda-se coletar "), F.col("x"), F.lit(". Abra "), F.col("x"),
        F.lit(" e feche "), F.col("x"), F.lit(". Não deverá abrir "), F.col("x"), F.lit("."),
    )
    return X.split_actions(rows.withColumn("text", text)).select("doc_id", "block_no", "row_no", "task_text")


@query(
    "resolve_reference",
    f"""WITH {LINES_SQL}, p AS (SELECT doc_id, line_no, trim({_PLAIN_SQL}) AS x,
        CASE line_no % 3 WHEN 0 THEN '' WHEN 1 THEN 'o alarme' ELSE 'a bomba $1' END AS entity FROM lines)
    SELECT doc_id, line_no, CASE
        WHEN line_no % 2 = 0 THEN 'Verificar que ' || CASE WHEN entity = '' THEN 'a mesma' ELSE entity END || ' ' || x
        ELSE 'Bloquear ' || CASE WHEN entity = '' THEN '' ELSE entity || ' ' END || 'em ' || x END AS action
    FROM p WHERE x <> ''""",
)
def resolve_reference(spark, sf):
    x = F.trim(F.regexp_replace(F.regexp_replace("line", "[^a-zA-Z ]", ""), " +", " "))
    n = F.col("line_no")
    rows = lines(spark, sf).select("doc_id", "line_no", x.alias("x")).where("x <> ''").select(
        "doc_id", "line_no", F.when(n % 3 == 0, "").when(n % 3 == 1, "o alarme").otherwise("a bomba $1").alias("entity"),
        F.concat(F.when(n % 2 == 0, "Verificar que a mesma ").otherwise("Bloquear em "), F.col("x")).alias("action"),
    )
    return rows.select("doc_id", "line_no", A.resolve_reference(F.col("action"), F.col("entity")).alias("action"))


@query(
    "needs_model",
    f"""WITH {_BLOCKS_SQL}, c AS (SELECT doc_id, block_no, CASE category WHEN 'prose' THEN 'geral' WHEN 'table_row' THEN 'atividade_anomalia'
              WHEN 'contact' THEN 'como_fazer' ELSE 'secao_principal' END AS category, block_no % 6 = 0 AS t FROM blocks)
    SELECT doc_id, block_no, NOT (t OR category = 'geral') AS residue FROM c""",
)
def needs_model(spark, sf):
    c = F.col("category")
    blocks = labelled_blocks(spark, sf).select(
        "doc_id", "block_no",
        F.when(c == "prose", "geral").when(c == "table_row", "atividade_anomalia").when(c == "contact", "como_fazer")
        .otherwise("secao_principal").alias("category"),
        (F.col("block_no") % 6 == 0).alias("title_flag"), F.lit(False).alias("list_flag"),
        F.lit(None).cast("struct<item:string>").alias("context"),
    )
    return blocks.select("doc_id", "block_no", X.needs_model(blocks).alias("residue"))


# --- numbering ----------------------------------------------------------------------

_SUPPLY_SQL = """
    r AS (SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS pos, s_suppkey, s_nationkey
          FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, s_nationkey) AS since FROM r)"""


@query(
    "hierarchical_numbering",
    f"""WITH {_SUPPLY_SQL},
    g AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY since) AS root,
                 row_number() OVER (PARTITION BY doc_id, s_nationkey ORDER BY pos) AS act FROM f)
    SELECT doc_id, s_suppkey AS block_no, root || '.' || act || '.' AS hta FROM g""",
)
def hierarchical_numbering(spark, sf):
    """Suppliers as actions, nations as sections, regions as documents."""
    nation = table(spark, sf, "nation")
    rows = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("doc_id"), F.col("n_regionkey").alias("doc_order"), F.col("s_suppkey").alias("block_no"),
        F.lit(1).alias("row_no"), F.lit("").alias("item"), F.col("s_name").alias("description"),
        F.lit(V.T_EXEC).alias("task_type"), F.lit("").alias("hta"), F.col("s_name").alias("task_text"),
        F.lit("instrucao_operacional").alias("b_category"), F.lit("documento_principal").alias("b_scope"),
        F.concat((F.col("s_nationkey") + 1).cast("string"), F.lit(".1")).alias("b_section"), F.lit("").alias("b_item"),
        F.lit(None).cast("struct<item:string,hta:string,op_group:string>").alias("b_context"),
        F.lit(False).alias("b_standalone"), F.lit(0).alias("b_stage"),
    )
    return H.number_documents(rows, 1).select("doc_id", "block_no", "hta")


@query(
    "annex_numbers",
    """
    WITH RECURSIVE e AS (
      SELECT o_custkey AS doc_id, CAST(nth AS INTEGER) AS pos, nth, g, CASE WHEN o_custkey % 3 = 0 THEN '1.2' WHEN g = 0 THEN '1' ELSE '1.' || o_custkey % 2 + 1 END AS prefix,
             CASE k % 5 WHEN 0 THEN CAST(k % 4 + 1 AS VARCHAR) WHEN 1 THEN '2.' || k % 3 + 1 WHEN 2 THEN 'x' ELSE '' END AS suffix
      FROM (SELECT o_custkey, o_orderkey * 7 % 101 AS k, o_orderkey // 3 % 2 AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders)),
    steps AS (
      SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS nth, CAST(0 AS INTEGER) AS pos, [CAST(0 AS BIGINT), 0] AS counts, CAST([] AS VARCHAR[]) AS given, '' AS rel FROM e
      UNION ALL
      SELECT doc_id, nth, pos, CASE WHEN g = 0 THEN [n, counts[2]] ELSE [counts[1], n] END, list_append(given, rel), rel FROM (
        SELECT *, CASE WHEN hit THEN prefix || '.' || n || '.' ELSE text END AS rel FROM (
          SELECT *, base + CASE WHEN hit THEN 1 ELSE 0 END AS n FROM (
            SELECT s.doc_id, e.nth, e.pos, s.counts, s.given, e.g, e.prefix, e.prefix || '.' || e.suffix || '.' AS text,
                   e.suffix = '' OR list_contains(s.given, e.prefix || '.' || e.suffix || '.') AS hit,
                   greatest(s.counts[e.g + 1], coalesce(TRY_CAST(regexp_extract(e.suffix, '^([0-9]+)([.]|$)', 1) AS BIGINT), 0)) AS base
            FROM steps s JOIN e ON e.doc_id = s.doc_id AND e.nth = s.nth + 1))))
    SELECT doc_id, pos, rel FROM steps WHERE nth > 0""",
)
def annex_numbers(spark, sf):
    """Orders as annex actions of customers: written numbers stand, the others take the next count of their group."""
    text = lambda c: c.cast("string")
    customer, k, g = F.col("o_custkey"), F.col("o_orderkey") * 7 % 101, F.floor(F.col("o_orderkey") / 3) % 2
    entries = table(spark, sf, "orders").select(
        customer.alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos"), text(g).alias("group"),
        F.when(customer % 3 == 0, "1.2").when(g == 0, "1").otherwise(F.concat(F.lit("1."), text(customer % 2 + 1))).alias("prefix"),
        F.when(k % 5 == 0, text(k % 4 + 1)).when(k % 5 == 1, F.concat(F.lit("2."), text(k % 3 + 1))).when(k % 5 == 2, "x").otherwise("").alias("suffix"),
    )
    return H.relative_numbers(entries)


@query(
    "standalone_paths",
    """
    WITH e AS (
      SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS pos, o_custkey % 5 > 0 AND k % 4 < 3 AS member,
             CASE k % 6 WHEN 1 THEN '1' WHEN 2 THEN '1.' || k % 3 WHEN 3 THEN '1.2.' || k % 4 WHEN 4 THEN '2.1.3.' || k % 2 WHEN 5 THEN '3' ELSE '' END AS g
      FROM (SELECT o_custkey, o_orderkey, o_orderkey * 7 % 101 AS k FROM orders)),
    m AS (SELECT doc_id, pos, g, regexp_extract(g, '^[^.]*(?:[.][^.]*)?') AS sup FROM e WHERE member AND g <> ''),
    sups AS (SELECT doc_id, sup, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS a FROM m GROUP BY doc_id, sup),
    subs AS (SELECT doc_id, sup, g, row_number() OVER (PARTITION BY doc_id, sup ORDER BY min(pos)) AS b FROM m WHERE g <> sup GROUP BY doc_id, sup, g),
    nths AS (SELECT x.doc_id, x.pos, count(*) AS n FROM m x JOIN m y ON y.doc_id = x.doc_id AND y.g = x.g AND y.pos <= x.pos GROUP BY x.doc_id, x.pos)
    SELECT e.doc_id, e.pos, a || '.' || coalesce(b || '.', '') || n || '.' AS path
    FROM e LEFT JOIN m USING (doc_id, pos) LEFT JOIN sups ON sups.doc_id = m.doc_id AND sups.sup = m.sup
    LEFT JOIN subs ON subs.doc_id = m.doc_id AND subs.sup = m.sup AND subs.g = m.g LEFT JOIN nths ON nths.doc_id = m.doc_id AND nths.pos = m.pos""",
)
def standalone_paths(spark, sf):
    """Orders as rows of annex files of customers: two-level groups, subgroups and actions by first appearance."""
    text = lambda c: c.cast("string")
    customer, k = F.col("o_custkey"), F.col("o_orderkey") * 7 % 101
    dotted = lambda lead, c: F.concat(F.lit(lead), text(c))
    base = table(spark, sf, "orders").select(
        customer.alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos"),
        (k % 4 < 3).alias("_exec"), (customer % 5 > 0).alias("b_standalone"),
        F.when(k % 6 == 1, "1").when(k % 6 == 2, dotted("1.", k % 3)).when(k % 6 == 3, dotted("1.2.", k % 4))
        .when(k % 6 == 4, dotted("2.1.3.", k % 2)).when(k % 6 == 5, "3").otherwise("").alias("_group"),
    )
    return H.standalone_annex_numbering(base).select("doc_id", "pos", F.col("f_rel").alias("path"))


@query(
    "cross_document_offset",
    """
    WITH s AS (SELECT o_orderkey AS doc_id, o_custkey % 4 AS n, o_custkey % 3 * (o_orderkey % 50) AS r,
                      CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey % 1000 ELSE 0 END AS a, o_custkey % 2 AS x FROM orders),
    p AS (SELECT *, sum(greatest(n, x)) OVER w AS big_n, greatest(a, CASE WHEN n > 0 THEN r + n ELSE 0 END) AS c FROM s
          WINDOW w AS (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT *, big_n + greatest(0, max(c - big_n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) AS peak FROM p)
    SELECT doc_id, CAST(coalesce(lag(peak) OVER (ORDER BY doc_id), 0) + 1 AS BIGINT) AS root FROM m""",
)
def cross_document_offset(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stats = table(spark, sf, "orders").select(
        k.alias("doc_id"), k.alias("doc_order"), (c % 4).alias("n"), (c % 3 * (k % 50)).alias("r"),
        F.when(k % 97 == 0, k % 1000).otherwise(0).alias("a"), (c % 2).alias("x"),
    )
    return H.cross_document_offset(stats).select("doc_id", "root")


@query(
    "operational_ancestor",
    """
    WITH p AS (SELECT l_orderkey % 1000 AS doc_id, l_partkey, l_suppkey, l_linenumber,
                      (l_partkey % 9 + 1) || '.' || (l_suppkey % 5) || '.' || l_linenumber AS section,
                      (l_partkey % 9 + 1) || '.' || (l_suppkey % 5) AS parent FROM lineitem),
    t AS (SELECT DISTINCT l_orderkey % 1000 AS doc_id, (l_partkey % 9 + 1) || '.' || (l_suppkey % 5) AS key FROM lineitem WHERE l_partkey % 4 = 0)
    SELECT p.doc_id, section, CASE WHEN t.key IS NOT NULL AND NOT ends_with(key, '.0') THEN parent ELSE section END AS ancestor, count(*) AS n
    FROM p LEFT JOIN t ON t.doc_id = p.doc_id AND t.key = p.parent GROUP BY ALL""",
)
def operational_ancestor(spark, sf):
    s = lambda c: c.cast("string")
    doc = (F.col("l_orderkey") % 1000).alias("doc_id")
    parent = F.concat(s(F.col("l_partkey") % 9 + 1), F.lit("."), s(F.col("l_suppkey") % 5))
    items = table(spark, sf, "lineitem")
    sections = items.select(doc, F.concat(parent, F.lit("."), s(F.col("l_linenumber"))).alias("section"))
    titles = items.where("l_partkey % 4 = 0").select(doc, parent.alias("key")).distinct().withColumn(
        "t_description", F.when(F.col("key").endswith(".0"), "- Procedimento").otherwise("Sistema")
    )
    return H.operational_ancestor(sections, titles).groupBy("doc_id", "section", "ancestor").agg(F.count(F.lit(1)).alias("n"))


@query(
    "merge_continuations",
    f"""WITH {LINES_SQL},
    r AS (SELECT doc_id, line_no AS block_no, CASE line_no % 4 WHEN 1 THEN 'Lista de documentos' WHEN 2 THEN '• ' || line ELSE line END AS description FROM lines WHERE line <> ''),
    n AS (SELECT *, lead(description) OVER w AS nxt, lag(description) OVER w AS prv FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY block_no))
    SELECT doc_id, block_no, CASE WHEN block_no % 4 = 1 AND starts_with(nxt, '• ') THEN 'Lista de documentos' || chr(10) || trim(nxt) ELSE description END AS description
    FROM n WHERE NOT (block_no % 4 = 2 AND coalesce(prv, '') = 'Lista de documentos')""",
)
def merge_continuations(spark, sf):
    k = F.col("block_no") % 4
    rows = line_blocks(spark, sf).select(
        "doc_id", "block_no", F.lit(1).alias("row_no"),
        F.when(k == 1, "Lista de documentos").when(k == 2, F.concat(F.lit("• "), F.col("text"))).otherwise(F.col("text")).alias("description"),
        F.lit(V.T_INFO).alias("task_type"),
    )
    return H.merge_continuations(rows).select("doc_id", "block_no", "description")
