"""Queries over structured documents derived from the corpus: blocks, context, full plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V
from docloom.operators import context as B
from docloom.operators import hierarchy as H
from docloom.operators import lines as L
from docloom.operators import rowgen as X
from docloom.operators import segments as S
from docloom.plans import matrix as plan
from docloom.plans.corpus import (
    LINES_SQL, MANUAL_LINES_SQL, documents, key_sql, manual_documents, table,
)
from docloom.plans.queries_rows import EXPIRING_SQL, as_status_events
from docloom.plans.queries_text import _OUT, _SECTIONED_SQL
from docloom.plans.staging import staging_dir, write_stage
from docloom.sources import rulebook
from docloom.streaming import status_stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def manuals(spark, sf):
    return S.annotate_documents(manual_documents(spark, sf))


def annexes(spark, sf):
    """Manuals filed as annexes of their own."""
    named = manual_documents(spark, sf).withColumn(
        "filename", F.concat(F.lit("Anexo A1 - Manual "), F.col("doc_id").cast("string"), F.lit(".pdf"))
    )
    return S.annotate_documents(named)


# --- boundaries ---------------------------------------------------------------------

_CLEAN_SQL = f"""{MANUAL_LINES_SQL},
    cleaned AS (
      SELECT doc_id, line_no, CASE WHEN line = 'Página 1 de 2' THEN '' ELSE trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) END AS line
      FROM manual_lines WHERE line <> 'INTERNA'),
    lagged AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev,
                      max(CASE WHEN line <> '' THEN line_no END) OVER (PARTITION BY doc_id) AS last_text FROM cleaned),
    ready AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS line_no, line FROM lagged
              WHERE line <> '' OR (prev IS NOT NULL AND prev <> '' AND line_no < last_text))"""


@query("clean_text_lines", f"WITH {_CLEAN_SQL} SELECT doc_id, line FROM ready")
def clean_text_lines(spark, sf):
    return L.clean_text_lines(manual_documents(spark, sf).select("doc_id", "text")).select("doc_id", "line")


_TITLE_SQL = "(regexp_full_match(line, '(?i)\\d+\\.\\s+(?:OBJETIVO|APLICAÇÃO|DESCRIÇÃO|REGISTROS|DEFINIÇÕES)') OR regexp_matches(line, '^\\d+\\.\\d+(?:\\.\\d+)*\\.?\\s*[-–—]\\s*\\S+'))"
_SEGMENT_SQL = f"""{_CLEAN_SQL},
    shaped AS (
      SELECT *, line = '' AS blank, {_TITLE_SQL} AS closes,
             (regexp_matches(line, '^(?:\\d+\\.|\\d+\\.\\d+(?:\\.\\d+){{0,6}}\\.?)\\s+(?:[-–—]\\s*)?.+')
              OR regexp_matches(line, '(?i)^(?:tabela\\s*\\d+|quadro\\s*\\d+|anexo\\s+[a-z])\\b')
              OR regexp_matches(line, '(?i)^(?:objetivo|aplicação|descrição|como fazer|porque fazer|registros|definições|recursos necessários|itens críticos)\\b')
              OR regexp_matches(line, '(?i)^N\\d+\\s*[-–—]\\s+')) AS starts
      FROM ready),
    opened AS (SELECT *, starts OR coalesce(lag(blank) OVER w OR lag(closes) OVER w, true) AS opens FROM shaped
               WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    segs AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seg FROM opened WHERE NOT blank),
    inner_lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seg ORDER BY line_no) AS i FROM segs),
    flush AS (
      SELECT doc_id, seg, i, line_no, length(line) + 1 AS n, 1 AS piece FROM inner_lines WHERE i = 1
      UNION ALL
      SELECT x.doc_id, x.seg, x.i, x.line_no, CASE WHEN f.n >= 6000 THEN 0 ELSE f.n END + length(x.line) + 1,
             CASE WHEN f.n >= 6000 THEN f.piece + 1 ELSE f.piece END
      FROM flush f JOIN inner_lines x ON x.doc_id = f.doc_id AND x.seg = f.seg AND x.i = f.i + 1),
    pieces AS (SELECT f.doc_id, seg, piece, list(r.line ORDER BY r.line_no) AS ls
               FROM flush f JOIN ready r ON r.doc_id = f.doc_id AND r.line_no = f.line_no GROUP BY ALL),
    blocks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seg, piece) AS INTEGER) AS block_no, ls AS lines FROM pieces)"""


@query("segment_blocks", f"WITH RECURSIVE {_SEGMENT_SQL} SELECT * FROM blocks")
def segment_blocks(spark, sf):
    return S.segment_blocks(L.clean_text_lines(manual_documents(spark, sf).select("doc_id", "text")))


#: the group's opening block sets the rule, so its kind, size and marker travel along a recursion over the blocks
_MERGE_SQL = f"""{_SEGMENT_SQL},
    ends AS (SELECT *, lines[1] AS line, lines[-1] AS l FROM blocks),
    seen AS (
      SELECT doc_id, block_no, lines, line,
             list_sum(list_transform(lines, lambda x: length(x) + 1)) AS size, left(line, 1) AS marker,
             regexp_matches(line, '{V.LIST_ITEM}') AS listed, regexp_matches(line, '{V.SECTION}') AS section, {_TITLE_SQL} AS title,
             len(list_filter(lines, lambda x: NOT regexp_matches(x, '{V.NUMBERED_LIST_ITEM}'))) = 0 AS numbered,
             regexp_matches(line, '(?i){V.TECHNICAL_GROUP.replace("'", "''")}') AS technical, regexp_matches(line, '(?i){V.TECHNICAL_PARAMETER}') AS parameter,
             regexp_matches(line, '(?i){V.TABLE_TITLE}') AS tabled, regexp_matches(line, '^\\p{{Ll}}') AS low,
             regexp_matches(upper(line), '^(?:PSIG |KGF/|CM2 )') AS unit, lag(l) OVER (PARTITION BY doc_id ORDER BY block_no) AS p
      FROM ends),
    told AS MATERIALIZED (
      SELECT *, listed AND NOT section AND NOT title AS visual, listed AND NOT section AS list_item,
             CASE WHEN listed AND NOT section AND NOT title AND contains(line, '...') THEN 1 WHEN numbered THEN 2
                  WHEN listed AND NOT section AND NOT title THEN 3 WHEN technical THEN 4 ELSE 5 END AS kind,
             p = '' OR section OR line = '' AS closed, regexp_matches(lower(p), ' (?:na|no|à|ao|pela|pelo)$') AS p_prep,
             regexp_matches(lower(p), ' (?:e|ou)$') AS p_and, regexp_matches(p, '(?i){V.IMPERATIVE_CUE}') AS p_action,
             right(p, 1) = '-' OR (right(p, 1) IN (',', ';') AND low)
               OR ((low OR unit) AND (right(p, 1) IN (',', ';', ':') OR regexp_matches(lower(p), ' (?:e|ou)$') OR right(p, 1) NOT IN ('.', '!', '?'))) AS runs_on,
             NOT listed AND right(p, 1) NOT IN ('.', '!', '?', ';') AS item_runs_on
      FROM seen),
    fold AS (
      SELECT doc_id, block_no, 1 AS grp, kind, CAST(size AS BIGINT) AS total, marker, title AS t0, list_item AS l0 FROM told WHERE block_no = 1
      UNION ALL
      SELECT doc_id, block_no, CASE WHEN joins THEN g ELSE g + 1 END, CASE WHEN joins THEN k ELSE kind END,
             CAST(CASE WHEN joins THEN total + size ELSE size END AS BIGINT), CASE WHEN joins THEN m ELSE marker END,
             CASE WHEN joins THEN t0 ELSE title END, CASE WHEN joins THEN l0 ELSE list_item END
      FROM (SELECT *, CASE k WHEN 1 THEN kind = 1 AND fits WHEN 2 THEN numbered WHEN 3 THEN visual AND marker = m AND fits
                             WHEN 4 THEN NOT technical AND (parameter OR continues) ELSE continues END AS joins
            FROM (SELECT d.*, f.grp AS g, f.kind AS k, f.total, f.marker AS m, f.t0, f.l0, f.total + d.size <= {V.LIST_CHARS} AS fits,
                         NOT closed AND CASE WHEN tabled THEN p_prep
                           ELSE (NOT f.t0 OR p_action OR p_and) AND (runs_on OR (f.l0 AND item_runs_on)) END AS continues
                  FROM fold f JOIN told d ON d.doc_id = f.doc_id AND d.block_no = f.block_no + 1))),
    merged AS (SELECT doc_id, CAST(grp AS INTEGER) AS block_no, flatten(list(b.lines ORDER BY b.block_no)) AS lines
               FROM fold f JOIN blocks b USING (doc_id, block_no) GROUP BY doc_id, grp)"""


@query("merge_fragments", f"WITH RECURSIVE {_MERGE_SQL} SELECT doc_id, block_no, array_to_string(lines, chr(10)) AS text FROM merged")
def merge_fragments(spark, sf):
    blocks = S.segment_blocks(L.clean_text_lines(manuals(spark, sf)))
    return S.merge_fragments(blocks).select("doc_id", "block_no", F.array_join("lines", "\n").alias("text"))


def _line_blocks(spark, sf):
    """Cleaned manual lines, one block each, with their documents' names."""
    cleaned = L.clean_text_lines(manuals(spark, sf)).where("line <> ''")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return cleaned.withColumn("block_no", F.row_number().over(order)).withColumn("lines", F.array("line")).drop("line", "line_no")


_LINE_BLOCKS_SQL = f"""{_CLEAN_SQL},
    lb AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS block_no, line FROM ready WHERE line <> '')"""


@query(
    "merge_document_header",
    f"""WITH {_LINE_BLOCKS_SQL},
    h AS (SELECT doc_id, 0 AS block_no, 'PE-ABC-00001 - V1' AS line FROM documents
          UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 3 = 0 THEN 'Manual geral' ELSE 'MANUAL GERAL' END FROM documents
          UNION ALL SELECT doc_id, block_no + 1, line FROM lb)
    SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN block_no + 1 WHEN block_no = 0 THEN 1 ELSE block_no END AS INTEGER) AS block_no,
           CASE WHEN doc_id % 3 <> 0 AND block_no = 0 THEN line || chr(10) || 'MANUAL GERAL' ELSE line END AS text
    FROM h WHERE NOT (doc_id % 3 <> 0 AND block_no = 1)""",
)
def merge_document_header(spark, sf):
    heads = documents(spark, sf).select(
        "doc_id",
        F.posexplode(
            F.array(F.lit("PE-ABC-00001 - V1"), F.when(F.col("doc_id") % 3 == 0, "Manual geral").otherwise("MANUAL GERAL"))
        ).alias("block_no", "line"),
    ).select("doc_id", "block_no", F.array("line").alias("lines"))
    body = _line_blocks(spark, sf).select("doc_id", (F.col("block_no") + 1).alias("block_no"), "lines")
    return S.merge_document_header(heads.unionByName(body)).select("doc_id", "block_no", F.array_join("lines", "\n").alias("text"))


@query(
    "drop_leading_toc",
    f"""WITH {_LINE_BLOCKS_SQL},
    h AS (SELECT doc_id, unnest([0, 1, 2]) AS block_no, unnest(['1. OBJETIVO', '2. REGISTROS', '3. DEFINIÇÕES']) AS line FROM documents
          UNION ALL SELECT doc_id, block_no + 3, line FROM lb WHERE NOT (doc_id % 2 = 0 AND line = '1. OBJETIVO')),
    again AS (SELECT DISTINCT doc_id FROM lb WHERE line = '1. OBJETIVO' AND doc_id % 2 = 1)
    SELECT doc_id, line FROM h WHERE NOT (block_no < 3 AND doc_id IN (SELECT doc_id FROM again))""",
)
def drop_leading_toc(spark, sf):
    toc = documents(spark, sf).select(
        "doc_id", F.posexplode(F.array(F.lit("1. OBJETIVO"), F.lit("2. REGISTROS"), F.lit("3. DEFINIÇÕES"))).alias("block_no", "line")
    ).select("doc_id", "block_no", F.array("line").alias("lines"))
    first = F.get("lines", F.lit(0))
    body = _line_blocks(spark, sf).where(~((F.col("doc_id") % 2 == 0) & (first == "1. OBJETIVO"))).select(
        "doc_id", (F.col("block_no") + 3).alias("block_no"), "lines"
    )
    return S.drop_leading_toc(toc.unionByName(body)).select("doc_id", F.get("lines", F.lit(0)).alias("line"))


@query(
    "inject_annex_header",
    f"""WITH {LINES_SQL},
    f AS (SELECT doc_id, line_no, CASE WHEN line_no = 1 AND doc_id % 3 = 0 THEN 'TITULO DO ANEXO' WHEN line_no = 1 AND doc_id % 3 = 1 THEN concat('manual ', doc_id) ELSE line END AS line
          FROM lines WHERE line <> ''),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n,
                 length(regexp_replace(line, '[^\\p{{Lu}}]', '', 'g')) >= 0.85 * length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) AS caps FROM f),
    t AS (SELECT doc_id, line, caps, caps OR doc_id % 3 < 2 AS absorbed FROM k WHERE n = 1)
    SELECT doc_id, CAST(1 AS INTEGER) AS block_no, 'ANEXO A1' || chr(10) || CASE WHEN caps THEN line ELSE concat('Manual ', doc_id) END AS text FROM t
    UNION ALL SELECT k.doc_id, CAST(CASE WHEN absorbed THEN n ELSE n + 1 END AS INTEGER), k.line FROM k JOIN t USING (doc_id) WHERE n > 1 OR NOT absorbed""",
)
def inject_annex_header(spark, sf):
    named = S.annotate_documents(
        documents(spark, sf).select(
            "doc_id", "text",
            F.concat(F.lit("Anexo A1 - Manual "), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"),
        )
    )
    k = F.col("doc_id") % 3
    first = F.col("line_no") == 1
    line = (
        F.when(first & (k == 0), "TITULO DO ANEXO")
        .when(first & (k == 1), F.concat(F.lit("manual "), F.col("doc_id").cast("string"))).otherwise(F.col("line"))
    )
    blocks = L.split_lines(named).where("line <> ''").select(
        "doc_id", "annex_id", "annex_title", "standalone", F.col("line_no").alias("block_no"), F.array(line).alias("lines")
    )
    return S.inject_annex_header(blocks).select("doc_id", "block_no", F.array_join("lines", "\n").alias("text"))


# --- context ------------------------------------------------------------------------

_ANNEX_BLOCKS_SQL = f"""{LINES_SQL},
    ab AS (SELECT doc_id, line_no AS block_no, CASE WHEN line_no % 7 = 3 THEN 'ANEXO ' || chr(CAST(65 + line_no % 4 AS INTEGER)) WHEN line_no % 11 = 5 THEN 'PE-ABC-00001' ELSE line END AS line
           FROM lines WHERE line <> '')"""


def _annex_blocks(spark, sf):
    n = F.col("line_no")
    return L.split_lines(documents(spark, sf).select("doc_id", "text")).where("line <> ''").select(
        "doc_id", n.alias("block_no"),
        F.when(n % 7 == 3, F.concat(F.lit("ANEXO "), F.char(65 + n % 4))).when(n % 11 == 5, "PE-ABC-00001").otherwise(F.col("line")).alias("line_1"),
    )


@query(
    "annex_segments",
    f"""WITH {_ANNEX_BLOCKS_SQL}
    SELECT doc_id, block_no, CAST(sum(CASE WHEN regexp_matches(line, '(?i)^ANEXO\\s+([A-Z]\\d*)\\b') THEN 1 ELSE 0 END)
      OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM ab""",
)
def annex_segments(spark, sf):
    return B.annex_segments(_annex_blocks(spark, sf)).select("doc_id", "block_no", "segment")


@query(
    "first_occurrence_heading",
    f"""WITH {_ANNEX_BLOCKS_SQL},
    c AS (SELECT *, CASE WHEN line LIKE 'ANEXO _' THEN 'anexo_documento' WHEN line = 'PE-ABC-00001' THEN 'padrao_documento' ELSE 'geral' END AS category FROM ab),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category, line ORDER BY block_no) AS nth FROM c)
    SELECT doc_id, block_no, CASE WHEN category = 'anexo_documento' AND nth > 1 THEN 'anexo_cabecalho_repetido'
             WHEN category = 'padrao_documento' AND block_no % 2 = 0 THEN 'cabecalho_documento_repetido' ELSE category END AS category FROM r""",
)
def first_occurrence_heading(spark, sf):
    line = F.col("line_1")
    blocks = _annex_blocks(spark, sf).select(
        "*",
        F.when(line.rlike("^ANEXO .$"), "anexo_documento").when(line == "PE-ABC-00001", "padrao_documento").otherwise("geral").alias("category"),
        F.when(F.col("block_no") % 2 == 0, "anexo_b").otherwise("documento_principal").alias("scope"),
    )
    return B.first_occurrence_heading(blocks).select("doc_id", "block_no", "category")


@query(
    "has_children",
    """
    WITH i AS (SELECT DISTINCT l_orderkey % 100 AS doc_id, l_linenumber % 2 AS segment,
                      concat_ws('.', l_partkey % 6 + 1, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % 20 END, CASE WHEN l_suppkey % 3 > 1 THEN l_linenumber END) AS item FROM lineitem)
    SELECT doc_id, segment, item, EXISTS (SELECT 1 FROM i j WHERE j.doc_id = i.doc_id AND j.segment = i.segment AND starts_with(j.item, i.item || '.')) AS has_children
    FROM i""",
)
def has_children(spark, sf):
    s = lambda c: c.cast("string")
    k = F.col("l_suppkey") % 3
    items = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 100).alias("doc_id"), (F.col("l_linenumber") % 2).alias("segment"),
        F.concat_ws(
            ".", s(F.col("l_partkey") % 6 + 1), F.when(k > 0, s(F.col("l_suppkey") % 20)), F.when(k > 1, s(F.col("l_linenumber")))
        ).alias("item"),
    ).distinct()
    return B.has_children(items, F.col("item")).select("doc_id", "segment", "item", "has_children")


_SCOPE_LINE_SQL = "CASE line_no % 9 WHEN 1 THEN 'Tabela 2 - x' WHEN 3 THEN '1. Atividade' WHEN 4 THEN '1.2 - Fora' WHEN 6 THEN 'Anexo C' WHEN 7 THEN '2. REGISTROS' WHEN 8 THEN 'Quadro 9' ELSE line END"


@query(
    "propagate_scope",
    f"""WITH {LINES_SQL},
    b AS (SELECT doc_id, line_no AS block_no, {_SCOPE_LINE_SQL} AS line FROM lines WHERE line <> ''),
    d AS (SELECT *, CASE WHEN line = 'Tabela 2 - x' THEN 'tabela_2' WHEN line = 'Anexo C' THEN 'anexo_c' WHEN line = 'Quadro 9' THEN 'tabelas_tecnicas' END AS explicit,
                 (line IN ('1. Atividade', '1.2 - Fora', '2. REGISTROS')) AS section, (line IN ('1.2 - Fora', '2. REGISTROS')) AS outside FROM b),
    i AS (SELECT *, count(explicit) OVER w AS island, coalesce(last_value(explicit IGNORE NULLS) OVER w, 'documento_principal') AS base FROM d
          WINDOW w AS (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING)),
    r AS (SELECT *, bool_or(CASE WHEN base = 'tabela_2' THEN outside WHEN starts_with(base, 'anexo') THEN false ELSE section END)
                      OVER (PARTITION BY doc_id, island ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS reset FROM i)
    SELECT doc_id, block_no, CASE WHEN reset THEN 'documento_principal' ELSE base END AS scope FROM r""",
)
def propagate_scope(spark, sf):
    k = F.col("line_no") % 9
    text = (
        F.when(k == 1, "Tabela 2 - x").when(k == 3, "1. Atividade").when(k == 4, "1.2 - Fora").when(k == 6, "Anexo C")
        .when(k == 7, "2. REGISTROS").when(k == 8, "Quadro 9").otherwise(F.col("line"))
    )
    blocks = L.split_lines(documents(spark, sf).select("doc_id", "text")).where("line <> ''").select(
        "doc_id", F.col("line_no").alias("block_no"), text.alias("text"), F.lit("").alias("annex_id"),
        F.lit(False).alias("standalone"), F.lit(False).alias("flowchart"),
    )
    return B.propagate_scope(blocks).select("doc_id", "block_no", "scope")


def _rx(pattern: str) -> str:
    return pattern.replace("'", "''")


def _category_sql() -> str:
    named = " ".join(f"WHEN starts_with(bare, '{p}') THEN '{c}'" for c, p in V.NAMED_CATEGORIES)
    return f"""CASE WHEN regexp_matches(k, '(?i){_rx(V.DOCUMENT_METADATA)}') THEN 'fragmento_interface'
      WHEN regexp_matches(line, '(?i){_rx(V.DOCUMENT_CODE)}') THEN 'padrao_documento'
      WHEN regexp_matches(line, '(?i){_rx(V.ANNEX_HEADING)}') THEN 'anexo_documento'
      WHEN regexp_matches(line, '(?i){_rx(V.TABLE_HEADER)}') THEN 'cabecalho_tabela'
      WHEN regexp_matches(line, '(?i){_rx(V.TABLE_TITLE)}') THEN 'titulo_tabela'
      WHEN regexp_matches(line, '(?i){_rx(V.NAMED_SECTION)}') THEN 'secao_principal'
      {named} WHEN regexp_matches(line, '^\\s*\\d+(?:\\.\\d+)+') THEN 'subsecao_numerada'
      WHEN starts_with(k, 'ATIVIDADE') THEN 'atividade_tabela'
      WHEN regexp_matches(line, '{_rx(V.SECTION)}') THEN 'secao_principal' ELSE 'geral' END"""


@query(
    "detect_category",
    f"""WITH {_LINE_BLOCKS_SQL},
    x AS (SELECT doc_id, block_no, line, {key_sql('line')} AS k FROM lb),
    y AS (SELECT *, regexp_replace(k, '^\\s*\\d+(?:\\.\\d+)*\\.?\\s*(?:[-–—]\\s*)?', '') AS bare FROM x)
    SELECT doc_id, block_no, {_category_sql()} AS category FROM y""",
)
def detect_category(spark, sf):
    return _line_blocks(spark, sf).select(
        "doc_id", "block_no", B.detect_category(F.get("lines", F.lit(0))).alias("category")
    )


@query(
    "action_flags",
    f"""WITH {LINES_SQL},
    t AS (SELECT doc_id, line_no, CASE line_no % 4 WHEN 0 THEN 'abrir ' || line WHEN 1 THEN 'deve-se isolar ' || line WHEN 2 THEN 'texto não deve isolar ' || line ELSE line END AS x FROM lines)
    SELECT doc_id, line_no, line_no % 4 IN (0, 1) AS explicit_actions, line_no % 4 <> 3 AS action_cue FROM t""",
)
def action_flags(spark, sf):
    k, line = F.col("line_no") % 4, F.col("line")
    text = (
        F.when(k == 0, F.concat(F.lit("abrir "), line)).when(k == 1, F.concat(F.lit("deve-se isolar "), line))
        .when(k == 2, F.concat(F.lit("texto não deve isolar "), line)).otherwise(line)
    )
    rows = L.map_lines(documents(spark, sf).select("doc_id", "text")).withColumn("text", text)
    return B.action_flags(rows).select("doc_id", "line_no", "explicit_actions", "action_cue")


@query("carry_section")
def carry_section(spark, sf):
    """The section in force before and after every block of the manuals."""
    described = B.has_children(B.annex_segments(B.block_text(S.build_blocks(L.clean_text_lines(manuals(spark, sf))))))
    owned = B._own_items(B._own_category(B.propagate_scope(described)))
    return B.carry_section(owned).select("doc_id", "block_no", "section_before", "section_ctx")


@query(
    "section_in_force",
    f"""
    WITH RECURSIVE src AS (
      SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS block_no, o_orderkey * 7 % 101 AS k,
             o_custkey % 3 = 0 AS standalone, o_custkey % 7 = 1 AS flowchart FROM orders),
    b AS (
      SELECT doc_id, block_no, standalone, k % 3 = 0 AS shaped, k % 13 = 0 AS instruction, k % 11 = 0 AS remission, k % 6 = 0 AS has_children, k * 2 AS size,
             k % 17 > 0 AND k % 19 > 0 AS unmarked, k % 8 = 0 AS explicit, k % 4 = 1 AS cue, k % 9 = 0 AS op_heading, k % 10 < 3 AND k % 2 = 0 AS triggers,
             k % 12 = 5 AS negative, flowchart, k % 4 = 2 AS note, k % 4 < 2 AS listing,
             CASE k % 5 WHEN 0 THEN 'subsecao_numerada' WHEN 1 THEN 'recursos_necessarios' WHEN 2 THEN 'geral' WHEN 3 THEN 'itens_criticos' ELSE 'item_numerado_anexo' END AS c0,
             CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '1.1' WHEN 3 THEN '1.1.' || (k % 2 + 1) WHEN 4 THEN '2' WHEN 5 THEN '2.' || k % 3 ELSE '3.4' END AS item
      FROM src),
    c1 AS (SELECT *, explicit OR (item <> '' AND NOT shaped AND cue) AS action,
                  CASE WHEN (explicit OR (item <> '' AND NOT shaped AND cue)) AND NOT op_heading AND c0 <> 'recursos_necessarios' THEN 'instrucao_operacional' ELSE c0 END AS c FROM b),
    c2 AS (SELECT * REPLACE (CASE WHEN negative THEN 'geral' WHEN standalone AND triggers THEN 'instrucao_operacional'
                                  WHEN standalone AND unmarked AND item IN ('1', '2') THEN 'subsecao_numerada' WHEN standalone AND remission THEN 'geral'
                                  WHEN standalone AND c = 'item_numerado_anexo' THEN CASE WHEN action THEN 'instrucao_operacional' ELSE 'subsecao_numerada' END
                                  ELSE c END AS c),
                  flowchart AND NOT negative AND NOT ((action AND NOT (standalone AND remission)) OR (standalone AND triggers)) AND NOT note AS idle FROM c1),
    told AS MATERIALIZED (
      SELECT doc_id, block_no, item, listing, size,
             unmarked AND item <> '' AND ((shaped AND NOT instruction AND c <> 'item_numerado_anexo' AND NOT remission) OR has_children) AS firm, standalone,
             unmarked AND item <> '' AND ((sub AND (size <= {V.TITLE_CHARS} OR (standalone AND size <= {V.ANNEX_TITLE_CHARS}))) OR c IN ('recursos_necessarios', 'itens_criticos')) AS soft, sub,
             standalone AND unmarked AND item <> '' AND len(string_split(item, '.')) > 2 AND NOT (explicit OR (NOT shaped AND cue)) AS detail
      FROM (SELECT *, c = 'subsecao_numerada' AND NOT idle AS sub FROM c2)),
    walk AS (
      SELECT doc_id, 0 AS block_no, '' AS was, '' AS section, false AS in_list FROM told WHERE block_no = 1
      UNION ALL
      SELECT doc_id, block_no, section, CASE WHEN takes THEN item ELSE section END, CASE WHEN takes THEN listing ELSE in_list END
      FROM (SELECT t.*, w.section, w.in_list,
                   firm OR (soft AND NOT ((sub AND w.in_list AND w.section <> '' AND starts_with(t.item, w.section || '.')) OR (detail AND w.section = '1.1'))) AS takes
            FROM walk w JOIN told t ON t.doc_id = w.doc_id AND t.block_no = w.block_no + 1))
    SELECT doc_id, block_no, was AS section_before, section AS section_ctx FROM walk WHERE block_no > 0""",
)
def section_in_force(spark, sf):
    """Orders as described blocks of customers: the section in force before and after each."""
    text = lambda c: c.cast("string")
    customer, k = F.col("o_custkey"), F.col("o_orderkey") * 7 % 101
    choice = lambda by, *values: F.coalesce(*[F.when(by == i, v) for i, v in enumerate(values)])
    marked = (k % 19 == 0) | (k % 17 == 0)
    item = choice(
        k % 7, F.lit(""), F.lit("1."), F.lit("1.1"), F.concat(F.lit("1.1."), text(k % 2 + 1)), F.lit("2"),
        F.concat(F.lit("2."), text(k % 3)), F.lit("3.4."),
    )
    flags = {
        "standalone": customer % 3 == 0, "flowchart": customer % 7 == 1, "has_children": k % 6 == 0, "_title_shape": k % 3 == 0,
        "_instruction": k % 13 == 0, "_remission": k % 11 == 0, "_explicit": k % 8 == 0, "_cue": k % 4 == 1, "_op_heading": k % 9 == 0,
        "_conditional": k % 10 < 3, "_imperative": k % 2 == 0, "_negative": k % 12 == 5,
    }
    blocks = table(spark, sf, "orders").select(
        customer.alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("block_no"),
        choice(k % 5, *map(F.lit, ("subsecao_numerada", "recursos_necessarios", "geral", "itens_criticos", "item_numerado_anexo"))).alias("category"),
        item.alias("_own_item"), F.when(marked, "").otherwise(item).alias("item_source"),
        F.when(k % 19 == 0, "a").otherwise("").alias("_letter"), F.when(k % 17 == 0, "3").otherwise("").alias("_step"),
        choice(k % 4, *map(F.lit, ("RECURSOS NECESSARIOS", "ITENS CRITICOS", "OBS", "OUTRA"))).alias("_key"),
        F.repeat(F.lit("x"), (k * 2).cast("int")).alias("text"), *[c.alias(n) for n, c in flags.items()],
    )
    return B.carry_section(blocks).select("doc_id", "block_no", "section_before", "section_ctx")


@query("classify_blocks")
def classify_blocks(spark, sf):
    return plan.document_blocks(manual_documents(spark, sf)).select(
        "doc_id", "block_no", "text", "item", "category", "scope", "section_ctx", "title_flag", "list_flag", "has_children"
    )


@query("classify_annex_blocks")
def classify_annex_blocks(spark, sf):
    """The same corpus filed as standalone annexes: local lists and annex rules."""
    named = annexes(spark, sf).select("doc_id", "doc_order", "filename", "text")
    return plan.document_blocks(named).select("doc_id", "block_no", "item", "category", "scope", "section_ctx", "title_flag")


def _numbered_list(spark, sf):
    """Annex procedures: a heading, a marker, then numbered and unnumbered steps."""
    n = F.col("line_no")
    k = n % 10
    number = (n % 4 + 1).cast("string")
    blocks = L.split_lines(documents(spark, sf).select("doc_id", "text")).where("line <> ''").select(
        "doc_id", n.alias("block_no"),
        F.when(k == 1, "2.2. CONTROLADOR").when(k == 2, "Procedimento.")
        .when(k % 3 == 0, F.concat(number, F.lit(". "), F.lower("line"))).otherwise(F.concat(F.lit("Abrir "), F.col("line"))).alias("text"),
        F.when(k == 1, "2.2.").when(k == 2, "").when(k % 3 == 0, F.concat(number, F.lit("."))).otherwise("").alias("item_source"),
    )
    return blocks.select(
        "*", F.lit("anexo_b").alias("scope"), F.lit("").alias("item"), F.lit("geral").alias("category"), F.lit(False).alias("title_flag"),
        F.lit("").alias("section_ctx"), F.lit(False).alias("single_action"), F.lit(False).alias("has_children"),
    )


@query(
    "local_list_numbering",
    f"""WITH RECURSIVE {LINES_SQL},
    b AS (SELECT doc_id, line_no, line_no % 10 AS k, CAST(line_no % 4 + 1 AS BIGINT) AS n, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM lines WHERE line <> ''),
    walk AS (
      SELECT doc_id, i, line_no, k, k IN (1) AS headed, false AS inproc, CAST(0 AS BIGINT) AS c, '' AS item FROM b WHERE i = 1
      UNION ALL
      SELECT b.doc_id, b.i, b.line_no, b.k, w.headed OR b.k = 1,
             CASE WHEN b.k = 1 THEN false WHEN b.k = 2 AND w.headed THEN true ELSE w.inproc END,
             CASE WHEN b.k = 1 OR (b.k = 2 AND w.headed) THEN 0 WHEN NOT w.inproc THEN w.c WHEN b.k % 3 = 0 THEN greatest(w.c, b.n) ELSE w.c + 1 END,
             CASE WHEN b.k IN (1, 2) OR NOT w.inproc THEN '' WHEN b.k % 3 = 0 THEN 'Anexo B - 2.2.(' || b.n || '.)' ELSE 'Anexo B - 2.2.(' || (w.c + 1) || '.)' END
      FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.i = w.i + 1)
    SELECT doc_id, line_no AS block_no, item FROM walk""",
)
def local_list_numbering(spark, sf):
    return B.local_list_numbering(_numbered_list(spark, sf)).select("doc_id", "block_no", "item")


@query(
    "mark_trailing_fragments",
    f"""WITH {LINES_SQL},
    b AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 > 0 THEN '1 2 3' ELSE line END AS text, CASE WHEN line_no % 20 = 4 THEN 'cabecalho_documento_repetido' ELSE 'geral' END AS category FROM lines WHERE line <> ''),
    f AS (SELECT *, max(CASE WHEN category <> 'geral' THEN line_no END) OVER (PARTITION BY doc_id) AS start FROM b),
    t AS (SELECT *, text = '1 2 3' AS ui, coalesce(line_no >= start, false) AS tail FROM f),
    c AS (SELECT *, sum(CASE WHEN tail THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS n, sum(CASE WHEN tail AND ui THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS u FROM t)
    SELECT doc_id, line_no AS block_no, CASE WHEN tail AND n >= 5 AND u / n >= 0.5 THEN 'fragmento_interface' ELSE category END AS category FROM c""",
)
def mark_trailing_fragments(spark, sf):
    n = F.col("line_no")
    blocks = L.split_lines(documents(spark, sf).select("doc_id", "text")).where("line <> ''").select(
        "doc_id", n.alias("block_no"), F.when(n % 3 > 0, "1 2 3").otherwise(F.col("line")).alias("text"),
        F.when(n % 20 == 4, "cabecalho_documento_repetido").otherwise("geral").alias("category"),
        F.lit("").alias("item"), F.lit(False).alias("title_flag"),
    )
    return B.mark_trailing_fragments(blocks).select("doc_id", "block_no", "category")


# --- rows and plans -----------------------------------------------------------------

def _staged_blocks(spark, sf):
    return write_stage(plan.document_blocks(manual_documents(spark, sf)), "blocks")


@query("block_to_rows")
def block_to_rows(spark, sf):
    return X.block_to_rows(_staged_blocks(spark, sf))


@query("annex_numbering")
def annex_numbering(spark, sf):
    """In-document annexes: every manual opens with an annex heading."""
    opened = manual_documents(spark, sf).withColumn("text", F.concat(F.lit("ANEXO B\n"), F.col("text")))
    blocks = write_stage(plan.document_blocks(opened), "annex-blocks")
    rows = write_stage(X.block_to_rows(H.block_info(blocks), tuple(H.BLOCK_INFO.values())), "annex-rows")
    return H.number_documents(rows, 1).select("doc_id", "block_no", "row_no", "task_type", "item", "hta")


@query("standalone_annex_numbering")
def standalone_annex_numbering(spark, sf):
    named = annexes(spark, sf).select("doc_id", "doc_order", "filename", "text")
    blocks = write_stage(plan.document_blocks(named), "file-blocks")
    rows = write_stage(X.block_to_rows(H.block_info(blocks), tuple(H.BLOCK_INFO.values())), "file-rows")
    return H.number_documents(rows, 1).select("doc_id", "block_no", "row_no", "task_type", "item", "hta")


@query("matrix")
def matrix(spark, sf):
    """The whole path: documents to numbered, deduplicated matrix rows with ids."""
    rules = rulebook.usable_rules(rulebook.load_rules(spark, rulebook.seed_rules(spark)))
    return plan.matrix(manual_documents(spark, sf), rules)


@query(
    "typed_corpus",
    f"""WITH {MANUAL_LINES_SQL},
    typed_lines AS (
      SELECT doc_id, 'PE' AS document_type, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS line_no, line, {key_sql('line')} AS k
      FROM (SELECT doc_id, line_no, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS line FROM manual_lines) WHERE line <> ''),
    {_SECTIONED_SQL} SELECT * FROM sectioned""",
)
def typed_corpus(spark, sf):
    return plan.typed_corpus(manual_documents(spark, sf)).select(*_OUT)


@query(
    "live_status",
    f"""WITH {EXPIRING_SQL}
    SELECT id, expired, CASE WHEN NOT expired THEN status END AS status, CASE WHEN NOT expired THEN stage END AS stage,
           CASE WHEN NOT expired THEN done END AS done, CASE WHEN NOT expired THEN total END AS total,
           CASE WHEN NOT expired THEN percent END AS percent, updated_at
    FROM (SELECT *, id IN (SELECT id FROM broken) OR updated_at + INTERVAL 1 DAY < (SELECT max(event_ts) FROM ev) - INTERVAL 10 MINUTE AS expired
          FROM status)""",
)
def live_status(spark, sf):
    """Event stream to job states, those without events for a day expired by a timer; equals a batch fold."""
    schema = table(spark, sf, "events").schema
    events = as_status_events(status_stream.read_events(spark, sf, schema, "events.parquet"))
    import uuid

    base = f"{staging_dir(spark)}/status-{uuid.uuid4().hex}"
    status_stream.merge_status(status_stream.live_status(events, "1 day"), f"{base}/table", f"{base}/log").awaitTermination()
    return status_stream.newest_status(spark.read.parquet(f"{base}/table")).drop("message")


@query("closed_sessions")
def closed_sessions(spark, sf):
    """Expired jobs from the stream, appended to a table under watermark."""
    schema = table(spark, sf, "events").schema
    stream = status_stream.read_events(spark, sf, schema, "events.parquet").select(
        F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("event_ts"),
        F.col("event_type").alias("kind"), F.col("event_type").alias("stage"),
    )
    import uuid

    base = f"{staging_dir(spark)}/sessions-{uuid.uuid4().hex}"
    status_stream.start_table(status_stream.closed_sessions(stream), f"{base}/table", f"{base}/log").awaitTermination()
    return spark.read.parquet(f"{base}/table")

