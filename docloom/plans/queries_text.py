"""Queries over the given tables: sources, text columns, lines, typed lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import fixed_values as V
from docloom.functions import text as T
from docloom.operators import lines as L
from docloom.operators import typed as C
from docloom.plans.corpus import (
    LINES_SQL, MANUAL_LINES_SQL, documents, key_sql, lines, manual_documents, manual_lines, table,
)
from docloom.sources import intake, layout, markup, rulebook, tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- sources --------------------------------------------------------------------

@query("corpus_scan", "SELECT doc_id, doc_id AS doc_order, lang, length(text) AS n FROM documents")
def corpus_scan(spark, sf):
    return intake.corpus_scan(spark, f"{sf}/documents.parquet").select(
        "doc_id", "doc_order", "lang", F.length("text").alias("n")
    )


@query("dense_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS doc_order FROM part")
def dense_order(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey")
    return intake.dense_order(parts, "p_partkey").select("p_partkey", "doc_order")


_PAGE_SIGNATURES = ((".html", ("3C21444F4354595045",)), (".pdf", (V.MAGIC_PDF_HEX,)))


@query(
    "intake_validate",
    """
    WITH files AS (
      SELECT page_id, CASE WHEN page_id % 10 < 3 THEN 0 ELSE page_id END AS submission,
             concat('page_', page_id, CASE page_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.exe' ELSE '.html' END) AS filename,
             CASE WHEN page_id % 11 = 0 THEN 0 ELSE length(html) END AS size, html
      FROM pages),
    counted AS (SELECT *, count(*) OVER (PARTITION BY submission) AS n FROM files)
    SELECT page_id, CASE
      WHEN n > 20 THEN 'too_many_files' WHEN size > 9000 THEN 'too_large'
      WHEN NOT (filename LIKE '%.html' OR filename LIKE '%.pdf') THEN 'extension'
      WHEN size = 0 THEN 'empty'
      WHEN filename LIKE '%.html' AND html NOT LIKE '<!DOCTYPE%' THEN 'content_mismatch'
      WHEN filename LIKE '%.pdf' AND html NOT LIKE '\\%PDF-%' ESCAPE '\\' THEN 'content_mismatch'
      ELSE 'accepted' END AS outcome
    FROM counted""",
)
def intake_validate(spark, sf):
    k = F.col("page_id") % 7
    files = table(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 10 < 3, F.lit(0)).otherwise(F.col("page_id")).alias("submission"),
        F.concat(
            F.lit("page_"), F.col("page_id").cast("string"),
            F.when(k == 0, ".pdf").when(k == 1, ".exe").otherwise(".html"),
        ).alias("filename"),
        F.when(F.col("page_id") % 11 == 0, 0).otherwise(F.length("html")).alias("size"),
        F.substring("html", 1, 16).alias("head"),
    )
    good, bad = intake.intake_validate(files, max_bytes=9000, max_files=20, signatures=_PAGE_SIGNATURES)
    return good.select("page_id", F.lit("accepted").alias("outcome")).unionByName(
        bad.select("page_id", F.col("reason").alias("outcome"))
    )


# the twin walks a stream of tags and texts instead of rewriting the page step by step
_ENTITY_SQL = "MAP {" + ", ".join(f"'&{name};': {point}" for name, point in markup.ENTITIES.items()) + "}"
_PAGE_SQL = f"""
    cut AS (
      SELECT page_id, coalesce(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>'
        || '|<nav\\b.*?</nav\\s*>|<head\\b.*?</head\\s*>|<noscript\\b.*?</noscript\\s*>', ' ', 'g'), '') AS t, html FROM given),
    tokens AS (SELECT page_id, html, regexp_extract_all(t, '(?s)<[^>]*>|[^<]+|<') AS ts FROM cut),
    marked AS (
      SELECT page_id, html, array_to_string(list_transform(ts, lambda x: CASE
        WHEN regexp_full_match(x, '(?i)</(?:td|th)\\s*>') THEN chr(9)
        WHEN regexp_matches(x, '(?i)^</?(?:br|p|div|h[1-6]|li|ul|ol|tr|table|article|section|footer|header|body|html|blockquote|pre)\\b') AND x LIKE '%>' THEN chr(10)
        WHEN x LIKE '<%>' THEN '' ELSE regexp_replace(x, '[\\t\\r\\n]+', ' ', 'g') END), '') AS t FROM tokens),
    pieces AS (
      SELECT page_id, html, list_transform(regexp_extract_all(t, '&(?:#[0-9]{{1,9}}|#[xX][0-9a-fA-F]{{1,7}}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&'),
        lambda x: struct_pack(x := x, n := CASE WHEN regexp_matches(x, '^&#[0-9]+;') THEN try_cast(x[3:-2] AS INTEGER)
          WHEN regexp_matches(x, '^&#[xX]') THEN try_cast('0x' || x[4:-2] AS INTEGER) WHEN x LIKE '&%;' THEN {_ENTITY_SQL}[x] END)) AS ps FROM marked),
    body AS (
      SELECT page_id, html, array_to_string(list_transform(ps, lambda p: CASE WHEN p.n IS NULL THEN p.x WHEN p.n IN (9, 10, 13, 160) THEN ' '
        WHEN p.n < 32 OR p.n = 127 THEN CASE WHEN p.n = 0 THEN chr(65533) ELSE '' END
        WHEN p.n BETWEEN 55296 AND 57343 OR p.n > 1114111 THEN chr(65533) ELSE chr(p.n) END), '') AS t FROM pieces),
    parts AS (
      SELECT page_id, html, list_filter(list_transform(string_split(t, chr(10)), lambda x: array_to_string(
        list_filter(list_transform(string_split(x, chr(9)), lambda c: trim(regexp_replace(c, '[\\s]+', ' ', 'g'))), lambda c: c <> ''),
        chr(9))), lambda x: x <> '') AS ls FROM body)"""


@query(
    "page_text_extract",
    f"""WITH given AS (SELECT page_id, html FROM pages), {_PAGE_SQL}
    SELECT page_id, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no, unnest(ls) AS line FROM parts""",
)
def page_text_extract(spark, sf):
    return markup.page_text_extract(table(spark, sf, "pages"))


_DAMAGED_SQL = """
    given AS (
      SELECT page_id, CASE page_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' || chr(10) WHEN 2 THEN regexp_extract(html, '(?is)^.*?</nav>')
        WHEN 3 THEN '<p>&nbsp;&#' || page_id % 32 || ';</p>' WHEN 4 THEN '<p>caf&eacute; &#8217;&#x' || hex(19968 + page_id % 20000) || '; &amp;lt;</p>' || html
        ELSE html END AS html FROM pages)"""


def _damaged_pages(spark, sf):
    """Every page, most of them cut to what leaves no text, or opened by references."""
    key, html = F.col("page_id"), F.col("html")
    text = lambda c: c.cast("string")
    return table(spark, sf, "pages").select(
        "page_id",
        F.when(key % 6 == 0, F.lit(None).cast("string")).when(key % 6 == 1, " \n")
        .when(key % 6 == 2, F.regexp_extract(html, r"(?is)^.*?</nav>", 0))
        .when(key % 6 == 3, F.concat(F.lit("<p>&nbsp;&#"), text(key % 32), F.lit(";</p>")))
        .when(key % 6 == 4, F.concat(F.lit("<p>caf&eacute; &#8217;&#x"), F.hex(key % 20000 + 19968), F.lit("; &amp;lt;</p>"), html))
        .otherwise(html).alias("html"),
    )


@query(
    "page_text_rejected",
    f"""WITH {_DAMAGED_SQL}, {_PAGE_SQL}
    SELECT page_id, CASE WHEN trim(coalesce(html, ''), ' ' || chr(10)) = '' THEN 'no_content' ELSE 'no_text' END AS reason FROM parts WHERE len(ls) = 0""",
)
def page_text_rejected(spark, sf):
    return markup.page_text_rejected(_damaged_pages(spark, sf))


@query(
    "page_text_references",
    f"""WITH {_DAMAGED_SQL}, {_PAGE_SQL}
    SELECT page_id, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no, unnest(ls) AS line FROM parts""",
)
def page_text_references(spark, sf):
    """Lines of pages that name characters in every form."""
    return markup.page_text_extract(_damaged_pages(spark, sf))


@query(
    "layout_assemble",
    """
    WITH spans AS (
      SELECT l_orderkey % 500 AS doc_id, l_linenumber AS page,
             CAST(l_quantity * 10 AS DOUBLE) AS x0, CAST(l_partkey % 700 AS DOUBLE) AS y0,
             CAST(l_quantity * 10 + 40 AS DOUBLE) AS x1, CAST(l_partkey % 700 + 12 AS DOUBLE) AS y1,
             concat('s', l_orderkey, '-', l_linenumber) AS text FROM lineitem),
    boxes AS (
      SELECT p_partkey % 500 AS doc_id, p_size % 7 + 1 AS page,
             CAST(p_partkey % 200 AS DOUBLE) AS x0, CAST(p_partkey % 311 AS DOUBLE) AS y0,
             CAST(p_partkey % 200 + 250 AS DOUBLE) AS x1, CAST(p_partkey % 311 + p_size * 9 AS DOUBLE) AS y1,
             p_name AS text FROM part),
    tall AS (SELECT * FROM boxes WHERE y1 - y0 >= 40)
    SELECT doc_id, page, y0 AS y, x0 AS x, text FROM spans s WHERE NOT EXISTS (
      SELECT 1 FROM tall b WHERE b.doc_id = s.doc_id AND b.page = s.page
        AND (s.x0 + s.x1) / 2 BETWEEN b.x0 AND b.x1 AND (s.y0 + s.y1) / 2 BETWEEN b.y0 AND b.y1)
    UNION ALL SELECT doc_id, page, y0, x0, text FROM tall""",
)
def layout_assemble(spark, sf):
    d = lambda c: c.cast("double")
    q, p = F.col("l_quantity") * 10, F.col("l_partkey") % 700
    spans = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 500).alias("doc_id"), F.col("l_linenumber").alias("page"),
        d(q).alias("x0"), d(p).alias("y0"), d(q + 40).alias("x1"), d(p + 12).alias("y1"),
        F.concat(F.lit("s"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("text"),
    )
    k, s = F.col("p_partkey"), F.col("p_size")
    boxes = table(spark, sf, "part").select(
        (k % 500).alias("doc_id"), (s % 7 + 1).alias("page"), k.alias("box_id"),
        d(k % 200).alias("x0"), d(k % 311).alias("y0"), d(k % 200 + 250).alias("x1"),
        d(k % 311 + s * 9).alias("y1"), F.col("p_name").alias("text"),
    )
    return layout.layout_assemble(spans, boxes)


@query(
    "table_rows_to_lines",
    """
    SELECT p_partkey AS table_id, p_size AS row_no,
           '• ' || concat_ws(' | ', p_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END, p_type) AS line
    FROM part""",
)
def table_rows_to_lines(spark, sf):
    cells = table(spark, sf, "part").select(
        F.col("p_partkey").alias("table_id"), F.col("p_size").alias("row_no"),
        F.posexplode(
            F.array(
                F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "  ")),
                F.when(F.col("p_size") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")),
                F.lit("  "), F.col("p_type"),
            )
        ).alias("cell_no", "cell"),
    )
    return tables.table_rows_to_lines(cells)


@query(
    "step_table_fold",
    """
    WITH r AS (
      SELECT o_custkey AS table_id, o_orderkey AS row_no,
             CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS a,
             CASE WHEN o_orderkey % 3 = 0 THEN concat('lote ', o_orderstatus)
                  ELSE concat('Abrir a caixa ', o_orderstatus) END AS b
      FROM orders),
    i AS (SELECT *, sum(CASE WHEN a <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY row_no) AS isl,
                 bool_or(a <> '') OVER (PARTITION BY table_id) AS op FROM r),
    j AS (SELECT table_id, isl, min(row_no) AS row_no, max(a) AS a, bool_and(op) AS op, list(b ORDER BY row_no) AS bs, list(row_no ORDER BY row_no) AS ns
          FROM i GROUP BY table_id, isl)
    SELECT table_id, row_no, concat('PASSO ', a, ' | ', array_to_string(bs, ' ')) AS line FROM j WHERE a <> ''
    UNION ALL
    SELECT table_id, unnest(ns), concat('• ', unnest(bs), ' | O4') FROM j WHERE a = ''""",
)
def step_table_fold(spark, sf):
    n = F.col("o_orderkey")
    later = n % 3 == 0
    text = F.concat(F.when(later, "lote ").otherwise("Abrir a caixa "), F.col("o_orderstatus"))
    cells = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("table_id"), n.alias("row_no"),
        F.posexplode(F.array(F.when(later, "").otherwise(n.cast("string")), text, F.lit("O4"))).alias("cell_no", "cell"),
    )
    return tables.step_table_fold(cells).select("table_id", "row_no", "line")


@query(
    "load_rules",
    """
    SELECT n_nationkey AS rule_id, n_name AS name, n_regionkey AS ord, 'geral' AS scope, lower(n_name) AS pattern,
           'Informação' AS task_type, 'geral' AS category, n_name AS example_in, NULL AS example_out
    FROM nation WHERE n_nationkey % 2 = 0""",
)
def load_rules(spark, sf):
    source = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("rule_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("ord"),
        F.lit("geral").alias("scope"), F.lower("n_name").alias("pattern"), F.lit(V.T_INFO).alias("task_type"),
        F.lit("geral").alias("category"), F.col("n_name").alias("example_in"),
        F.lit(None).cast("string").alias("example_out"), (F.col("n_nationkey") % 2 == 0).alias("active"),
    )
    return rulebook.load_rules(spark, source)


@query(
    "insert_missing",
    """
    SELECT c_nationkey AS nation, c_name AS name FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT -1, c_name FROM customer WHERE c_custkey % 3 = 0""",
)
def insert_missing(spark, sf):
    customers = table(spark, sf, "customer")
    target = customers.where("c_custkey % 3 <> 0").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    seed = customers.select(F.lit(-1).cast(target.schema["nation"].dataType).alias("nation"), F.col("c_name").alias("name"))
    return rulebook.insert_missing(target, seed, "name")


# --- text columns ------------------------------------------------------------------

@query(
    "normalize_ws",
    f"""WITH {LINES_SQL}
    SELECT doc_id, line_no, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS tidy FROM lines""",
)
def normalize_ws(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", T.normalize_ws(F.col("line")).alias("tidy"))


@query(
    "cell_text",
    """
    SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
             lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS cell
    FROM documents""",
)
def cell_text(spark, sf):
    return documents(spark, sf).select("doc_id", T.cell_text(F.col("text")).alias("cell"))


@query("match_key", f"WITH {LINES_SQL} SELECT doc_id, line_no, {key_sql('line')} AS k FROM lines")
def match_key(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", T.match_key(F.col("line")).alias("k"))


@query(
    "token_key",
    """
    SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (
      SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+') AS t FROM documents)""",
)
def token_key(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.size(T.token_array(F.col("text"))).alias("n_tokens"),
        F.md5(T.token_key(F.col("text"))).alias("digest"),
    )


@query(
    "outline_number",
    f"""WITH {MANUAL_LINES_SQL},
    n AS (SELECT doc_id, line_no, line, regexp_extract(line, '^(\\d+(?:\\.\\d+){{0,5}})\\.?\\s+', 1) AS number FROM manual_lines)
    SELECT doc_id, line_no, number, CASE WHEN number = '' THEN 0 ELSE len(string_split(number, '.')) END AS level,
           trim(regexp_replace(line, '^\\d+(?:\\.\\d+){{0,5}}\\.?\\s+', '')) AS rest FROM n""",
)
def outline_number(spark, sf):
    line = F.col("line")
    return manual_lines(spark, sf).select(
        "doc_id", "line_no", T.outline_number(line).alias("number"),
        T.outline_level(T.outline_number(line)).alias("level"), T.outline_rest(line).alias("rest"),
    )


_TERMS = ("the", "contact", "licência", "mentre", "verbe", "que la", "ist", "on")


@query(
    "keyword_tags",
    f"""
    WITH k AS (SELECT doc_id, {key_sql('text')} AS k FROM documents)
    SELECT doc_id, array_to_string(list_filter([{', '.join(repr(t) for t in _TERMS)}],
           lambda t: contains(k, upper(strip_accents(t)))), ',') AS tags FROM k""",
)
def keyword_tags(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.array_join(T.keyword_tags(F.col("text"), _TERMS), ",").alias("tags")
    )


@query(
    "caps_ratio",
    f"""WITH {LINES_SQL}
    SELECT doc_id, line_no, CASE WHEN n > 0 THEN round(u / n, 6) END AS ratio FROM (
      SELECT doc_id, line_no, length(regexp_replace(line, '[^\\p{{Lu}}]', '', 'g')) AS u,
             length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) AS n FROM lines)""",
)
def caps_ratio(spark, sf):
    return lines(spark, sf).select("doc_id", "line_no", F.round(T.caps_ratio(F.col("line")), 6).alias("ratio"))


@query(
    "ui_fragment",
    f"""WITH {MANUAL_LINES_SQL},
    k AS (SELECT doc_id, line_no, line, {key_sql('line')} AS k FROM manual_lines),
    w AS (SELECT *, list_filter(string_split(k, ' '), lambda x: x <> '') AS words FROM k)
    SELECT doc_id, line_no,
      (k = '' OR regexp_full_match(k, '\\d+(?:\\s+\\d+){{0,3}}')
       OR k IN ({', '.join(repr(x) for x in V.UI_LABELS)}) OR regexp_matches(line, '^\\s*\\.:')
       OR (len(words) >= 4 AND len(list_filter(words, lambda x: length(x) = 1)) / len(words) >= 0.5)) AS ui
    FROM w""",
)
def ui_fragment(spark, sf):
    return manual_lines(spark, sf).select("doc_id", "line_no", T.ui_fragment(F.col("line")).alias("ui"))


@query(
    "heading_markup",
    f"""WITH {MANUAL_LINES_SQL}
    SELECT doc_id, line_no, CASE WHEN regexp_full_match(line, '{V.MARKDOWN_HEADING[1:-1]}') THEN '## ' || line ELSE line END AS line
    FROM manual_lines""",
)
def heading_markup(spark, sf):
    return manual_lines(spark, sf).select("doc_id", "line_no", T.heading_markup(F.col("line")).alias("line"))


@query(
    "annex_from_filename",
    """
    WITH f AS (SELECT page_id, CASE page_id % 4
        WHEN 0 THEN concat('Anexo ', chr(CAST(65 + page_id % 26 AS INTEGER)), page_id % 10, ' - ', url, '.pdf')
        WHEN 1 THEN concat('7_10 anexo b', ' - Título ', page_id, '.docx')
        WHEN 2 THEN concat('Manual ', page_id, '.pdf') ELSE concat('ANEXO C: ', page_id) END AS filename, url FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat(chr(CAST(65 + page_id % 26 AS INTEGER)), page_id % 10)
             WHEN 1 THEN 'B' WHEN 2 THEN '' ELSE 'C' END AS annex_id,
           CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('Título ', page_id) WHEN 2 THEN '' ELSE CAST(page_id AS VARCHAR) END AS title,
           CASE page_id % 4 WHEN 2 THEN '1.' WHEN 1 THEN 'Anexo B - 1.' WHEN 3 THEN '1.' ELSE '1.' END AS item
    FROM f""",
)
def annex_from_filename(spark, sf):
    k, page = F.col("page_id") % 4, F.col("page_id").cast("string")
    letter = F.char(65 + F.col("page_id") % 26)
    name = (
        F.when(k == 0, F.concat(F.lit("Anexo "), letter, (F.col("page_id") % 10).cast("string"), F.lit(" - "), F.col("url"), F.lit(".pdf")))
        .when(k == 1, F.concat(F.lit("7_10 anexo b - Título "), page, F.lit(".docx")))
        .when(k == 2, F.concat(F.lit("Manual "), page, F.lit(".pdf")))
        .otherwise(F.concat(F.lit("ANEXO C: "), page))
    )
    annex_id, title = T.annex_from_filename(F.col("filename"))
    scope = F.when(k == 1, "anexo_b").when(k == 2, "documento_principal").otherwise("anexo_arquivo_c")
    return table(spark, sf, "pages").withColumn("filename", name).select(
        "page_id", annex_id.alias("annex_id"), title.alias("title"), T.annex_item(F.lit("1."), scope).alias("item")
    )


@query(
    "document_code_header",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0
             THEN concat('PE-', 'ORD', '-', 10000 + o_orderkey % 80000, '-', o_custkey, '.00 - ', upper(o_orderstatus), ' TITULO')
             ELSE concat('Pedido ', o_orderkey) END AS header
    FROM orders""",
)
def document_code_header(spark, sf):
    s = lambda c: F.col(c).cast("string")
    code = F.concat(
        F.lit("PE-ORD-"), (10000 + F.col("o_orderkey") % 80000).cast("string"), F.lit(" – Versão "), s("o_custkey"),
        F.lit(".00 – Padrão Ativo "), F.upper("o_orderstatus"), F.lit(" TITULO"),
    )
    text = F.when(F.col("o_orderkey") % 2 == 0, code).otherwise(F.concat(F.lit("Pedido "), s("o_orderkey")))
    return table(spark, sf, "orders").select("o_orderkey", T.document_code_header(text).alias("header"))


@query(
    "suffix_item",
    """
    SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name || ' (' || p_size || '.)' WHEN 1 THEN p_name || ' (' || p_size || ')' ELSE p_name END AS task
    FROM part""",
)
def suffix_item(spark, sf):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" ("), size, F.lit(")"))).otherwise(F.col("p_name"))
    item = F.when(F.col("p_size") % 3 == 2, "").otherwise(F.concat(size, F.lit(".")))
    return table(spark, sf, "part").select("p_partkey", T.suffix_item(text, item).alias("task"))


@query(
    "join_visual_lines",
    f"""WITH {MANUAL_LINES_SQL},
    t AS (SELECT doc_id, line_no, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS x FROM manual_lines),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM t WHERE x <> '')
    SELECT doc_id, string_agg(CASE WHEN n = 1 THEN x WHEN regexp_matches(x, '{V.LIST_ITEM}') THEN chr(10) || x ELSE ' ' || x END, '' ORDER BY n) AS text
    FROM k GROUP BY doc_id""",
)
def join_visual_lines(spark, sf):
    return manual_documents(spark, sf).select("doc_id", T.join_visual_lines(T.split_lines(F.col("text"))).alias("text"))


# --- lines -------------------------------------------------------------------------

@query("split_lines", f"WITH {LINES_SQL} SELECT * FROM lines")
def split_lines(spark, sf):
    return L.split_lines(documents(spark, sf).select("doc_id", "text"))


@query(
    "clean_lines",
    f"""WITH {LINES_SQL},
    g AS (SELECT doc_id, line_no, CASE line_no % 4 WHEN 1 THEN chr(61692) WHEN 3 THEN chr(61692) || ' ' || line ELSE line || ' página 2 de 9' END AS line FROM lines),
    p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM g)
    SELECT doc_id, line_no, trim(regexp_replace(CASE
             WHEN starts_with(line, chr(61692)) THEN '• ' || trim(substr(line, 2))
             WHEN prev = chr(61692) THEN '• ' || line ELSE line END, ' página 2 de 9', '')) AS line
    FROM p WHERE line <> chr(61692)""",
)
def clean_lines(spark, sf):
    glyph, k = L.CHECK_GLYPH, F.pmod("line_no", F.lit(4))
    source = L.split_lines(documents(spark, sf).select("doc_id", "text")).withColumn(
        "line",
        F.when(k == 1, glyph).when(k == 3, F.concat(F.lit(glyph + " "), F.col("line")))
        .otherwise(F.concat("line", F.lit(" página 2 de 9"))),
    )
    return L.clean_lines(source)


@query(
    "drop_noise_lines",
    f"""WITH {MANUAL_LINES_SQL}
    SELECT doc_id, line_no, line FROM manual_lines
    WHERE NOT (line IN ('_', '.') OR {key_sql('line')} = 'INTERNA' OR regexp_matches(line, '(?i:licen[sc]e)|^ed |@'))
      OR line = ''""",
)
def drop_noise_lines(spark, sf):
    return L.drop_noise_lines(manual_lines(spark, sf), [r"(?i)licen[sc]e", "^ed ", "@"])


@query(
    "collapse_blank_lines",
    f"""WITH {LINES_SQL},
    b AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 OR line_no % 7 < 2 THEN '' ELSE line END AS line FROM lines),
    f AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev,
                 max(CASE WHEN line <> '' THEN line_no END) OVER (PARTITION BY doc_id) AS last_text FROM b)
    SELECT doc_id, line_no, line FROM f WHERE line <> '' OR (prev IS NOT NULL AND prev <> '' AND line_no < last_text)""",
)
def collapse_blank_lines(spark, sf):
    n = F.col("line_no")
    source = L.split_lines(documents(spark, sf).select("doc_id", "text"))
    return L.collapse_blank_lines(
        source.withColumn("line", F.when((n % 3 == 0) | (n % 7 < 2), "").otherwise(F.col("line")))
    )


_BOILERPLATE_SQL = f"""{LINES_SQL},
    keyed AS (SELECT doc_id, line_no, line, {key_sql('line')} AS line_key FROM lines),
    boiler AS (SELECT line_key, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines FROM keyed
               WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3)"""


@query("boilerplate_lines", f"WITH {_BOILERPLATE_SQL} SELECT line_key, n_docs, n_lines FROM boiler")
def boilerplate_lines(spark, sf):
    return L.boilerplate_keys(lines(spark, sf), 3)


@query(
    "drop_boilerplate",
    f"WITH {_BOILERPLATE_SQL} SELECT doc_id, line_no, line FROM keyed WHERE line_key NOT IN (SELECT line_key FROM boiler)",
)
def drop_boilerplate(spark, sf):
    return L.drop_boilerplate(lines(spark, sf), 3)


# --- typed lines ---------------------------------------------------------------------

_TYPED_SQL = f"""{MANUAL_LINES_SQL},
    headed AS (
      SELECT doc_id, 0 AS line_no, CASE doc_id % 4 WHEN 0 THEN 'ANEXO A' ELSE 'Anexo B' END AS line
      FROM documents WHERE doc_id % 4 IN (0, 1)
      UNION ALL SELECT doc_id, line_no, line FROM manual_lines WHERE doc_id % 4 <> 3
      UNION ALL SELECT doc_id, line_no, line FROM lines WHERE doc_id % 4 = 3),
    typed_lines AS MATERIALIZED (
      SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Anexo A' WHEN 1 THEN 'Anexo B' WHEN 2 THEN 'PE' ELSE 'Desconhecido' END AS document_type,
             CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS line_no, line, {key_sql('line')} AS k
      FROM (SELECT doc_id, line_no, trim(regexp_replace(line, '[ \\t]+', ' ', 'g')) AS line FROM headed) WHERE line <> '')"""


def typed_documents(spark, sf):
    """A quarter of the corpus each: flat annex, outline annex, sectioned, plain."""
    k = F.col("doc_id") % 4
    raw = documents(spark, sf).select("doc_id", F.col("text").alias("raw"))
    manual = manual_documents(spark, sf)
    return manual.join(raw, "doc_id").select(
        "doc_id", "doc_order", "filename",
        F.when(k == 0, F.concat(F.lit("ANEXO A\n"), F.col("text"))).when(k == 1, F.concat(F.lit("Anexo B\n"), F.col("text")))
        .when(k == 2, F.col("text")).otherwise(F.col("raw")).alias("text"),
    )


@query(
    "document_type",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Anexo A' WHEN 1 THEN 'Anexo B' WHEN 2 THEN 'PE' ELSE 'Desconhecido' END AS document_type FROM documents",
)
def document_type(spark, sf):
    return C.document_type(typed_documents(spark, sf)).select("doc_id", "document_type")


_SECTIONED_SQL = """
    ev AS (SELECT *, regexp_matches(line, '^(\\d+)\\.\\s*(OBJETIVO|APLICAÇÃO|DESCRIÇÃO|REGISTROS|DEFINIÇÕES)') AS heading,
                  contains(k, 'COMO FAZER') AS how, contains(k, 'PORQUE FAZER') AS why
           FROM typed_lines WHERE document_type = 'PE'),
    ca AS (SELECT *, last_value(CASE WHEN heading THEN line END IGNORE NULLS) OVER w AS sec,
                  last_value(CASE WHEN heading THEN 'Informação' WHEN how THEN 'Execução' WHEN why THEN 'Informação' END IGNORE NULLS) OVER w AS mode
           FROM ev WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
    sectioned AS MATERIALIZED (
      SELECT doc_id, document_type, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS block_order,
             CASE WHEN heading THEN 'Título' ELSE coalesce(mode, 'Informação') END AS block_type, line AS content,
             coalesce(sec, '') AS section, '' AS hierarchy,
             (NOT heading AND sec IS NULL AND length(line) > 300) AS needs_ai
      FROM ca WHERE heading OR (NOT how AND NOT why AND length(line) >= 3))"""
_OUTLINE_SQL = """
    nu AS (SELECT *, regexp_extract(line, '^(\\d+(?:\\.\\d+){0,5})\\.?\\s+', 1) AS h,
                  trim(regexp_replace(line, '^\\d+(?:\\.\\d+){0,5}\\.?\\s+', '')) AS rest FROM typed_lines WHERE document_type = 'Anexo B'),
    outlined AS (
      SELECT doc_id, document_type, line_no AS block_order,
             CASE WHEN regexp_matches(k, '^(?:OBS|OBSERVACAO|ATENCAO|LEMBRE-SE|LEMBRE SE)') THEN 'Informação'
                  WHEN h = '' THEN 'Execução' WHEN len(string_split(h, '.')) <= 2 THEN 'Título'
                  WHEN len(string_split(h, '.')) = 3 THEN 'Subtítulo' ELSE 'Execução' END AS block_type,
             CASE WHEN h = '' THEN line ELSE rest END AS content, '' AS section, h AS hierarchy,
             (h = '' AND length(line) > 350) AS needs_ai FROM nu)"""
_FLAT_SQL = """
    flat AS (
      SELECT doc_id, document_type, line_no AS block_order, 'Informação' AS block_type, line AS content, '' AS section,
             '' AS hierarchy, (document_type <> 'Anexo A' AND length(line) > 350) AS needs_ai
      FROM typed_lines WHERE document_type IN ('Anexo A', 'Desconhecido') AND length(line) >= 3)"""
_OUT = ("doc_id", "document_type", "block_order", "block_type", "content", "section", "hierarchy", "needs_ai")


def _of_type(spark, sf, kind):
    return C.document_type(typed_documents(spark, sf)).where(F.col("document_type") == kind)


@query("classify_sectioned", f"WITH {_TYPED_SQL}, {_SECTIONED_SQL} SELECT * FROM sectioned")
def classify_sectioned(spark, sf):
    return C.classify_sectioned(C.markdown_lines(_of_type(spark, sf, V.DOC_PE))).select(*_OUT)


@query("classify_outline", f"WITH {_TYPED_SQL}, {_OUTLINE_SQL} SELECT * FROM outlined")
def classify_outline(spark, sf):
    return C.classify_outline(C.markdown_lines(_of_type(spark, sf, V.DOC_ANNEX_B), exchange=False)).select(*_OUT)


@query("classify_flat", f"WITH {_TYPED_SQL}, {_FLAT_SQL} SELECT * FROM flat WHERE document_type = 'Anexo A'")
def classify_flat(spark, sf):
    return C.classify_flat(C.markdown_lines(_of_type(spark, sf, V.DOC_ANNEX_A), exchange=False)).select(*_OUT)


_ALL_TYPED_SQL = f"""WITH {_TYPED_SQL}, {_SECTIONED_SQL}, {_OUTLINE_SQL}, {_FLAT_SQL},
    everything AS MATERIALIZED (SELECT * FROM sectioned UNION ALL SELECT * FROM outlined UNION ALL SELECT * FROM flat)"""


@query("classify_documents", f"{_ALL_TYPED_SQL} SELECT * FROM everything")
def classify_documents(spark, sf):
    return C.classify_documents(typed_documents(spark, sf)).select(*_OUT)


@query(
    "apply_label_overrides",
    f"""{_ALL_TYPED_SQL},
    unsure AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_order) - 1 AS pos FROM everything WHERE needs_ai)
    SELECT doc_id, block_order, CASE WHEN l.doc_id IS NOT NULL AND pos = l.toxic AND l.quality = 1 THEN 'Título' ELSE block_type END AS block_type
    FROM unsure LEFT JOIN labels l USING (doc_id)
    UNION ALL SELECT doc_id, block_order, block_type FROM everything WHERE NOT needs_ai""",
)
def apply_label_overrides(spark, sf):
    labels = table(spark, sf, "labels").select(
        "doc_id", F.col("toxic").alias("position"), F.when(F.col("quality") == 1, "Título").otherwise("Outro").alias("label")
    )
    return C.apply_label_overrides(C.classify_documents(typed_documents(spark, sf)), labels).select(
        "doc_id", "block_order", "block_type"
    )
