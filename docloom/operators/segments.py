"""Lines to blocks: boundaries, fragment merging, table of contents, headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V
from docloom.functions import text as T
from docloom.operators.folding import cut_document

DOCUMENT_COLUMNS = ("doc_id", "doc_order", "filename", "annex_id", "annex_title", "standalone", "flowchart")


def annotate_documents(documents: DataFrame) -> DataFrame:
    """Add what the file name says: annex id and title, standalone annex, flowchart."""
    annex_id, title = T.annex_from_filename(F.col("filename"))
    named = documents.withColumn("annex_id", annex_id).withColumn("annex_title", title)
    standalone = F.col("annex_id") != ""
    return named.withColumn("standalone", standalone).withColumn(
        "flowchart", standalone & T.is_flowchart(F.col("filename"))
    )


def detect_scope(text: Column, line_key: Column | None = None) -> Column:
    """Scope a text opens.  ``line_key``: the key of its first line, where it is known."""

    def by_key(line: Column, key: Column, letter: Column) -> Column:
        table = F.regexp_extract(key, T.cs(r"^TABELA\s*(\d+)\b"), 1)
        return (
            F.when(letter != "", F.concat(F.lit("anexo_"), F.lower(letter)))
            .when(key.startswith("ANEXO"), F.lit("anexo"))
            .when(table.isin("2", "5"), F.concat(F.lit("tabela_"), table))
            .when(key.rlike("^(?:TABELA|QUADRO)"), F.lit("tabelas_tecnicas"))
            .when(text.rlike(T.cs(V.SECTION)), F.lit("documento_principal"))
            .otherwise(F.lit("geral"))
        )

    line = T.first_line(text)
    parts = F.struct(
        (T.match_key(line) if line_key is None else line_key).alias("key"), F.regexp_extract(T.strip(line), T.ci(V.ANNEX_HEADING), 1).alias("letter")
    )
    return T.let(parts, lambda p: by_key(line, p["key"], p["letter"]))


def is_procedure_marker(text: Column, key: Column | None = None) -> Column:
    key = T.match_key(text) if key is None else key
    return F.startswith(key, F.lit("PROCEDIMENTO")) & (T.rstrip_chars(key, ".") == "PROCEDIMENTO")


def segment_blocks(lines: DataFrame, max_chars: int = V.BLOCK_CHARS) -> DataFrame:
    """Group the lines of a document into blocks ``(…, block_no, lines)``.

    A block starts after a blank line, after a one-line block (title, table title,
    procedure marker) and at any line with a boundary shape; it is cut once its length
    reaches ``max_chars``.  Boundaries are windows; only blocks that are too long run the
    size fold, inside their own row.
    """
    carried = [c for c in DOCUMENT_COLUMNS if c in lines.columns]
    line, doc = F.col("line"), Window.partitionBy("doc_id").orderBy("line_no")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    standalone = F.col("standalone") if "standalone" in lines.columns else F.lit(False)
    flowchart = F.col("flowchart") if "flowchart" in lines.columns else F.lit(False)
    # of a key only the openings ANEXO, TABELA, QUADRO and PROCEDIMENTO count here
    key = F.when(T.key_cannot_open_with(line, "ATQP"), F.lit("")).otherwise(T.match_key(line))
    lines = lines.withColumn("_key", key)
    table_event = T.let(
        detect_scope(line, F.col("_key")),
        lambda s: F.when(s.isin("tabela_2", "tabela_5"), s).when(T.leaves_table(line), F.lit("")),
    )
    table_title = line.rlike(T.ci(V.TABLE_TITLE))
    marker = is_procedure_marker(line, F.col("_key"))
    shaped = lines.select(
        *carried, "line_no", "line",
        (T.strip(line) == "").alias("_blank"),
        F.last(table_event, True).over(upto).alias("_table"),
        (T.is_structural_title(line) | table_title | marker).alias("_closes"),
        (
            line.rlike(T.cs(V.SECTION)) | table_title | marker
            | (standalone & (line.rlike(T.cs(V.LIST_ITEM)) | line.rlike(T.cs(r"^\s*\d+\s*[-–—]\s*\S+"))))
            | line.rlike(T.ci(V.STEP_ROW)) | line.rlike(T.ci(V.STAGE_ROW))
            | line.rlike(T.ci(V.PROCESS_REFERENCE)) | line.rlike(T.ci(V.TECHNICAL_MARKER))
            | flowchart
        ).alias("_starts"),
    )
    activity = (F.col("_table") == "tabela_2") & line.rlike(T.cs(V.TABLE_ACTIVITY))
    opens = (
        F.col("_starts") | F.coalesce(activity, F.lit(False))
        | F.coalesce(F.lag("_blank").over(doc) | F.lag("_closes").over(doc), F.lit(True))
    )
    marked = shaped.select("*", opens.alias("_opens")).where(~F.col("_blank"))
    numbered = marked.select("*", F.sum(F.col("_opens").cast("int")).over(upto).alias("_seg"))
    blocks = numbered.groupBy("doc_id", "_seg").agg(
        *[F.first(c).alias(c) for c in carried if c != "doc_id"],
        F.transform(
            F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda e: e["line"]
        ).alias("_lines"),
    )
    cut = blocks.select("*", F.posexplode(_cut_long(F.col("_lines"), max_chars)).alias("_part", "lines"))
    order = Window.partitionBy("doc_id").orderBy("_seg", "_part")
    return cut.select(*carried, F.row_number().over(order).alias("block_no"), "lines")


def _cut_long(lines: Column, max_chars: int) -> Column:
    """One array of lines per piece; a piece ends with the line that reaches the limit."""
    total = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x) + 1)
    start = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("pos"), F.expr("array(1)").cast("array<int>").alias("starts")
    )

    def step(acc, x):
        size = acc["n"] + F.length(x) + 1
        full = size >= max_chars
        return F.struct(
            F.when(full, 0).otherwise(size).alias("n"),
            (acc["pos"] + 1).alias("pos"),
            F.when(full, F.array_append(acc["starts"], acc["pos"] + 2)).otherwise(acc["starts"]).alias("starts"),
        )

    starts = F.filter(F.aggregate(lines, start, step, lambda a: a["starts"]), lambda s: s <= F.size(lines))
    pieces = F.transform(
        starts, lambda s, i: F.slice(lines, s, F.coalesce(F.get(starts, i + 1), F.size(lines) + 1) - s)
    )
    return F.when(total < max_chars, F.array(lines)).otherwise(pieces)


def _edged(blocks: DataFrame) -> DataFrame:
    """Add the first and last line and what most rules ask of them, each worked out once a block."""
    lines = F.col("lines")
    ends = blocks.select(
        "*", T.normalize_ws(F.try_element_at(lines, F.lit(1))).alias("_first"),
        T.normalize_ws(F.try_element_at(lines, F.lit(-1))).alias("_last"),
    )
    first = F.col("_first")
    return ends.select(
        "*", first.rlike(T.cs(V.LIST_ITEM)).alias("_listed"), first.rlike(T.cs(V.SECTION)).alias("_section"),
        T.is_structural_title(first).alias("_title"),
        # the longest ending a rule asks for has five characters
        F.right("_last", F.lit(8)).alias("_end"), F.lower(F.right("_last", F.lit(8))).alias("_low"),
    )


def _edges() -> dict[str, Column]:
    """What the merge rules need to know about a block, from its first and last line."""
    lines, first, last, end, low = (F.col(c) for c in ("lines", "_first", "_last", "_end", "_low"))
    listed, section, title = F.col("_listed"), F.col("_section"), F.col("_title")
    visual = listed & ~section & ~title
    return {
        "size": F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x) + 1),
        "dotted": visual & first.rlike(r"\.{3,}"),
        "numbered": F.forall(lines, lambda x: T.normalize_ws(x).rlike(T.cs(V.NUMBERED_LIST_ITEM))),
        "visual": visual,
        "marker": F.substring(first, 1, 1),
        "group": first.rlike(T.ci(V.TECHNICAL_GROUP)),
        "parameter": first.rlike(T.ci(V.TECHNICAL_PARAMETER)),
        "list_first": listed & ~section,
        "title_first": title,
        # the block seen as what comes next
        "n_listed": listed,
        "n_section": section | (first == ""),
        "n_table": first.rlike(T.ci(V.TABLE_TITLE)),
        "n_lower": first.rlike(T.cs(r"^\p{Ll}")),
        "n_unit": F.upper(first).rlike(r"^(?:PSIG |KGF/|CM2 )"),
        # the block seen as what came before
        "l_empty": last == "",
        "l_prep": low.rlike(r" (?:na|no|à|ao|pela|pelo)$"),
        "l_and": low.rlike(r" (?:e|ou)$"),
        "l_action": last.rlike(T.ci(V.IMPERATIVE_CUE)),
        "l_hyphen": end.rlike(r"-$"),
        "l_pause": end.rlike(r"[,;]$"),
        "l_open_item": ~end.rlike(r"[.!?;]$"),
        "l_open": end.rlike(r"[,;:]$") | low.rlike(r" (?:e|ou)$") | ~end.rlike(r"[.!?]$"),
    }


def _continues(s: Column, d: Column) -> Column:
    """Does block ``d`` complete the sentence the group in state ``s`` left open?"""
    ready = ~s["l_empty"] & ~d["n_section"]
    heading = s["title_first"] & ~s["l_action"] & ~s["l_and"]
    sentence = (
        s["l_hyphen"]
        | (s["l_pause"] & d["n_lower"])
        | (s["list_first"] & ~d["n_listed"] & s["l_open_item"])
        | ((d["n_lower"] | d["n_unit"]) & s["l_open"])
    )
    return ready & F.when(d["n_table"], s["l_prep"]).otherwise(~heading & sentence)


_LAST = ("l_empty", "l_prep", "l_and", "l_action", "l_hyphen", "l_pause", "l_open_item", "l_open")


def merge_fragments(blocks: DataFrame, limit: int = V.LIST_CHARS) -> DataFrame:
    """Join neighbouring blocks that are one list, one table or one sentence.

    The rule in force is chosen by the block that opens a group: dotted checklist,
    numbered list, same-marker bullet list (not in standalone annexes), technical group,
    else open sentence.  List groups stop at ``limit`` characters.
    """
    edges = _edges()
    standalone = F.col("standalone") if "standalone" in blocks.columns else F.lit(False)
    kind = (
        F.when(edges["dotted"], 1)
        .when(edges["numbered"], 2)
        .when(~standalone & edges["visual"], 3)
        .when(edges["group"], 4)
        .otherwise(5)
    )
    descriptors = {**edges, "kind": kind}
    no = F.lit(False)
    initial = {
        "kind": F.lit(0), "total": F.lit(0), "marker": F.lit(""),
        "title_first": no, "list_first": no, **{n: no for n in _LAST},
    }

    def step(s: Column, d: Column):
        fits = s["total"] + d["size"] <= limit
        joins = (
            F.when(s["kind"] == 1, d["dotted"] & fits)
            .when(s["kind"] == 2, d["numbered"])
            .when(s["kind"] == 3, d["visual"] & (d["marker"] == s["marker"]) & fits)
            .when(s["kind"] == 4, ~d["group"] & (d["parameter"] | _continues(s, d)))
            .when(s["kind"] == 5, _continues(s, d))
            .otherwise(no)
        )
        pick = lambda name: F.when(joins, s[name]).otherwise(d[name])
        state = {
            "kind": pick("kind"),
            "total": F.when(joins, s["total"] + d["size"]).otherwise(d["size"]),
            "marker": pick("marker"),
            "title_first": pick("title_first"),
            "list_first": pick("list_first"),
            **{n: d[n] for n in _LAST},
        }
        return ~joins, state

    grouped = cut_document(_edged(blocks), "block_no", descriptors, initial, step, "_group", keep=blocks.columns)
    carried = [c for c in blocks.columns if c not in ("doc_id", "block_no", "lines")]
    return grouped.groupBy("doc_id", "_group").agg(
        *[F.first(c).alias(c) for c in carried],
        F.flatten(
            F.transform(
                F.sort_array(F.collect_list(F.struct("block_no", "lines"))), lambda e: e["lines"]
            )
        ).alias("lines"),
    ).withColumnRenamed("_group", "block_no").select(*blocks.columns)


def _renumber(blocks: DataFrame, *order: str) -> DataFrame:
    doc = Window.partitionBy("doc_id").orderBy(*order)
    return blocks.withColumn("block_no", F.row_number().over(doc))


def merge_document_header(blocks: DataFrame) -> DataFrame:
    """A document code followed by an all-caps line that is not a section: one block."""
    doc = Window.partitionBy("doc_id").orderBy("block_no")
    title = F.array_join(F.transform("_next", T.normalize_ws), " ")
    merges = (
        (F.col("_n") == 1)
        & F.col("_next").isNotNull()
        & T.normalize_ws(F.try_element_at("lines", F.lit(1))).rlike(T.ci(V.DOCUMENT_CODE))
        & (title != "") & ~title.rlike(T.cs(V.SECTION)) & (title == F.upper(title))
    )
    seen = blocks.select("*", F.lead("lines").over(doc).alias("_next"), F.row_number().over(doc).alias("_n"))
    flagged = seen.select("*", F.coalesce(merges, F.lit(False)).alias("_merges"))
    absorbed = F.coalesce(F.lag("_merges").over(doc), F.lit(False))
    out = (
        flagged.select("*", absorbed.alias("_absorbed"))
        .where(~F.col("_absorbed"))
        .withColumn("lines", F.when(F.col("_merges"), F.concat("lines", "_next")).otherwise(F.col("lines")))
    )
    return _renumber(out.select(*blocks.columns), "block_no")


def drop_leading_toc(blocks: DataFrame) -> DataFrame:
    """Remove the first run of three or more different section titles when any of them
    heads a block again further on."""
    doc = Window.partitionBy("doc_id").orderBy("block_no")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("doc_id")
    head = T.normalize_ws(F.try_element_at("lines", F.lit(1)))
    name = F.regexp_extract(head, T.cs(r"^\d+\.\s+(.+)$"), 1)
    base = blocks.select(
        "*", head.alias("_head"), ((F.size("lines") == 1) & name.isin(*V.TOC_TITLES)).alias("_toc")
    )
    started = base.select(
        "*", F.max(F.col("_toc").cast("int")).over(upto).alias("_on"),
    ).select("*", F.sum(((F.col("_on") == 1) & ~F.col("_toc")).cast("int")).over(upto).alias("_breaks"))
    in_run = (F.col("_on") == 1) & (F.col("_breaks") == 0)
    # a repeated title ends the run
    same = Window.partitionBy("doc_id", "_head").orderBy("block_no")
    ranked = started.select("*", in_run.alias("_run")).select(
        "*", F.sum(F.col("_run").cast("int")).over(same).alias("_seen")
    )
    cut = ranked.select(
        "*", F.max((F.col("_run") & (F.col("_seen") > 1)).cast("int")).over(upto).alias("_repeat")
    ).select("*", (F.col("_run") & (F.col("_repeat") == 0)).alias("_listed"))
    title_wide = Window.partitionBy("doc_id", "_head")
    known = cut.select(
        "*",
        F.max(F.when(F.col("_listed"), F.col("block_no"))).over(whole).alias("_end"),
        F.sum(F.col("_listed").cast("int")).over(whole).alias("_count"),
        F.max(F.col("_listed").cast("int")).over(title_wide).alias("_title"),
    ).select(
        "*",
        F.max(((F.col("_title") == 1) & (F.col("block_no") > F.col("_end"))).cast("int"))
        .over(whole).alias("_again"),
    )
    drop = F.col("_listed") & (F.col("_count") >= 3) & (F.coalesce("_again", F.lit(0)) == 1)
    return _renumber(known.where(~drop).select(*blocks.columns), "block_no")


def inject_annex_header(blocks: DataFrame) -> DataFrame:
    """Documents named as annexes open with an ``ANEXO X`` block.

    A first block that is an upper-case title, or repeats the title in the file name, is
    absorbed by it.
    """
    doc = Window.partitionBy("doc_id").orderBy("block_no")
    text = T.join_visual_lines(F.col("lines"))
    caps = F.coalesce(T.caps_ratio(text) >= V.CAPS_TITLE_RATIO, F.lit(False)) & ~text.rlike(T.cs(V.SECTION))
    same = (F.col("annex_title") != "") & (T.match_key(text) == T.match_key(F.col("annex_title")))
    title = F.when(caps, text).otherwise(F.col("annex_title"))
    header = F.concat(
        F.array(F.concat(F.lit("ANEXO "), F.col("annex_id"))),
        F.when(title != "", F.array(title)).otherwise(F.expr("array()").cast("array<string>")),
    )
    pieces = (
        F.when(~F.col("standalone") | (F.col("_n") > 1), F.array("lines"))
        .when(caps | same, F.array(header))
        .otherwise(F.array(header, F.col("lines")))
    )
    rest = [c for c in blocks.columns if c not in ("lines", "block_no")]
    out = blocks.select("*", F.row_number().over(doc).alias("_n")).select(
        *rest, "block_no", F.posexplode(pieces).alias("_p", "lines")
    )
    return _renumber(out, "block_no", "_p").select(*blocks.columns)


def build_blocks(lines: DataFrame) -> DataFrame:
    """Cleaned lines to final block boundaries."""
    return inject_annex_header(drop_leading_toc(merge_document_header(merge_fragments(segment_blocks(lines)))))
