"""Block context: scope, category, section in force, local numbering.

Each step adds columns with windows over one document; the one order-dependent decision
that windows cannot make (which headings take over as the current section) is a fold in
``carry_section``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V
from docloom.functions import text as T
from docloom.operators.folding import cut_document
from docloom.operators.segments import detect_scope, is_procedure_marker

LIST_CONTEXTS = ("RECURSOS NECESSARIOS", "ITENS CRITICOS", "PREMISSAS")


def _upto():
    return Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)


def _before():
    return Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)


def _whole():
    return Window.partitionBy("doc_id")


def _no(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def _any_of(col: Column, terms: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(col, F.lit(t)) for t in terms])


def block_text(blocks: DataFrame) -> DataFrame:
    """Add ``text`` and ``line_1``; blocks without text go, block numbers stay."""
    text = T.join_visual_lines(F.col("lines"))
    # exploding drops empty texts; a filter would join the lines a second time
    joined = F.explode(T.let(text, lambda x: F.when(x != "", F.array(x)))).alias("text")
    return blocks.select("*", joined, F.try_element_at("lines", F.lit(1)).alias("line_1"))


def annex_segments(blocks: DataFrame, line: str = "line_1") -> DataFrame:
    """Add ``segment``: annex headings seen so far in the document."""
    heading = T.normalize_ws(F.col(line)).rlike(T.ci(V.ANNEX_HEADING))
    return blocks.withColumn("segment", F.sum(heading.cast("int")).over(_upto()))


def has_children(blocks: DataFrame, number: Column | None = None) -> DataFrame:
    """Add ``has_children``: another item of the segment starts with this item and a dot.

    Sorted as ``item.``, all descendants of an item follow it directly, so looking at
    the next item replaces a quadratic prefix join.
    """
    number = T.numbered_item(F.col("line_1")) if number is None else number
    key = F.when(number != "", F.concat(number, F.lit(".")))
    near = Window.partitionBy("doc_id", "segment").orderBy("_item")
    same = Window.partitionBy("doc_id", "segment", "_item")
    ahead = blocks.withColumn("_item", key).withColumn("_next", F.lead("_item").over(near))
    child = (F.col("_next") != F.col("_item")) & F.startswith(F.col("_next"), F.col("_item"))
    return (
        ahead.withColumn("has_children", F.coalesce(F.max(_no(child)).over(same), F.lit(False)) & F.col("_item").isNotNull())
        .drop("_item", "_next")
    )


def propagate_scope(blocks: DataFrame) -> DataFrame:
    """Add ``scope``: the explicit scope in force, or the document body after a reset.

    Every explicit scope opens an island.  Annexes never reset; tables 2 and 5 reset at
    the first section that lies outside the table; anything else at any section.
    """
    found = F.col("_found")
    explicit = found.isin("anexo", "tabela_2", "tabela_5", "tabelas_tecnicas") | found.startswith("anexo_")
    seen = blocks.withColumn("_found", detect_scope(F.col("text"))).select("*", explicit.alias("_explicit"))
    island = seen.select(
        "*",
        F.sum(F.col("_explicit").cast("int")).over(_upto()).alias("_island"),
        F.coalesce(
            F.last(F.when(F.col("_explicit"), F.col("_found")), True).over(_upto()), F.lit("documento_principal")
        ).alias("_base"),
    )
    reset = (F.col("_found") == "documento_principal") & (
        F.when(F.col("_base").startswith("anexo"), F.lit(False))
        .when(F.col("_base").startswith("tabela_"), T.leaves_table(T.first_line(F.col("text"))))
        .otherwise(F.lit(True))
    )
    inside = Window.partitionBy("doc_id", "_island").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = island.withColumn("_reset", F.max(reset.cast("int")).over(inside))
    letter = F.lower(F.col("annex_id"))
    scope = (
        F.when(F.col("flowchart"), F.concat(F.lit("anexo_fluxograma_"), letter))
        .when(F.col("standalone"), F.concat(F.lit("anexo_arquivo_"), letter))
        .when(F.col("_reset") == 1, F.lit("documento_principal"))
        .otherwise(F.col("_base"))
    )
    return carried.withColumn("scope", scope).drop("_found", "_explicit", "_island", "_base", "_reset")


def detect_category(text: Column, key: Column | None = None) -> Column:
    """Ordered first-match category of a block by its own text.  ``key``: the text's key, where it is known."""
    return T.let(
        F.struct((T.match_key(text) if key is None else key).alias("key"), T.first_line(text).alias("line")),
        lambda p: _category_of(text, p["key"], p["line"]),
    )


def _category_of(text: Column, key: Column, line: Column) -> Column:
    has_all = lambda *terms: reduce(and_, [F.contains(key, F.lit(t)) for t in terms])
    table = text.rlike(T.ci(V.TABLE_TITLE))

    def named(bare: Column) -> Column:
        (category, prefix), *rest = V.NAMED_CATEGORIES
        out = F.when(bare.startswith(prefix), category)
        for category, prefix in rest:
            out = out.when(bare.startswith(prefix), category)
        return out

    bare = F.regexp_replace(key, T.cs(r"^\s*\d+(?:\.\d+)*\.?\s*(?:[-–—]\s*)?"), "")
    own = (
        F.when(key.rlike(T.ci(V.DOCUMENT_METADATA)), "fragmento_interface")
        .when(line.rlike(T.ci(V.DOCUMENT_CODE)), "padrao_documento")
        .when(T.strip(line).rlike(T.ci(V.ANNEX_HEADING)), "anexo_documento")
        .when(
            line.rlike(T.ci(V.TABLE_HEADER))
            | has_all("O QUE FAZER", "EXECUTANTE", "ONDE REGISTRAR")
            | has_all("ATIVIDADE", "ASPECTO/PERIGO", "ACOES DE CONTROLE")
            | (key == "QUEM O QUE"),
            "cabecalho_tabela",
        )
        .when(key.rlike(T.cs(V.FIGURE_DETAIL)), "titulo_tabela")
        .when(table, F.when(has_all("INDICADOR DE DESEMPENHO"), "geral").otherwise("titulo_tabela"))
        .when(T.is_named_section(line), "secao_principal")
    )
    late = (
        F.when(text.rlike(T.cs(r"^\s*\d+(?:\.\d+)+")), "subsecao_numerada")
        .when(key.startswith("ATIVIDADE"), "atividade_tabela")
        .when(text.rlike(T.cs(V.SECTION)), "secao_principal")
        .otherwise("geral")
    )
    return F.coalesce(own, T.let(bare, named), late)


def first_occurrence_heading(blocks: DataFrame, category: str = "category") -> DataFrame:
    """Later copies of an annex heading, and document codes inside annexes, are repeats."""
    cat = F.col(category)
    heading = F.when(cat == "anexo_documento", F.upper(T.normalize_ws(F.col("line_1"))))
    same = Window.partitionBy("doc_id", "_heading").orderBy("block_no")
    ranked = blocks.withColumn("_heading", heading).withColumn("_nth", F.row_number().over(same))
    return ranked.withColumn(
        category,
        F.when((cat == "anexo_documento") & (F.col("_nth") > 1), F.lit("anexo_cabecalho_repetido"))
        .when((cat == "padrao_documento") & F.col("scope").startswith("anexo_"), F.lit("cabecalho_documento_repetido"))
        .otherwise(cat),
    ).drop("_heading", "_nth")


# --- action flags -------------------------------------------------------------

def explicit_actions(text: Column) -> Column:
    """Opens with an action verb, or holds two action cues once negations are gone."""

    def stated(plain: Column) -> Column:
        return (
            plain.rlike(T.ci(V.ACTION_START))
            | (F.regexp_count(plain, F.lit(T.ci(V.ACTION_CUE))) >= 2)
            | T.match_key(plain).rlike("DEVE-SE SEGUIR|RECOMENDA-SE COLETAR")
        )

    return T.let(F.regexp_replace(text, T.ci(V.NEGATED_MODAL), ""), stated)


def has_action_cue(text: Column) -> Column:
    return F.regexp_replace(text, T.ci(V.NEGATED_MODAL), "").rlike(T.ci(V.ACTION_CUE))


def _action_tests(text: Column, key: Column) -> Column:
    """``explicit_actions`` and ``has_action_cue`` in one pass; ``key`` is the text's key."""

    def tests(plain: Column) -> Column:
        plain_key = F.when(plain == text, key).otherwise(T.match_key(plain))
        cues = F.regexp_count(plain, F.lit(T.ci(V.ACTION_CUE)))
        stated = plain.rlike(T.ci(V.ACTION_START)) | _any_of(plain_key, ("DEVE-SE SEGUIR", "RECOMENDA-SE COLETAR"))
        return T.let(cues, lambda n: F.struct(((n >= 2) | stated).alias("explicit"), (n >= 1).alias("cue")))

    return T.let(F.regexp_replace(text, T.ci(V.NEGATED_MODAL), ""), tests)


def action_flags(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("explicit_actions", explicit_actions(F.col("text"))).withColumn(
        "action_cue", has_action_cue(F.col("text"))
    )


def numbered_instruction(line: Column, children: Column, summary: Column) -> Column:
    """A numbered line that is a step to carry out rather than a heading."""
    parts = F.struct(T.numbered_item(line).alias("number"), T.numbered_content(line).alias("rest"))
    return T.let(
        parts,
        lambda p: (p["number"] != "") & ~children & ~summary & (p["rest"] != "")
        & (p["rest"] != F.upper(p["rest"])) & ~line.rlike(T.ci(V.ANNEX_OPERATIONAL_HEADING))
        & ((T.item_depth(p["number"]) == 1) | p["rest"].rlike(T.ci(V.IMPERATIVE_CUE))),
    )


# --- categories before the section in force is known ---------------------------

def _own_category(blocks: DataFrame) -> DataFrame:
    """Category from the block itself plus stage, main section and scope."""
    text, line, scope = F.col("text"), F.col("line_1"), F.col("scope")
    blocks = blocks.withColumn("_key", T.match_key(text))
    stage = F.regexp_extract(text, T.ci(V.STAGE_ROW), 1)
    step = F.regexp_extract(text, T.ci(V.STEP_ROW), 1)
    base = blocks.select(
        "*",
        F.when(stage != "", stage.cast("int")).alias("_stage"),
        step.alias("_step"),
        detect_category(text, F.col("_key")).alias("_detected"),
        T.numbered_item(line).alias("_number"),
        F.forall("lines", lambda x: T.normalize_ws(x).rlike(T.ci(V.RESPONSIBLE_CELL))).alias("_cells"),
    ).withColumn("stage_no", F.coalesce(F.last("_stage", True).over(_upto()), F.lit(0)))
    category = (
        F.when(F.col("_stage").isNotNull(), "etapa_operacional")
        .when(F.col("_step") != "", "passo_tabela_operacional")
        .when((F.col("stage_no") > 0) & F.col("_cells"), "fragmento_interface")
        .otherwise(F.col("_detected"))
    )
    headed = first_occurrence_heading(base.withColumn("category", category))
    # the main section in force names the content under it
    main_key = F.when(F.col("category") == "secao_principal", F.col("_key"))
    mained = headed.select("*", F.coalesce(F.last(main_key, True).over(_upto()), F.lit("")).alias("_main"))
    cat = F.col("category")
    cat = (
        F.when((cat == "geral") & F.col("_main").endswith("OBJETIVO"), "objetivo")
        .when((cat == "geral") & F.col("_main").endswith("APLICACAO"), "aplicacao")
        .when((cat == "geral") & F.col("_main").endswith("DEFINICOES"), "definicoes")
        .otherwise(cat)
    )
    out = mained.withColumn("category", cat)
    cat, listed = F.col("category"), line.rlike(T.cs(V.LIST_ITEM))
    out = out.withColumn(
        "category",
        F.when((scope == "tabelas_tecnicas") & ~cat.isin("titulo_tabela", "cabecalho_tabela"), "tabela_tecnica")
        .when((scope == "tabela_2") & (cat == "secao_principal"), "atividade_tabela_2")
        .when((scope == "tabela_5") & (cat == "secao_principal"), "item_numerado_tabela_5")
        .when((scope == "tabela_2") & (cat == "geral") & listed, "atividade_tabela_2")
        .when((scope == "tabela_5") & (cat == "geral") & listed, "atividade_anomalia")
        .otherwise(cat),
    )
    summary = (F.col("_segments") > 1) & (F.col("segment") == 1)
    out = out.withColumn("_segments", F.max("segment").over(_whole())).withColumn(
        "_instruction", numbered_instruction(line, F.col("has_children"), summary)
    )
    cat = F.col("category")
    out = out.withColumn(
        "category",
        F.when(F.col("_instruction") & ~scope.isin("tabela_2", "tabela_5"), "instrucao_operacional")
        .when(
            scope.startswith("anexo_") & (cat == "subsecao_numerada") & ~F.col("has_children")
            & ~line.rlike(T.ci(V.ANNEX_OPERATIONAL_HEADING)),
            "item_numerado_anexo",
        )
        .otherwise(cat),
    )
    items = F.size(F.filter("lines", lambda x: x.rlike(T.cs(V.LIST_ITEM))))
    out = out.withColumn("list_flag", (items >= 2) & (scope != "tabela_2"))
    cat = F.col("category")
    return out.withColumn(
        "category",
        F.when(~F.col("list_flag") | (cat == "passo_tabela_operacional"), cat)
        .when(~scope.isin("tabelas_tecnicas", "tabela_5"), "lista_informativa")
        .when(cat == "cabecalho_tabela", "tabela_tecnica")
        .otherwise(cat),
    )


def _own_items(blocks: DataFrame) -> DataFrame:
    """Item numbers and the text features later rules test; ``_key`` is the key of the text."""
    text, standalone = F.col("text"), F.col("standalone")
    source = T.standard_item(text)
    dashed = standalone & (source == "") & text.rlike(T.cs(r"^\s*\d+\s*[-–—]\s*\S+"))
    source = F.when(dashed, F.concat(F.col("_number"), F.lit("-"))).otherwise(source)
    letter = F.lower(
        F.concat(
            F.regexp_extract(text, T.ci(V.ANNEX_LETTER_ITEM), 1),
            F.regexp_extract(text, T.ci(V.ANNEX_LETTER_ITEM), 2),
        )
    )
    bullet_free = T.strip(F.regexp_replace(text, T.cs(r"^\s*[•·▪◦*\-]\s*"), ""))
    content = T.numbered_content(text)
    out = blocks.select(
        "*",
        F.when(standalone & (F.col("_step") == ""), letter).otherwise(F.lit("")).alias("_letter"),
        source.alias("_source"),
        T.let(content, lambda c: F.when(c != "", c).otherwise(bullet_free)).alias("_content"),
        _action_tests(text, F.col("_key")).alias("_actions"),
    )
    plain = F.regexp_replace(text, T.cs(r"^\s*\d+(?:\.\d+)*\.?\s*"), "")
    conditional = F.col("_content").rlike(T.ci("^" + V.CONDITION_START))
    return out.select(
        "*",
        F.when((F.col("_letter") != "") | (F.col("_step") != ""), F.lit("")).otherwise(F.col("_source")).alias("item_source"),
        T.annex_item(F.col("_source"), F.col("scope")).alias("_own_item"),
        # the content is part of the text, and so is its key
        (
            F.contains("_key", F.lit("SEGUIR ETAPA"))
            & F.regexp_replace(T.match_key(F.col("_content")), "^[-–— ]+", "").startswith("SEGUIR ETAPA")
        ).alias("_remission"),
        conditional.alias("_conditional"),
        # only asked for where the content is a condition
        (conditional & text.rlike(T.ci(V.IMPERATIVE_CUE))).alias("_imperative"),
        F.col("_actions.explicit").alias("_explicit"),
        F.col("_actions.cue").alias("_cue"),
        T.is_structural_title(F.col("line_1")).alias("_title_shape"),
        F.col("line_1").rlike(T.ci(V.ANNEX_OPERATIONAL_HEADING)).alias("_op_heading"),
        F.lower(plain).startswith("não ").alias("_negative"),
        F.contains(text, F.lit("...")).alias("_dotted"),
    ).drop("_actions")


_PROMOTED = ("geral", "subsecao_numerada", "registros", "itens_criticos", "item_numerado_anexo")


def _refine(
    category: Column, item: Column, section: Column | None, title: Column | None, last_item: Column | None
) -> tuple[Column, Column]:
    """Contextual overrides in order: (category, item).

    With ``section`` left out only the overrides that do not look at context are applied;
    that form decides which blocks may become the section in force.  Each override binds
    the category it refines, so the chain stays linear in size.
    """
    standalone, source = F.col("standalone"), F.col("item_source")
    known = section is not None
    steps = []
    action = F.col("_explicit") | ((item != "") & ~F.col("_title_shape") & F.col("_cue"))
    promotes = action & ~F.col("_op_heading")
    steps.append(lambda c: F.when(promotes & c.isin(*_PROMOTED), "instrucao_operacional").otherwise(c))
    remission = standalone & F.col("_remission")
    action = action & ~remission
    acts = action
    steps.append(
        lambda c: F.when(remission, "geral")
        .when(standalone & (c == "item_numerado_anexo"), F.when(acts, "instrucao_operacional").otherwise("subsecao_numerada"))
        .otherwise(c)
    )
    top = standalone & T.rstrip_chars(source, ".").isin("1", "2", "1-", "2-")
    steps.append(lambda c: F.when(top, "subsecao_numerada").otherwise(c))
    if known:
        depth = F.size(F.split(section, r"\."))
        detail = standalone & (section == "1.1") & (source != "") & (T.item_depth(source) > 2) & ~acts
        opening = (
            standalone & (depth >= 3) & section.endswith(".1")
            & F.col("text").rlike(T.ci(r"^Antes de iniciar\b"))
        )
        steps.append(lambda c: F.when(opening, "instrucao_operacional").when(detail, "geral").otherwise(c))
        action = action | opening
    triggered = standalone & F.col("_conditional") & F.col("_imperative")
    steps.append(lambda c: F.when(triggered, "instrucao_operacional").otherwise(c))
    idle = F.col("flowchart") & ~(action | triggered) & ~F.col("_key").rlike("^(?:OBS|ORIENTAR|INFORMAR)")
    steps.append(
        lambda c: F.when(idle & c.isin("geral", "lista_informativa", "subsecao_numerada"), "fragmento_interface").otherwise(c)
    )
    if known:
        critical = F.contains(title, F.lit("ITENS CRITICOS"))
        note = (
            standalone & (source == "") & critical & F.col("_conditional")
            & ((depth <= 2) | T.match_key(F.col("_content")).startswith("EM CASO DE MANUTENCAO"))
        )
        inherits = (
            standalone & (last_item != "") & (item == "") & F.col("_conditional") & F.col("_imperative") & ~critical
        )
        item = F.when(note, "").when(inherits, last_item).otherwise(item)
        steps.append(lambda c: F.when(note, "geral").when(inherits, "instrucao_operacional").otherwise(c))
    steps.append(lambda c: F.when(F.col("_negative"), "geral").otherwise(c))
    for refine in steps:
        category = T.let(category, refine)
    return category, item


def carry_section(blocks: DataFrame) -> DataFrame:
    """Add ``section_before``/``title_before`` and ``section_ctx``/``title_ctx``.

    A numbered heading takes over as the section in force.  Whether a plain numbered
    subsection counts as a heading depends on the section already in force (items below
    a resource or critical-item list do not), so headings are found by a document fold
    over four small fields.
    """
    category, _ = _refine(F.col("category"), F.col("_own_item"), None, None, None)
    plain = (F.col("_letter") == "") & (F.col("_step") == "") & (F.col("_own_item") != "")
    staged = blocks.select("*", category.alias("_cat"))
    cat, size = F.col("_cat"), F.length("text")
    shape = F.col("_title_shape") & ~F.col("_instruction") & (cat != "item_numerado_anexo") & ~F.col("_remission")
    sub = (cat == "subsecao_numerada") & (
        (size <= V.TITLE_CHARS) | (F.col("standalone") & (size <= V.ANNEX_TITLE_CHARS))
    )
    action = F.col("_explicit") | (~F.col("_title_shape") & F.col("_cue"))
    descriptors = {
        "item": T.rstrip_chars(F.col("_own_item"), "."),
        "firm": plain & (shape | F.col("has_children")),
        "soft": plain & (sub | cat.isin("recursos_necessarios", "itens_criticos")),
        "sub": cat == "subsecao_numerada",
        "detail": F.col("standalone") & (F.col("item_source") != "")
        & (T.item_depth(F.col("item_source")) > 2) & ~action,
        "list": _any_of(F.col("_key"), LIST_CONTEXTS),
    }
    initial = {"section": F.lit(""), "in_list": F.lit(False)}

    def step(s: Column, d: Column):
        below = s["in_list"] & (s["section"] != "") & F.startswith(d["item"], F.concat(s["section"], F.lit(".")))
        held = (d["sub"] & below) | (d["detail"] & (s["section"] == "1.1"))
        takes = d["firm"] | (d["soft"] & ~held)
        return takes, {
            "section": F.when(takes, d["item"]).otherwise(s["section"]),
            "in_list": F.when(takes, d["list"]).otherwise(s["in_list"]),
        }

    cut = cut_document(
        staged.withColumn("_plain", plain), "block_no", descriptors, initial, step, "_span"
    )
    span = Window.partitionBy("doc_id", "_span").orderBy("block_no")
    # the first span of a document may open with a block that is no heading
    opens = F.row_number().over(span) == 1
    led = cut.select("*", opens.alias("_opens")).withColumn(
        "_heads",
        F.col("_opens") & F.col("_plain")
        & (
            (F.col("_span") > 1)
            | descriptors["firm"] | descriptors["soft"]
        ),
    )
    head = F.when(
        F.col("_heads"),
        F.struct(T.rstrip_chars(F.col("_own_item"), ".").alias("s"), F.col("_key").alias("t")),
    )
    return led.select(
        "*",
        F.last(head, True).over(_upto()).alias("_now"),
        F.last(head, True).over(_before()).alias("_was"),
    ).select(
        "*",
        F.coalesce("_now.s", F.lit("")).alias("section_ctx"), F.coalesce("_now.t", F.lit("")).alias("title_ctx"),
        F.coalesce("_was.s", F.lit("")).alias("section_before"), F.coalesce("_was.t", F.lit("")).alias("title_before"),
    ).drop("_now", "_was", "_span", "_opens", "_heads", "_plain", "_cat")


def carry_context(blocks: DataFrame) -> DataFrame:
    """Stage section, step and letter items, and the last operational item before each block."""
    stage_section = F.last(F.when(F.col("_stage").isNotNull(), F.col("section_before")), True).over(_upto())
    staged = blocks.select("*", F.coalesce(stage_section, F.lit("")).alias("_stage_section"))
    base = F.when(F.col("_stage_section") != "", F.col("_stage_section")).otherwise(F.col("section_before"))
    step_item = F.when(
        base != "", F.concat(T.rstrip_chars(base, "."), F.lit("."), F.col("_step"), F.lit("."))
    ).otherwise(F.col("_step"))
    shelved = F.col("_dotted") | F.contains(F.col("title_before"), F.lit("RECURSOS NECESSARIOS"))
    section = F.col("section_before")
    letter_item = (
        F.when(shelved, "")
        .when(section != "", F.concat(section, F.lit(".("), F.col("_letter"), F.lit(")")))
        .otherwise(F.concat(F.lit("("), F.col("_letter"), F.lit(")")))
    )
    is_letter = F.col("_letter") != ""
    item = (
        F.when(F.col("_step") != "", step_item).when(is_letter, letter_item).otherwise(F.col("_own_item"))
    )
    category = F.when(is_letter, F.when(shelved, "geral").otherwise("instrucao_operacional")).otherwise(F.col("category"))
    out = staged.select("*", item.alias("item")).withColumn("category", category)
    root_taken = (
        F.col("standalone") & (F.col("section_ctx") != "")
        & (F.size(F.split("section_ctx", r"\.")) == 1)
        & (F.col("section_ctx") == T.rstrip_chars(F.col("_own_item"), ".")) & ~is_letter
    )
    event = F.when(is_letter & (F.col("item") != ""), F.col("item")).when(root_taken, F.lit(""))
    return out.withColumn("_last_item", F.coalesce(F.last(event, True).over(_before()), F.lit("")))


def refine_category(blocks: DataFrame) -> DataFrame:
    """Contextual overrides, heading flag and table activity context."""
    category, item = _refine(
        F.col("category"), F.col("item"), F.col("section_before"), F.col("title_before"), F.col("_last_item")
    )
    out = blocks.select(
        *[c for c in blocks.columns if c not in ("category", "item")], category.alias("category"), item.alias("item")
    )
    below = (
        _any_of(F.col("title_before"), LIST_CONTEXTS) & (F.col("section_before") != "")
        & F.startswith(T.rstrip_chars(F.col("item"), "."), F.concat("section_before", F.lit(".")))
    )
    out = out.withColumn(
        "category",
        F.when(below & (F.col("category") == "subsecao_numerada"), "geral").otherwise(F.col("category")),
    )
    cat, size = F.col("category"), F.length("text")
    title = (
        (F.col("_title_shape") & ~F.col("_instruction") & (cat != "item_numerado_anexo") & ~F.col("_remission"))
        | ((cat == "subsecao_numerada") & ((size <= V.TITLE_CHARS) | (F.col("standalone") & (size <= V.ANNEX_TITLE_CHARS))))
        | cat.isin("recursos_necessarios", "itens_criticos", "etapa_operacional")
    )
    out = out.withColumn("title_flag", title)
    number = F.regexp_extract("line_1", T.cs(V.TABLE_ACTIVITY), 1)
    in_table = F.col("scope") == "tabela_2"
    activity = F.when(
        in_table & (F.col("category") == "atividade_tabela_2") & (number != ""),
        F.struct(
            F.when(F.col("section_ctx") != "", F.concat("section_ctx", F.lit("."), number)).otherwise(F.lit("")).alias("item"),
            F.concat(number, F.lit(".")).alias("hta"),
        ),
    )
    table = Window.partitionBy("doc_id", "_away").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    out = out.select("*", activity.alias("_activity")).withColumn(
        "_away", F.sum((~in_table).cast("int")).over(_upto())
    ).withColumn("_current", F.last("_activity", True).over(table))
    how = in_table & F.col("category").isin("como_fazer", "porque_fazer")
    group = F.when(F.col("stage_no") <= 1, F.col("_stage_section")).otherwise(
        F.concat(F.lit("__etapa_"), F.col("stage_no").cast("string"), F.lit("_"), F.col("_stage_section"))
    )
    source = F.when(F.col("_activity").isNotNull(), F.col("_activity")).when(how, F.col("_current"))
    context = F.when(
        F.col("category") == "passo_tabela_operacional",
        F.struct(F.col("item").alias("item"), F.lit("").alias("hta"), group.alias("op_group")),
    ).when(
        source.isNotNull(), F.struct(source["item"].alias("item"), source["hta"].alias("hta"), F.lit("").alias("op_group"))
    )
    return out.withColumn("context", context).withColumn("single_action", F.col("_letter") != "")


def local_list_numbering(blocks: DataFrame) -> DataFrame:
    """Inside annex procedures, rebuild list numbers as ``parent.(n.)``.

    Headings set the parent, a procedure marker opens the list.  The counter takes the
    maximum with explicit numbers and grows by one on unnumbered actions; its closed form
    is P + max(0, running max of (number - P)) with P the running count of increments.
    """
    text, scope = F.col("text"), F.col("scope")
    annex = scope.startswith("anexo_")
    alnum = F.upper(F.regexp_extract(text, T.ci(V.ALNUM_HEADING), 1))
    caps = (F.col("item_source") != "") & T.is_caps_item(text)
    marker = is_procedure_marker(text, F.col("_key") if "_key" in blocks.columns else None)
    kind = (
        F.when(~annex, "away").when(alnum != "", "alnum").when(caps, "caps").when(marker, "procedure")
    )
    seen = blocks.select(
        "*", alnum.alias("_alnum"), kind.alias("_kind"),
        T.rstrip_chars(F.col("item_source"), ".").alias("_src"),
    )
    parent_event = (
        F.when(F.col("_kind") == "away", "").when(F.col("_kind") == "alnum", F.col("_alnum"))
        .when(F.col("_kind") == "caps", F.col("_src"))
    )
    parented = seen.select("*", F.coalesce(F.last(parent_event, True).over(_upto()), F.lit("")).alias("_parent"))
    live = F.when(
        F.col("_kind").isNotNull() & ((F.col("_kind") != "procedure") | (F.col("_parent") != "")), F.col("_kind")
    )
    phased = parented.select(
        "*", live.alias("_live"),
        F.coalesce(F.last(live.isin("alnum", "procedure"), True).over(_upto()), F.lit(False)).alias("_open"),
        F.sum(live.isNotNull().cast("int")).over(_upto()).alias("_isl"),
    )
    inside = (
        F.col("_live").isNull() & annex & F.col("_open") & (F.col("_parent") != "")
        & ~F.upper(text).startswith("OBS")
    )
    numbered = inside & (F.col("item_source") != "")
    counted = inside & (F.col("item_source") == "") & text.rlike(T.ci(V.IMPERATIVE_CUE))
    first_number = F.regexp_extract("_src", r"^(\d+)(?:\.|$)", 1)
    marked = phased.select(
        "*", numbered.alias("_numbered"), counted.alias("_counted"),
        F.when(numbered & (first_number != ""), first_number.cast("long")).alias("_n"),
    )
    island = Window.partitionBy("doc_id", "_isl").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    stepped = marked.withColumn("_p", F.sum(F.col("_counted").cast("long")).over(island))
    stepped = stepped.withColumn("_lift", F.max(F.col("_n") - F.col("_p")).over(island))
    counter = F.col("_p") + F.greatest(F.coalesce("_lift", F.lit(0)), F.lit(0))
    local = F.when(F.col("_numbered"), T.rstrip_chars(F.regexp_replace(F.trim("item_source"), "^[()]+|[()]+$", ""), ".")).otherwise(
        counter.cast("string")
    )
    parent = T.rstrip_chars(F.col("_parent"), ".")
    gap = F.when(parent.rlike(r"\p{L}$"), "").otherwise(".")
    list_item = T.annex_item(F.concat(parent, gap, F.lit("("), local, F.lit(".)")), scope)
    listed = F.col("_numbered") | F.col("_counted")
    rest = T.numbered_content(text)
    rest = F.when(rest != "", rest).otherwise(text)
    opener = (
        F.col("_numbered") & F.col("has_children") & (T.item_depth(F.col("item_source")) == 1)
        & rest.rlike(T.ci(r"\b(?:como\s+segue|seguintes\s+passos)\b"))
    )
    negative = T.match_key(rest).rlike("^(?:SE NAO|NAO HAVENDO)")
    depth = T.item_depth(F.col("item_source"))
    shown = lambda value: T.annex_item(value, scope)
    is_alnum, is_caps, is_proc = (F.col("_live") == k for k in ("alnum", "caps", "procedure"))
    cat = F.col("category")
    out = stepped.select(
        *[c for c in blocks.columns if c not in ("item", "item_source", "category", "title_flag", "section_ctx", "single_action")],
        F.when(is_alnum, shown(F.col("_alnum"))).when(listed, list_item).otherwise(F.col("item")).alias("item"),
        F.when(is_alnum, F.col("_alnum")).otherwise(F.col("item_source")).alias("item_source"),
        F.when(is_alnum, "subsecao_numerada")
        .when(is_caps & (depth > 2), "item_numerado_anexo")
        .when(is_caps & (cat == "item_numerado_anexo"), "subsecao_numerada")
        .when(is_proc, "geral")
        .when(listed & opener, "secao_principal")
        .when(listed & negative, "geral")
        .when(listed, "instrucao_operacional")
        .otherwise(cat).alias("category"),
        F.when(is_alnum, True).when(is_caps, depth <= 2).when(is_proc, False).when(listed, opener)
        .otherwise(F.col("title_flag")).alias("title_flag"),
        F.when(is_alnum, shown(F.col("_alnum")))
        .when(is_caps, shown(F.col("item_source")))
        .when(is_proc, shown(F.col("_parent")))
        .when(listed, T.rstrip_chars(shown(F.col("_parent")), "."))
        .otherwise(F.col("section_ctx")).alias("section_ctx"),
        F.when(listed & ~opener & ~negative, True).otherwise(F.col("single_action")).alias("single_action"),
    )
    return out


def mark_trailing_fragments(blocks: DataFrame) -> DataFrame:
    """A suffix of screen captures after the last repeated document header is dropped.

    Suffixes of five blocks or more, half of them interface fragments: the fragments go,
    or everything when nothing in the suffix has document structure.
    """
    repeated = F.col("category") == "cabecalho_documento_repetido"
    seen = blocks.select("*", F.max(F.when(repeated, F.col("block_no"))).over(_whole()).alias("_from")).select(
        "*", F.coalesce(F.col("block_no") >= F.col("_from"), F.lit(False)).alias("_tail")
    ).select("*", F.when(F.col("_tail"), T.ui_fragment(F.col("text"))).otherwise(F.lit(False)).alias("_ui"))
    structured = (F.col("item") != "") | F.col("category").isin(
        "instrucao_operacional", "secao_principal", "subsecao_numerada"
    )
    tail = lambda value: F.sum(F.when(F.col("_tail"), value.cast("int")).otherwise(0)).over(_whole())
    counted = seen.select(
        "*", tail(F.lit(True)).alias("_size"), tail(F.col("_ui")).alias("_uis"), tail(structured).alias("_structured")
    )
    drop = (
        F.col("_tail") & (F.col("_size") >= V.SUFFIX_MIN_BLOCKS)
        & (F.col("_uis") / F.nullif(F.col("_size"), F.lit(0)) >= V.SUFFIX_MIN_RATIO)
        & ((F.col("_structured") == 0) | repeated | F.col("_ui"))
    )
    drop = F.coalesce(drop, F.lit(False))
    return counted.withColumn("title_flag", ~drop & F.col("title_flag")).withColumn(
        "category", F.when(drop, "fragmento_interface").otherwise(F.col("category"))
    ).select(*blocks.columns)


BLOCK_COLUMNS = (
    "doc_id", "doc_order", "filename", "block_no", "lines", "text", "item", "item_source", "category",
    "scope", "keywords", "context", "section_ctx", "title_flag", "list_flag", "has_children",
    "single_action", "standalone", "doc_kind", "annex_id", "stage_no",
)


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """Block boundaries to fully described blocks."""
    described = has_children(annex_segments(block_text(blocks)))
    owned = _own_items(_own_category(propagate_scope(described)))
    placed = refine_category(carry_context(carry_section(owned)))
    final = mark_trailing_fragments(local_list_numbering(placed))
    kind = F.when(F.col("flowchart"), "fluxograma").when(F.col("standalone"), "anexo").otherwise("procedimento")
    return (
        final.withColumn("keywords", T.keyword_tags(F.col("text"), key=F.col("_key")))
        .withColumn("doc_kind", kind)
        .select(*BLOCK_COLUMNS)
    )
