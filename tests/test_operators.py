"""Operators on small fixtures."""

import glob

import pytest
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V
from docloom.functions import text as T
from docloom.operators import (
    batching, hierarchy, lines, output, reconcile, rowgen, rules, running, status, typed,
)
from docloom.sources import intake, layout, rulebook, sinks, tables

ROW = "doc_id long, doc_order long, block_no int, row_no int, item string, description string, task_type string, hta string, task_text string"


def cells(spark, table):
    data = [(1, r, c, v) for r, row in enumerate(table, 1) for c, v in enumerate(row, 1)]
    frame = spark.createDataFrame(data, "table_id int, row_no int, cell_no int, cell string")
    return [x.line for x in tables.step_table_fold(frame).orderBy("row_no", "part_no").collect()]


def test_operational_table(spark):
    out = cells(spark, [
        ["O QUE FAZER", "EXECUTANTE", "ONDE REGISTRAR"],
        ["4- Regar as mudas", "Jardineira", "Caderno"],
        ["COMO FAZER: Regar cedo.\nPORQUE FAZER: Poupar água.", None, None],
    ])
    assert out == ["O QUE FAZER EXECUTANTE ONDE REGISTRAR", "4- Regar as mudas", "COMO FAZER: Regar cedo.", "PORQUE FAZER: Poupar água."]


def test_step_table(spark):
    out = cells(spark, [
        ["PASSO", "DESCRIÇÃO", "RESP."],
        ["1", "Encher o regador na torneira", "J1"],
        [None, "do pátio.", None],
        ["2", "Guardar a pá.", "J1"],
        [None, "Varrer as folhas do canteiro", None],
        ["3", None, None],
        [None, "e juntar no saco.", None],
    ])
    assert out == [
        "PASSO 1 | Encher o regador na torneira do pátio.",
        "PASSO 2 | Guardar a pá.",
        "PASSO 3 | Varrer as folhas do canteiro e juntar no saco.",
    ]


def test_technical_table_is_no_procedure(spark):
    assert cells(spark, [["1", "3 kg"], ["2", "7 kg"]]) == ["• 1 | 3 kg", "• 2 | 7 kg"]


def test_layout(spark):
    spans = spark.createDataFrame(
        [(1, 1, 0.0, 10.0, 50.0, 20.0, "before"), (1, 1, 10.0, 110.0, 40.0, 120.0, "inside"), (1, 1, 0.0, 300.0, 50.0, 310.0, "after")],
        "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    boxes = spark.createDataFrame(
        [(1, 1, 1, 0.0, 100.0, 100.0, 200.0, "table"), (1, 1, 2, 0.0, 295.0, 100.0, 320.0, "too short")],
        "doc_id long, page int, box_id int, x0 double, y0 double, x1 double, y1 double, text string")
    text = layout.page_text(layout.layout_assemble(spans, boxes)).first().text
    assert text == "before\n\ntable\n\nafter"


def test_intake_reasons(spark):
    files = spark.createDataFrame(
        [("s", "a.pdf", 10, "%PDF-1.4"), ("s", "b.pdf", 10, "Word"), ("s", "c.txt", 10, "x"), ("s", "d.doc", 0, ""),
         ("s", "e.docx", 10, "PK\x03"), ("s", "f.pdf", 26 * 1024 * 1024, "%PDF-")],
        "submission string, filename string, size long, head string")
    good, bad = intake.intake_validate(files)
    assert sorted(x.filename for x in good.collect()) == ["a.pdf", "e.docx"]
    assert {x.filename: x.reason for x in bad.collect()} == {
        "b.pdf": "content_mismatch", "c.txt": "extension", "d.doc": "empty", "f.pdf": "too_large"}


def test_line_glyphs(spark):
    docs = spark.createDataFrame([(1, "\n\ntexto\n outro\na  b\n3..4\npágina 1 de 3\n_\nfim")], "doc_id long, text string")
    got = [x.line for x in lines.clean_text_lines(docs).orderBy("line_no").collect()]
    assert got == ["• texto", "• outro", "a", "• b", "3.4", "", "fim"]


def test_typed_lines(spark):
    docs = spark.createDataFrame(
        [(1, 1, "a", "1. OBJETIVO\nCuidar da horta.\nCOMO FAZER\nRegistrar a colheita.\nPORQUE FAZER\nSaber o que plantar."),
         (2, 2, "b", "ANEXO B\n2. Canteiro\n2.3. Terra\n2.3.1. Mistura\n2.3.1.1 Registrar o peso\nATENÇÃO: usar luva."),
         (3, 3, "c", "ANEXO A\nVaso | Planta\nV-7 | Manjericão roxo")],
        "doc_id long, doc_order long, filename string, text string")
    rows = typed.classify_documents(docs).orderBy("doc_id", "block_order").collect()
    kinds = {d: [x.block_type for x in rows if x.doc_id == d] for d in (1, 2, 3)}
    assert kinds[1] == ["Título", "Informação", "Execução", "Informação"]
    assert kinds[2][1:] == ["Título", "Título", "Subtítulo", "Execução", "Informação"]
    assert [x.hierarchy for x in rows if x.doc_id == 2][4] == "2.3.1.1"
    assert set(kinds[3]) == {"Informação"}


def test_document_type_looks_at_the_whole_text(spark):
    docs = spark.createDataFrame([(1, "linha de prosa\n" * 900 + "ANEXO B\n2. Canteiro")], "doc_id long, text string")
    short = docs.withColumn("text", F.expr("right(text, 30)"))
    assert typed.document_type(docs).first().document_type == typed.document_type(short).first().document_type


def rule_frame(spark, rows):
    full = [(i, n, o, s, p, t, c, e, None, True) for i, n, o, s, p, t, c, e in rows]
    return rulebook.usable_rules(spark.createDataFrame(full, rulebook.RULE_SCHEMA))


@pytest.mark.parametrize("scope,category,rule_rows,want", [
    ("anexo_b", "anexo", [(1, "geral", "geral", 1), (2, "anexo_b", "anexo", 5), (3, "anexo_b", "geral", 2)], [2, 1, 3]),
    ("anexo_arquivo_b1", "anexo_documento", [(1, "geral", "geral", 1), (2, "anexo", "anexo_documento", 2)], [2, 1]),
])
def test_rule_order(spark, scope, category, rule_rows, want):
    frame = rule_frame(spark, [(i, str(i), o, s, "", "Informação", c, None) for i, s, c, o in rule_rows])
    kinds = spark.createDataFrame([(scope, category)], "scope string, category string")
    ranked = rules.rank_rules(rules.compatible_rules(kinds, frame)).orderBy("rule_rank").collect()
    assert [x.r_rule_id for x in ranked] == want


def test_orientation(spark):
    blocks = spark.createDataFrame(
        [(1, 1, "COMO FAZER: Podar os galhos secos.", "geral", "como_fazer"),
         (2, 1, "4. HISTÓRICO", "documento_principal", "historico"),
         (3, 1, "6- Trocar a terra dos vasos", "tabela_2", "atividade_tabela_2"),
         (4, 1, "folha " * 3000 + "COMO FAZER: regar", "geral", "como_fazer")],
        "doc_id long, block_no int, text string, scope string, category string")
    frame = rule_frame(spark, [
        (1, "Modo", 1, "geral", "(?i)COMO FAZER:", "Execução", "como_fazer", None),
        (2, "Sumário", 1, "documento_principal", r"(?i)^\s*4\.\s*HISTÓRICO\s*$", "Ignorar", "sumario", None),
        (3, "Tarefa da tabela", 1, "tabela_2", "Jardineira", "Execução", "atividade_tabela_2", None),
        (4, "broken", 0, "geral", "([", "Ignorar", "geral", None)])
    got = {x.doc_id: x.orientation for x in rules.orient_blocks(blocks, frame).collect()}
    assert got[1].rule == "Modo" and got[1].task_type == "Execução"
    assert got[2].rule is None and got[2].action == "converter"
    assert got[3].rule == "Tarefa da tabela"
    # a match behind the first 12 000 characters counts
    assert got[4].rule == "Modo"


def test_rejected_rules_are_named(spark):
    rows = [(k, str(k), 1, "geral", p, "Informação", "geral", None, None, True) for k, p in enumerate(("([", "ok", "", None, "(?P<x>a)"))]
    frame = spark.createDataFrame(rows, rulebook.RULE_SCHEMA)
    assert sorted(r.rule_id for r in rulebook.rejected_rules(frame).collect()) == [0, 4]
    assert {r.rule_id: r.pattern is None for r in rulebook.usable_rules(frame).collect()} == {0: True, 1: False, 2: True, 3: True, 4: True}


def test_seed_rules_inserted_once(spark):
    seed = rulebook.seed_rules(spark)
    assert rulebook.insert_missing(seed.limit(5), seed, "name").count() == len(V.SEED_RULES)
    assert rulebook.load_rules(spark, "/nowhere/at/all").count() == 0


def test_batches(spark):
    blocks = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbb"), (1, 3, "ccccc")], "doc_id long, block_no int, text string")
    assert [x.batch_no for x in batching.pack_batches(blocks, 7).orderBy("block_no").collect()] == [1, 1, 2]


def test_rowgen_cases(spark):
    schema = "doc_id long, block_no int, text string, category string, item string, section_ctx string, list_flag boolean, standalone boolean, context struct<item:string,hta:string,op_group:string>"
    blocks = spark.createDataFrame([
        (1, 1, 'COMO FAZER: Lendo e registrando na "Ficha C" a umidade.', "como_fazer", "", "", False, False, ("4.2.1", "1.", "")),
        (1, 2, "PASSO 3 | Ligar a bomba do poço e abrir o registro do canteiro.", "passo_tabela_operacional", "4.2.2.3.", "", False, False, None),
        (1, 3, "• Quem | O que\n• Ana | Podar as roseiras.\n• Rui | Varrer o pátio.\n• Avisar se faltar adubo.", "tabela_tecnica", "", "", True, False, None),
        (1, 4, "• Caso haja praga, isolar o vaso e informar ao viveiro; • Após a geada, retirar a lona e comunicar ao viveiro.", "instrucao_operacional", "", "2", False, True, None),
        (1, 6, "a) Isolar o canteiro; b) Confirmar o nome da muda.", "instrucao_operacional", "", "4.2.4.", False, False, None),
        (1, 7, "- Pá;\n- Ancinho;\n- Regador.", "lista_informativa", "", "", True, False, None),
        (1, 8, "NÃO", "fragmento_interface", "", "", False, False, None),
    ], schema)
    got = {n: [] for n in range(1, 9)}
    for x in rowgen.block_to_rows(blocks).orderBy("block_no", "row_no").collect():
        got[x.block_no].append(x)
    assert [x.hta for x in got[1]] == ["1.1.", "1.2."] and got[1][0].description == got[1][1].description
    assert all('"Ficha C" a umidade' in x.task_text for x in got[1])
    assert [x.task_text for x in got[2]] == ["Ligar a bomba do poço e abrir o registro do canteiro."]
    assert [x.task_type for x in got[3]] == ["Título/Subtítulo", "Informação", "Informação"]
    assert got[3][0].description == "Quem - O que" and "Avisar se faltar adubo" in got[3][2].description
    assert [x.description for x in got[4]] == [
        "Caso haja praga, isolar o vaso e informar ao viveiro", "Após a geada, retirar a lona e comunicar ao viveiro."]
    assert [x.item for x in got[6]] == ["4.2.4.(a)", "4.2.4.(b)"] and got[6][1].description.startswith("b)")
    assert [x.description for x in got[7]] == ["- Pá;", "- Ancinho;", "- Regador."]
    assert got[8][0].task_type == "Ignorar"


def test_responses(spark):
    frame = spark.createDataFrame([
        (1, 1, 1, '```json\n{"linhas":[{"ordemBloco":1,"descricao":"Adubar o canteiro","tipoTarefa":"Execução"}]}\n```'),
        (2, 1, 1, '{"linhas":[{"ordem":9,"descricao":"Poda","tipoTarefa":"Execução"}]}'),
        (3, 1, 1, '{"ordem": "1", "texto": "sem linhas"}'), (4, 1, 1, "nada de json"),
        (5, 1, 1, '{"linhas":[{"ordemBloco":0,"descricao":"x","tipoTarefa":"Execução"}]}')],
        "doc_id long, batch_no int, attempt int, response string")
    good, bad = reconcile.parse_responses(frame)
    assert {x.doc_id: (x.block_no, x.description) for x in good.collect()} == {1: (1, "Adubar o canteiro"), 2: (9, "Poda")}
    assert sorted(x.doc_id for x in bad.collect()) == [3, 4, 5]


def test_order_repair(spark):
    asked = spark.createDataFrame([(1, 2, n) for n in (9, 10, 11)], "doc_id long, batch_no int, block_no int")
    rows = spark.createDataFrame([(1, 2, 1, n, n) for n in (1, 2, 3)], "doc_id long, batch_no int, attempt int, row_no int, block_no int")
    assert [x.block_no for x in reconcile.repair_orders(rows, asked).orderBy("row_no").collect()] == [9, 10, 11]


def test_grounding(spark):
    blocks = spark.createDataFrame([(1, 1, "Medir a umidade da terra no oﬃcial."), (2, 1, "Levante a lona do viveiro.")], "doc_id long, block_no int, text string")
    rows = spark.createDataFrame([
        (1, 1, "Lista de preços da feira", "Informação", ""), (1, 1, "umidade da terra", "Informação", ""), (1, 1, "official", "Informação", ""),
        (2, 1, "Levante a lona do viveiro.", "Execução", "Pagar a conta de luz.")],
        "doc_id long, block_no int, description string, task_type string, task_text string")
    assert sorted(x.description for x in reconcile.grounded_rows(rows, blocks).collect()) == ["official", "umidade da terra"]


def test_attempts_cover_everything(spark):
    make = lambda ns, tag: spark.createDataFrame([(1, n, 1, tag) for n in ns], "doc_id long, block_no int, row_no int, tag string")
    empty = make([1], "x").where("false")
    got = reconcile.fallback_union(empty, make(range(9, 14), "first"), make(range(9, 17), "second"), make(range(9, 18), "own"))
    assert {x.block_no: x.tag for x in got.collect()} == {**{n: "first" for n in range(9, 14)}, **{n: "second" for n in range(14, 17)}, 17: "own"}


def test_item_filled(spark):
    rows = spark.createDataFrame([(1, 1, "", "3.2 - Atividade", "Título/Subtítulo")], "doc_id long, block_no int, item string, description string, task_type string")
    blocks = spark.createDataFrame([(1, 1, "3.2")], "doc_id long, block_no int, item string")
    x = reconcile.fill_detected_item(rows, blocks).first()
    assert (x.item, x.description) == ("3.2", "Atividade")


def test_rows_to_csv(spark, tmp_path):
    rows = spark.createDataFrame([
        (1, 1, 1, 1, "P1", " Referência ", "Padrão/Anexo", "", ""), (1, 1, 2, 1, "", "Executar\natividade", "Execução", "Fazer", ""),
        (1, 1, 3, 1, "", "Ignorar", "Ignorar", "", ""), (1, 1, 4, 1, "", "Executar atividade", "Execução", "Fazer", "")], ROW)
    done = output.assign_row_ids(output.dedupe_keep_first(output.normalize_rows(rows)))
    assert [(x.item, x.row_id) for x in done.orderBy("block_no").collect()] == [("P1", None), ("", 1)]
    sinks.write_matrix_csv(done, str(tmp_path / "m"), single_file=True)
    (part,) = glob.glob(str(tmp_path / "m" / "part-*.csv"))
    text = open(part, encoding="utf-8").read()
    assert text.startswith("﻿") and text[1:].splitlines()[0] == ";".join(V.MATRIX_CSV_COLUMNS)
    back = spark.read.option("sep", ";").option("header", True).option("multiLine", True).csv(str(tmp_path / "m")).collect()
    assert len(back) == 2 and any(x["Descrição"] == "Executar\natividade" for x in back)
    assert sinks.matrix_sheet_projection(done).columns == list(V.MATRIX_SHEET_COLUMNS)


def test_status_fold(spark):
    events = spark.createDataFrame([
        ("a", "2024-01-01 00:00:00", 1, "start", None, None, None, None), ("a", "2024-01-01 00:01:00", 2, "update", "ia", "m", 4, 10),
        ("b", "2024-01-01 00:00:00", 3, "start", None, None, None, None), ("b", "2024-01-01 00:01:00", 4, "update", "ia", "m", 4, 10),
        ("b", "2024-01-01 00:02:00", 5, "complete", None, "CSV parcial gerado.", None, None),
        ("c", "2024-01-01 00:01:00", 6, "update", "ia", "m", 4, 10),
        ("d", "2024-01-01 00:00:00", 7, "start", None, None, None, None), ("d", "2024-01-01 00:01:00", 8, "update", "ia", "m", 5, 8),
        ("d", "2024-01-01 00:02:00", 9, "error", None, "falhou", None, None)],
        "id string, ts string, seq int, kind string, stage string, message string, done int, total int").withColumn("event_ts", F.to_timestamp("ts"))
    got = {x.id: x for x in status.latest_status(events).collect()}
    assert set(got) == {"a", "b", "d"}
    assert (got["a"].status, got["a"].percent, got["a"].stage) == ("processando", 40, "ia")
    assert (got["b"].status, got["b"].percent, got["b"].done, got["b"].message) == ("concluido", 100, 10, "CSV parcial gerado.")
    assert (got["d"].status, got["d"].percent) == ("erro", 62)
    kept = status.expire_status(status.latest_status(events), F.lit("2024-01-01 01:01:30").cast("timestamp"))
    assert {x.id for x in kept.collect()} == {"b", "d"}


def test_failures_leave_the_rest(spark):
    batches = spark.createDataFrame([(1, "f", 1, 1 + (n - 1) // 8, n) for n in range(1, 10)], "doc_id long, filename string, doc_order long, batch_no int, block_no int")
    errors = spark.createDataFrame([(1, 1, "bad")], "doc_id long, batch_no int, error string")
    assert output.failure_report(batches, errors).first().block_nos == list(range(1, 9))
    assert [x.block_no for x in output.surviving_rows(batches, errors).collect()] == [9]


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_running_reductions(spark, width):
    values = [(k, (k * 37) % 11 - 5) for k in range(0, 60, 2)]
    frame = spark.createDataFrame(values, "k long, v long")
    sums = {x.k: x.s for x in running.running_before(frame, "k", "v", "s", width=width).collect()}
    tops = {x.k: x.m for x in running.running_before(frame, "k", "v", "m", "max", width=width).collect()}
    for i, (k, _) in enumerate(values):
        before = [v for _, v in values[:i]]
        assert sums[k] == sum(before) and tops[k] == (max(before) if before else None)


def test_roots_run_on(spark):
    stats = spark.createDataFrame(
        [(k, k, n, r, a, x) for k, n, r, a, x in ((1, 2, 0, 0, 0), (2, 0, 0, 9, 0), (3, 1, 4, 0, 1), (4, 0, 0, 0, 1), (5, 2, 0, 0, 0))],
        "doc_id long, doc_order long, n long, r long, a long, x long")
    roots = [x.root for x in hierarchy.cross_document_offset(stats).orderBy("doc_order").collect()]
    want, top = [], 0
    for n, r, a, x in ((2, 0, 0, 0), (0, 0, 9, 0), (1, 4, 0, 1), (0, 0, 0, 1), (2, 0, 0, 0)):
        want.append(top + 1)
        top = max(top, a, top + 1 if x else 0, max(top, r) + n if n else 0)
    assert roots == want


def test_text_helpers(spark):
    row = spark.range(1).select(
        T.match_key(F.lit("  Ação  é ")).alias("k"), T.token_key(F.lit("Ação-é 2²")).alias("t"),
        T.suffix_item(F.lit("Fazer"), F.lit("1.2.")).alias("s1"), T.suffix_item(F.lit("Fazer (1.2)"), F.lit("1.2.")).alias("s2"),
        T.annex_item(F.lit("1."), F.lit("anexo_b")).alias("a1"), T.annex_item(F.lit("1."), F.lit("anexo_arquivo_b1")).alias("a2"),
    ).first()
    assert tuple(row) == ("ACAO E", "acao e 22", "Fazer (1.2.)", "Fazer (1.2)", "Anexo B - 1.", "1.")


def test_folding_is_complete(spark):
    """Keys against the standard library's own decomposition."""
    import re
    import unicodedata

    texts = ["oﬃce ﬁn ﬂow ½ Ⅷ № ① ™ ㎏ x²", "がぎ パピ é ê ç ÅΩ", "plain ascii", "𝐀𝐁 ｆｕｌｌ", "ő Ǆ ŉ ẞ ß İ", ""]
    plain = lambda form, x: "".join(c for c in unicodedata.normalize(form, x) if unicodedata.category(c) != "Mn")
    frame = spark.createDataFrame([(x,) for x in texts], "x string")
    for r in frame.select("x", T.token_key(F.col("x")).alias("t"), T.match_key(F.col("x")).alias("m")).collect():
        assert r.t == " ".join(re.findall("[a-z0-9]+", plain("NFKD", r.x).lower()))
        assert r.m == plain("NFD", r.x).upper()


def test_annex_numbers_that_meet(spark):
    def numbered(*rows):
        entries = spark.createDataFrame([(1, n, *r) for n, r in enumerate(rows, 1)], ANNEX_ENTRY)
        return [r.rel for r in hierarchy.relative_numbers(entries).orderBy("pos").collect()]

    # counts go on from the greatest lead written so far
    assert numbered(("a", "1", ""), ("a", "1", "5"), ("a", "1", ""), ("a", "1", "5.2")) == ["1.1.", "1.5.", "1.6.", "1.5.2."]
    # a written number is kept once; one that was counted before is counted on
    assert numbered(("a", "1", "2"), ("a", "1", "2"), ("a", "1", "3"), ("a", "1", "x")) == ["1.2.", "1.3.", "1.4.", "1.x."]
    # groups count apart but share the numbers of their prefix
    assert numbered(("a", "1", ""), ("b", "1", "1"), ("b", "1", "")) == ["1.1.", "1.2.", "1.3."]


ANNEX_ENTRY = "doc_id long, pos int, group string, prefix string, suffix string"


def one_after_another(rows):
    """Numbers of one document's annex actions, read in order."""
    given, counts, out = set(), {}, []
    for group, prefix, suffix in rows:
        head = suffix.split(".")[0]
        count = max(counts.get(group, 0), int(head) if head.isdigit() else 0)
        text = f"{prefix}.{suffix}."
        if not suffix or text in given:
            count += 1
            text = f"{prefix}.{count}."
        counts[group] = count
        given.add(text)
        out.append(text)
    return out


def test_annex_numbers_in_order(spark):
    import random

    rnd, rows, want = random.Random(3), [], {}
    for doc in range(150):
        prefix = {g: rnd.choice(["1", "2", "1.2", "1.1"]) for g in "abc"}
        own = [(g, prefix[g], rnd.choice(["", "", "", str(rnd.randint(1, 9)), "2.3", "07", "x"])) for g in rnd.choices("abc", k=rnd.randint(1, 25))]
        rows += [(doc, n, *r) for n, r in enumerate(own, 1)]
        want |= {(doc, n): t for n, t in enumerate(one_after_another(own), 1)}
    found = hierarchy.relative_numbers(spark.createDataFrame(rows, ANNEX_ENTRY)).collect()
    assert {(r.doc_id, r.pos): r.rel for r in found} == want and len(found) == len(rows)
    assert hierarchy.relative_numbers(spark.createDataFrame([], ANNEX_ENTRY)).count() == 0


def test_squeeze_treats_every_whitespace_character_alike(spark):
    rows = [(f"a{c}b{c}{c}d {c}", "a b d") for c in V.WS_CHARS] + [("  a  b ", "a b"), ("a b", "a b"), ("", ""), (None, None)]
    rows += [(f"a{c}b", f"a{c}b") for c in "\x1b\x7fᙿᚁ᠎​‧‪‰⿿、﻿"]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, text string, want string").select(
        "k", T.squeeze(F.col("text")).alias("got"), "want"
    )
    assert [r.k for r in got.where("not (got <=> want)").collect()] == []
