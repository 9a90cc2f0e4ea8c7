"""Small documents of a bakery through the whole path, all in one job; expectations by hand."""

import pytest

from docloom.operators import hierarchy, rowgen
from docloom.plans import matrix
from docloom.plans.staging import write_stage
from docloom.sources import markup

CASES = {
    "oven": ("", "INTERNA\nPágina 3 de 9\n1. OBJETIVO\nManter o forno limpo.\n\nCOMO FAZER\nEscovar a grelha fria.\nAprovado por: gerência\n_"),
    "contents": ("", "1. OBJETIVO\n2. APLICAÇÃO\n3. DESCRIÇÃO\n4. REGISTROS\n1. OBJETIVO\nAssar pães iguais.\n2. APLICAÇÃO\nVale para as duas lojas."),
    "quoted": ("", 'Tabela 2 - Rotina do forno\n1- Aquecer a câmara\nCOMO FAZER: Conferir o Anexo "D" da receita.\n5.1.4 - Utensílios\n- Espátula larga'),
    "tools": ("", "5.1.4 - Utensílios\n- Espátula larga;\n- Balança de bancada;\n- Luva térmica."),
    "annex": ("", "ANEXO C\n2.1.3 – Leitura do termômetro.\n2.1.3.1 - Abra a porta e aguarde o sinal.\n2.1.3.2 - Feche a porta."),
    "annex_list": ("", "ANEXO C\n7.4. PAINEL DA MASSEIRA\nRotina.\n1. Escolha a receita do dia.\n2. Ligue o misturador.\nANEXO C\n8. TROCA DA LÂMINA\nRotina.\n1. Retire a tampa lateral."),
    "letters": ("", "ANEXO C\n1.1.1 - Preparo da bancada\n1.1.1.1 - Levante a tampa.\n6D – Guarda das formas\n1. Baixar a prateleira.\n2. Travar a gaveta."),
    "advice": ("", "6.2 - Fornada\nRecomenda-se aguardar dez minutos. O padeiro deverá medir a massa."),
    "outage": ("", "6.3 - Falta de energia\nCaso haja queda de energia, deverá ser solicitada revisão do quadro."),
    "never": ("", "6.4.2. Não devem ser vendidos pães da véspera enquanto a vitrine estiver em reforma anunciada aos clientes."),
    "file_list": ("Anexo D2 - Limpeza do forno.pdf", "LIMPEZA DO FORNO\n1- Preparo\n1.1 - Materiais\n- Pano úmido;\n1.2. Desmontagem\n• a. Isolar a bancada com fita;\n• b. Confirmar o desligamento da chave."),
    "file_steps": ("Anexo D3 - Entrega.pdf", "2.5. ATRASO NA ENTREGA\n2.5.1 Caso seja necessário, comunicar ao balcão.\n2.5.2 Travar a porta dos fundos."),
    "stages": ("", "4.1.2. Ordem da fornada\nETAPA 1 - Mistura\nPASSO 1 | Ligar a masseira.\nETAPA 2 - Assamento\nPASSO 1 | Fechar a porta do forno."),
    "broken": ("", "3.1.2. Conferência\nAntes de abrir a loja, verificar o caixa conforme descrito na\n\nTabela 4 e no caderno azul."),
    "flow": ("ANEXO F - Fluxograma - Encomendas.pdf", "NÃO\nAcionar a campainha do balcão."),
}
ROOT = 12


@pytest.fixture(scope="module")
def result(spark):
    names = list(CASES)
    rows = [(i, i, CASES[n][0], CASES[n][1]) for i, n in enumerate(names)]
    documents = spark.createDataFrame(rows, "doc_id long, doc_order long, filename string, text string")
    blocks = write_stage(matrix.document_blocks(documents), "test-blocks")
    info = hierarchy.block_info(blocks)
    lines = write_stage(rowgen.block_to_rows(info, tuple(hierarchy.BLOCK_INFO.values())), "test-rows")
    found = {n: ([], []) for n in names}
    for r in blocks.orderBy("doc_id", "block_no").collect():
        found[names[r.doc_id]][0].append(r)
    for r in hierarchy.number_documents(lines, ROOT).orderBy("doc_id", "block_no", "row_no").collect():
        found[names[r.doc_id]][1].append(r)
    return found


def numbers(rows, kind="Execução"):
    return [(r.item, r.hta, r.task_text) for r in rows if r.task_type == kind]


def test_marks_footers_and_approvals_leave(result):
    blocks, rows = result["oven"]
    assert [b.category for b in blocks] == ["secao_principal", "objetivo", "como_fazer"]
    assert blocks[2].text == "COMO FAZER Escovar a grelha fria."
    assert [r.hta for r in rows] == ["12.", "", "12.1."]


def test_leading_contents_leave(result):
    assert [b.text for b in result["contents"][0]] == [
        "1. OBJETIVO", "Assar pães iguais.", "2. APLICAÇÃO", "Vale para as duas lojas."
    ]


def test_table_scope_ends_at_a_section(result):
    blocks, rows = result["quoted"]
    # a quoted annex is a mention, not a new scope
    assert [b.scope for b in blocks] == ["tabela_2"] * 3 + ["documento_principal"] * 2
    assert (blocks[1].category, blocks[1].context.hta, blocks[3].context) == ("atividade_tabela_2", "1.", None)
    assert numbers(rows) == [("", "1.1.", 'Conferir o Anexo "D" da receita.')]


def test_lists_stay_together(result):
    blocks, rows = result["tools"]
    assert blocks[0].title_flag and blocks[0].item == "5.1.4"
    assert blocks[1].list_flag and blocks[1].category == "lista_informativa"
    assert [r.description for r in rows[1:]] == ["- Espátula larga;", "- Balança de bancada;", "- Luva térmica."]


def test_annex_actions(result):
    blocks, rows = result["annex"]
    assert [b.item for b in blocks] == ["", "Anexo C - 2.1.3", "Anexo C - 2.1.3.1", "Anexo C - 2.1.3.2"]
    assert [(h, t.split(" (")[0]) for _, h, t in numbers(rows)] == [
        ("12.2.1.", "Abrir a porta."), ("12.2.2.", "Aguardar o sinal."), ("12.2.3.", "Fechar a porta.")
    ]


def test_repeated_annex_head(result):
    blocks, rows = result["annex_list"]
    assert [b.category for b in blocks].count("anexo_cabecalho_repetido") == 1
    assert blocks[1].text == "7.4. PAINEL DA MASSEIRA Rotina." and rows[1].task_type == "Informação"
    assert numbers(rows)[-1] == ("Anexo C - 1.", "12.1.", "Retirar a tampa lateral. (Anexo C - 1.)")


def test_lettered_group(result):
    _, rows = result["letters"]
    assert [(r.item, r.hta) for r in rows[3:]] == [
        ("Anexo C - 6D", "12.1.1."), ("Anexo C - 6D(1.)", "12.1.1.1."), ("Anexo C - 6D(2.)", "12.1.1.2.")
    ]
    assert rows[3].description == "Guarda das formas"


def test_modal_sentences_become_actions(result):
    blocks, rows = result["advice"]
    assert blocks[1].category == "instrucao_operacional"
    assert numbers(rows) == [("6.2", "12.1.", "Aguardar dez minutos. (6.2)"), ("6.2", "12.2.", "Medir a massa. (6.2)")]


def test_statements_stay_information(result):
    for name in ("outage", "never"):
        blocks, rows = result[name]
        assert blocks[-1].category == "geral" and rows[-1].task_type == "Informação" and not rows[-1].hta
    assert result["never"][1][0].item == "6.4.2."


def test_annex_in_a_file_of_its_own(result):
    blocks, rows = result["file_list"]
    assert {b.scope for b in blocks} == {"anexo_arquivo_d2"}
    assert (rows[0].item, rows[0].description, rows[0].hta) == ("Anexo D2", "LIMPEZA DO FORNO", "12.")
    assert [(i, h) for i, h, _ in numbers(rows)] == [("1.2.(a)", "12.1.1."), ("1.2.(b)", "12.1.2.")]
    assert [(i, h) for i, h, _ in numbers(result["file_steps"][1])] == [("2.5.1", "12.1.1."), ("2.5.2", "12.1.2.")]


def test_stages_start_roots(result):
    blocks, rows = result["stages"]
    assert [b.category for b in blocks[1:3]] == ["etapa_operacional", "passo_tabela_operacional"]
    assert numbers(rows) == [
        ("4.1.2.1.", "12.1.", "Ligar a masseira. (4.1.2.1.)"), ("4.1.2.1.", "13.1.", "Fechar a porta do forno. (4.1.2.1.)")
    ]
    assert (rows[3].hta, rows[3].task_text) == ("13.", "Assamento (4.1.2.)")


def test_open_sentence_goes_on(result):
    (block,), rows = result["broken"]
    assert block.text.endswith("descrito na Tabela 4 e no caderno azul.")
    assert [t.split(" (")[0] for _, _, t in numbers(rows)][0] == "Abrir a loja."


def test_flowchart_file(result):
    blocks, rows = result["flow"]
    assert {b.doc_kind for b in blocks} == {"fluxograma"}
    assert numbers(rows) == [("", "12.1.", "Acionar a campainha do balcão.")]


def test_every_block_has_rows(result):
    for blocks, rows in result.values():
        assert {b.block_no for b in blocks} == {r.block_no for r in rows}


def test_page_references_and_rejected_pages(spark):
    pages = spark.createDataFrame(
        [
            (1, "<p>caf&eacute; &#8217;&#x1F600;&nbsp;&amp;lt; &unknown; &amp &#0;&#xD800;&#9999999;</p>"), (2, None), (3, " \n\t"),
            (4, "<html><head><title>x</title></head><body><!-- y --><p>&nbsp;&#9;&#7;</p></body></html>"), (5, ""),
            (6, "a&#10;b<br>&&lt;c&gt;&AMP;"),
        ],
        "page_id long, html string",
    )
    lines = {(r.page_id, r.line_no): r.line for r in markup.page_text_extract(pages).collect()}
    assert lines == {(1, 1): "café ’\U0001f600 &lt; &unknown; &amp ���", (6, 1): "a b", (6, 2): "&<c>&AMP;"}
    rejected = {r.page_id: r.reason for r in markup.page_text_rejected(pages).collect()}
    assert rejected == {2: "no_content", 3: "no_content", 4: "no_text", 5: "no_content"}
