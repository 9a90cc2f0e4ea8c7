"""The whole plan, with model responses."""

from docloom.plans import matrix
from docloom.sources import rulebook

TEXT = "2.3 - Horta\nAtividade de rega dos vasos pequenos.\n2.4 - Colheita\nRecomenda-se aguardar a manhã. A jardineira deverá medir as folhas."


def response(text):
    return '{"linhas":[{"ordemBloco":1,"descricao":"%s","tipoTarefa":"Título/Subtítulo"}]}' % text


def test_matrix_with_responses(spark):
    documents = spark.createDataFrame(
        [(d, d, f"doc{d}.pdf", TEXT) for d in (1, 2, 3)], "doc_id long, doc_order long, filename string, text string")
    responses = spark.createDataFrame(
        [(1, 1, 1, response("Rega dos vasos pequenos")), (2, 1, 1, response("Lista de preços da feira")), (3, 1, 1, "no json")],
        "doc_id long, batch_no int, attempt int, response string")
    rules = rulebook.usable_rules(rulebook.load_rules(spark, rulebook.seed_rules(spark)))
    run = matrix.run_matrix(documents, rules, responses)
    rows = run.rows.orderBy("doc_order", "block_no", "row_no").collect()
    # a response that cannot be read is told, and its blocks fall back
    assert [tuple(x) for x in run.invalid.collect()] == [(3, 1, 1, "invalid_response")]
    assert run.failures.count() == 0
    assert [(x.doc_id, x.n_failed, x.partial) for x in run.outcome.orderBy("doc_id").collect()] == [(d, 0, False) for d in (1, 2, 3)]
    # ids are dense over the corpus and roots run on from document to document
    assert [x.row_id for x in rows] == list(range(1, len(rows) + 1))
    assert [x.hta for x in rows if x.task_type == "Execução"] == ["1.1.", "1.2.", "2.1.", "2.2.", "3.1.", "3.2."]
    answered = {d: next(x for x in rows if x.doc_id == d and x.block_no == 2) for d in (1, 2, 3)}
    # a local position is mapped to its block, an ungrounded answer gives way to the fallback
    assert answered[1].description == "Rega dos vasos pequenos"
    assert answered[1].task_type == "Título/Subtítulo"
    for d in (2, 3):
        assert answered[d].description == "Atividade de rega dos vasos pequenos."


TWO = "2.3 - Horta\nAtividade de rega dos vasos pequenos.\n2.5 - Roseiral\nAtividade de poda das roseiras antigas."


def test_retry_counts_the_missing_blocks(spark):
    documents = spark.createDataFrame([(1, 1, "doc.pdf", TWO)], "doc_id long, doc_order long, filename string, text string")
    rules = rulebook.usable_rules(rulebook.load_rules(spark, rulebook.seed_rules(spark)))
    first = '{"linhas":[{"ordemBloco":2,"descricao":"Rega dos vasos pequenos","tipoTarefa":"Informação"}]}'
    # position 1 of the second request is the block the first left open
    second = '{"linhas":[{"ordemBloco":1,"descricao":"Poda das roseiras antigas","tipoTarefa":"Informação"}]}'
    responses = spark.createDataFrame([(1, 1, 1, first), (1, 1, 2, second)], "doc_id long, batch_no int, attempt int, response string")
    rows = {x.block_no: x.description for x in matrix.matrix(documents, rules, responses).collect()}
    assert (rows[2], rows[4]) == ("Rega dos vasos pequenos", "Poda das roseiras antigas")


def test_submissions_start_anew(spark):
    documents = spark.createDataFrame(
        [(d, 1, f"doc{d}.pdf", TEXT, f"s{d % 2}") for d in (1, 2, 3)],
        "doc_id long, doc_order long, filename string, text string, submission_id string")
    rules = rulebook.usable_rules(rulebook.load_rules(spark, rulebook.seed_rules(spark)))
    rows = matrix.matrix(documents, rules).orderBy("submission_id", "doc_id", "block_no", "row_no").collect()
    for name in ("s0", "s1"):
        own = [x for x in rows if x.submission_id == name]
        assert [x.row_id for x in own] == list(range(1, len(own) + 1))
        assert next(x.hta for x in own if x.task_type == "Execução") == "1.1."
    assert [x.hta for x in rows if x.doc_id == 3 and x.task_type == "Execução"] == ["2.1.", "2.2."]


def test_batches_with_unanswered_blocks_fail(spark):
    blocks = spark.createDataFrame([(1, 1, b) for b in range(1, 9)] + [(1, 2, 9), (2, 1, 1)], "doc_id long, batch_no int, block_no int")
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 9), (2, 1)], "doc_id long, block_no int")
    assert [tuple(x) for x in matrix.coverage_errors(blocks, rows).collect()] == [(1, 1, "uncovered_blocks: 3, 4, 5, 6, 7, 8")]


def test_model_rows_may_not_merge_actions(spark):
    text = "2.3 - Horta\nRecomenda-se aguardar a manhã. A jardineira deverá medir as folhas."
    documents = spark.createDataFrame([(1, 1, "doc.pdf", text)], "doc_id long, doc_order long, filename string, text string")
    rules = rulebook.usable_rules(rulebook.load_rules(spark, rulebook.seed_rules(spark)))
    merged = '{"linhas":[{"ordemBloco":2,"descricao":"Aguardar a manhã","tipoTarefa":"Execução","descricaoTarefa":"Aguardar a manhã"}]}'
    responses = spark.createDataFrame([(1, 1, 1, merged)], "doc_id long, batch_no int, attempt int, response string")
    blocks = matrix.prepared_blocks(documents, rules)
    assert [x.category for x in blocks.where("block_no = 2").collect()] == ["instrucao_operacional"]
    key = lambda rows: sorted((x.block_no, x.row_no, x.task_text) for x in rows.collect())
    plain = key(matrix.batch_rows(blocks))
    assert len([x for x in plain if x[0] == 2]) > 1 and key(matrix.batch_rows(blocks, responses)) == plain
