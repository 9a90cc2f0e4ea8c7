"""Work that must be done once a row, however many branches read it; keys of Latin and other letters."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import hierarchy as H
from docloom.operators import output as O

N = 400


@pytest.fixture
def counted(spark):
    """A task type that counts the rows it is worked out for."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def task_type(n):
        seen.add(1)
        return "Execução" if n % 3 else "Informação"

    return seen, task_type


def _rows(spark, task_type):
    doc, n = F.col("id") % 20, F.expr("cast(id div 20 as int)")
    rows = spark.range(N).select(
        doc.alias("doc_id"), doc.alias("doc_order"), n.alias("block_no"), F.lit(1).alias("row_no"), F.lit("").alias("item"),
        F.concat(F.lit("linha "), F.col("id").cast("string")).alias("description"), task_type(n).alias("task_type"),
        F.lit("").alias("hta"), F.lit("Abrir.").alias("task_text"),
    )
    return rows.repartition(4, "doc_id")


def test_row_ids_work_out_their_rows_once(spark, counted):
    seen, task_type = counted
    got = O.assign_row_ids(_rows(spark, task_type)).orderBy("doc_order", "block_no").select("row_id").collect()
    assert [r.row_id for r in got] == list(range(1, N + 1))
    assert seen.value == N


def test_outline_works_out_its_rows_once(spark, counted):
    seen, task_type = counted
    rows = _rows(spark, task_type).select(
        "*", F.lit("instrucao_operacional").alias("b_category"), F.lit("documento_principal").alias("b_scope"),
        F.concat((F.col("block_no") % 4 + 1).cast("string"), F.lit(".1")).alias("b_section"), F.lit("").alias("b_item"),
        F.lit(None).cast("struct<item:string,hta:string,op_group:string>").alias("b_context"),
        (F.col("doc_id") % 2 == 0).alias("b_standalone"), F.lit(0).alias("b_stage"),
    )
    got = H.number_documents(rows, 1).where("task_type = 'Execução'").collect()
    assert seen.value == N
    for standalone in (True, False):
        for doc in {r.doc_id for r in got if (r.doc_id % 2 == 0) == standalone}:
            mine = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.block_no)
            ranks, counts, want = {}, {}, []
            for r in mine:
                group = r.block_no % 4
                rank = ranks.setdefault(group, len(ranks) + 1)
                counts[group] = counts.get(group, 0) + 1
                want.append(f"1.{rank}.{counts[group]}." if standalone else f"{rank}.{counts[group]}.")
            assert [r.hta for r in mine] == want


def test_keys_of_latin_and_other_letters(spark):
    texts = [
        "", "plain", "Ação crítica", "ÀÖØÞßŸ ǅ ɏ", "áê", "Ω ά", "ﬁm ½ ŉ Ĳ", "日本 가", "𝐀é", "̈́", "ǖɐ", None,
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in frame.select("i", T.match_key(F.col("t")).alias("key"), T.token_key(F.col("t")).alias("tokens")).collect()}

    def bare(form, text):
        return "".join(c for c in unicodedata.normalize(form, text) if unicodedata.category(c) != "Mn")

    for i, text in enumerate(texts):
        if text is None:
            assert got[i].key is None
        elif "가" not in text:  # Hangul stays whole
            assert got[i].key == bare("NFD", text).strip().upper(), text
            words = "".join(c if c.isascii() and c.isalnum() else " " for c in bare("NFKD", text).lower()).split()
            assert got[i].tokens == " ".join(words), text


def test_cells_are_taken_apart_only_where_they_must(spark):
    texts = {
        "tidy cell": "tidy cell", " edge": "edge", "edge ": "edge", "a  b": "a b", "a\tb": "a b", "a\n\n b ": "a\nb", "a\r\nb": "a\nb",
        "a b c": "a\nb c", "": "", " ": "", "\n": "", None: "", "　x": "x", "a\x1fb": "a b", "a\x85b": "a\nb",
    }
    frame = spark.createDataFrame([(t, w) for t, w in texts.items()], "t string, w string")
    got = frame.select("t", "w", T.cell_text(F.col("t")).alias("c")).collect()
    assert [r.c for r in got] == [r.w for r in got]
