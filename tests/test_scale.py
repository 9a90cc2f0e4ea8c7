"""What a row costs and what a task gets: long jobs must not repeat their patterns nor deal few parts."""

import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V
from docloom.functions import text as T
from docloom.operators import lines as L
from docloom.operators import segments as S
from docloom.plans import corpus

VERBS = ("abrir", "ABRA", "abr", "abrirá", "reabrir", "avaliar a", "só abrir", "SÓ ABRIR", "parar o", "parar os", "deve-se", "informar imediatamente", "informar ao", "Kabrir", "ligar", "İnformar", "tomar as ações", "x solicitar.")


def _patterns():
    return [
        V.IMPERATIVE_CUE, V.ACTION_CUE, V.ACTION_START, V.CONDITION_PREFIX, V.TECHNICAL_PARAMETER, V.TECHNICAL_MARKER,
        V.NEGATED_MODAL, V.DOCUMENT_METADATA, rf"^.*?\b({V.ACTION_VERBS}\b.+)$", rf",\s*(?={V.ACTION_VERBS}\b)",
    ]


def test_word_lists_are_trees_that_match_the_same(spark):
    assert len(re.findall("abortar", T.ci(V.IMPERATIVE_CUE))) == 0
    texts = [Row(x=f"{a}{v}{b}") for v in VERBS for a in ("", "o texto, ", "1.2 ") for b in ("", " e fechar a válvula", ", abra")]
    texts += [Row(x=x) for x in ("PSHH-1", "PSH", "LAL 2", "como fazer: abrir", "não deverá abrir", "NÃO DEVE abrir", "quando o", "se", "após x", "AÇÃO DE RTA", "")]
    frame = spark.createDataFrame(texts)
    for p in _patterns():
        found = lambda pattern: F.regexp_extract_all("x", F.lit(pattern), F.lit(0))
        assert frame.where(~found("(?iUd)" + p).eqNullSafe(found(T.ci(p)))).count() == 0, p


def test_line_breaks_and_blanks_as_before(spark):
    odd = ["a\r\nb\n\rc", "\r\r\n\n", "a\x0bb\x0cc\x1cd\x1ee\u2028f\x85g", "", "a  b", "  a \tb ", "\ta", "a\u00a0", "a\u00a0 b", "\u3000x\u2003y\u1680"]
    frame = spark.createDataFrame([Row(x=x) for x in odd] + [Row(x=None)], "x string")
    plain = F.trim(F.regexp_replace(F.replace("x", F.lit("\u00a0"), F.lit(" ")), "[ \t]{2,}|\t", " "), F.lit(V.WS_CHARS))
    assert frame.where(~T.split_lines(F.col("x")).eqNullSafe(F.split("x", V.LINE_BREAK))).count() == 0
    assert frame.where(~T.normalize_ws(F.col("x")).eqNullSafe(plain)).count() == 0


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_cleaning_and_merging_work_out_a_text_once(spark):
    docs = spark.createDataFrame([(1, "1. OBJETIVO\nPágina 1 de 2\nabrir a\nb")], "doc_id long, text string")
    cleaned = L.clean_text_lines(docs)
    assert _plan(cleaned).count("página") == 1
    plan = _plan(S.merge_fragments(S.segment_blocks(cleaned)))
    gathered = max(re.findall(r"collect_list\(.*", plan), key=lambda p: p.count("struct"))
    assert gathered.count("regexp_replace") <= 2
    assert [r.line for r in cleaned.orderBy("line_no").collect()] == ["1. OBJETIVO", "", "abrir a", "b"]


def test_dealt_parts_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t.parquet")
    spark.range(20000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(corpus, "PART_BYTES", 10_000)
    dealt = corpus.spread(spark.read.parquet(path))
    assert dealt.rdd.getNumPartitions() > 4 * cores
    assert dealt.count() == 20000
