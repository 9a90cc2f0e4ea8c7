"""Actions of long texts: what is sorted stays narrow, patterns are compiled once, results as ever."""

from pyspark.sql import functions as F

from docloom.functions import actions as A
from docloom.functions import text as T
from docloom.operators import rowgen as X


def _split(spark, *texts):
    frame = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, block_no int, text string")
    return X.split_actions(frame)


def test_sorted_rows_do_not_carry_the_source(spark):
    """A text yields several actions; its source and description leave before these are sorted."""
    plan = _split(spark, "Abrir a linha.").select("doc_id", "block_no", "row_no", "task_text")
    tree = plan._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [line for line in tree if "Window" in line or "Sort" in line]
    assert windows and not any(part in line for line in windows for part in ("seg#", "_src#", "_descr#"))


def test_values_used_twice_are_worked_out_once(spark):
    """Spark repeats an expression wherever a conditional mentions it."""
    times = lambda column, name: str(column).count(f"{name}(")
    assert times(A.finish_infinitive(F.col("x")), "regexp_extract") == 1
    assert times(A.last_entity(F.col("x")), "regexp_extract_all") == 2
    assert times(A.condition_body(F.col("x")), "regexp_replace") == 1


def test_actions_of_one_text(spark):
    texts = [
        "Caso haja gás, recomenda-se coletar x e fechar y. Abra z. Não deverá abrir w.",
        "Abrir a e fechar b, medir c\x01d", "Após o teste, DEVERÁ ser solicitada a ordem", "sem verbo algum", None,
        "Na válvula de dreno, bloquear em campo",
    ]
    got = {}
    for r in _split(spark, *texts).orderBy("block_no", "row_no").collect():
        got.setdefault(r.block_no, []).append(r.task_text)
    assert got == {
        0: ["Coletar x, caso haja gás.", "Fechar y, caso haja gás.", "Abrir z."],
        1: ["Abrir a.", "Fechar b.", "Medir c\x01d."], 2: ["Solicitar a ordem, após o teste."], 3: [""], 4: [""],
        5: ["Bloquear a válvula de dreno em campo."],
    }


def test_split_at_is_split(spark):
    texts = ["", "a", "a, abrir b", "a, abrir b e fechar c", ", abrir", "a\x01, abrir b", " e abrir ", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", T.split_at(F.col("t"), A.COORDINATION).alias("a"), F.split("t", A.COORDINATION).alias("b")).collect():
        assert r.a == r.b, r.t


def test_tokens_and_blanks(spark):
    texts = {
        "a b": "a b", " a  b ": "a b", "a, b": "a b", "a ,b": "a b", "-a-": "a", "Á É": "a e", "": "", " ": "", ",": "", "a . ; b": "a b",
    }
    frame = spark.createDataFrame([(t, w) for t, w in texts.items()], "t string, w string")
    assert all(r.k == r.w for r in frame.select("w", T.token_key(F.col("t")).alias("k")).collect())
    odd = {"a b": "a b", "a b": "a b", "a᠎b": "a᠎b", "\x1ca": "a", "日　本": "日 本", "• a": "• a", "a b": "a b", "😀  a": "😀 a"}
    frame = spark.createDataFrame([(t, w) for t, w in odd.items()], "t string, w string")
    assert all(r.k == r.w for r in frame.select("w", T.squeeze(F.col("t")).alias("k")).collect())


def test_ends_are_trimmed_as_given(spark):
    texts = {"; a;": "a", "·a.": "a", "a": "a", "": "", " ;": "", None: None, "a;b": "a;b"}
    frame = spark.createDataFrame([(t, w) for t, w in texts.items()], "t string, w string")
    assert all(r.k == r.w for r in frame.select("w", T.strip_ends(F.col("t"), " ;,.·").alias("k")).collect())
