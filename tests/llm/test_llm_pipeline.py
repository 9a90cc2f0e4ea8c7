"""The pipeline, stage by stage, against plain versions."""

import corpus_pipeline
import public_tokenizers
import pytest
from docloom.llm.common import stage, table
from tokenizers import Tokenizer


def plain_lines(rows):
    from test_llm_lines import brute

    kept = {(d, n) for d, n, *_, k in brute(rows) if k}
    out = []
    for d, text in rows:
        if text is None or d is None:
            out.append((d, text))
            continue
        lines = text.split("\n")
        left = [x for n, x in enumerate(lines, 1) if (d, n) in kept]
        if len(left) == len(lines) or "".join(left).strip():
            out.append((d, "\n".join(left)))
    return out


@pytest.fixture(scope="module")
def folder(docs, spark, tmp_path_factory):
    from test_llm_near import corpus

    words = [(i, t.replace("a ", "a.\n") if t else t) for i, t in corpus() if not t or len(t) < 5000]
    junk = [(500 + k, "WOW!! NOW!! BUY!! $$$ " * 4 + f"{k}!!") for k in range(30)]
    path = tmp_path_factory.mktemp("tables")
    docs([*words, *junk, (None, "no id here at all")]).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 500), 0) for i, _ in [*words, *junk] if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    from test_llm_near import brute

    docs = table(spark, folder, "documents")
    columns, rows = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    seen = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, folder), name)
        assert docs.columns == columns
        seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
        assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
    good = seen["quality_classifier"]
    assert not [i for i, _ in good if i is not None and i >= 500] and len(good) >= len(rows) - 35
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    lines = seen["line_dedup"]
    assert sorted(lines, key=key) == sorted(plain_lines(good), key=key)
    groups = brute([x for x in lines if x[0] is not None], 80, 100)
    near = seen["minhash_near_dedup"]
    assert sorted(near, key=key) == sorted([x for x in lines if x[0] is None or groups[x[0]][1] == x[0]], key=key)

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    sizes = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in near}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes
    whole = corpus_pipeline.run(spark, folder).collect()
    order = lambda r: (r.doc_id is None, r.doc_id or 0, r.piece)
    assert [tuple(r)[:5] for r in sorted(whole, key=order)] == [tuple(r)[:5] for r in sorted(packed, key=order)]


def test_no_documents(spark, folder):
    docs = table(spark, folder, "documents").limit(0)
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, docs, folder)
        assert out.count() == 0
