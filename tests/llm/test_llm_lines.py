"""Line dedup against plain edit distance."""

import random

import pytest
from docloom.llm.line_dedup import drop_repeated_lines, line_classes, within
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, text, n):
    out = list(text)
    for _ in range(n):
        k, kind = rnd.randrange(len(out)), rnd.randrange(3)
        if kind == 0:
            out.insert(k, rnd.choice("abé"))
        elif kind == 1:
            del out[k]
        else:
            out[k] = rnd.choice("abé")
    return "".join(out)


@pytest.mark.parametrize("tau", [1, 2])
def test_banded_distance(spark, tau):
    rnd, rows = random.Random(tau), []
    while len(rows) < 500:
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(tau + 3, 16)))
        b = edited(rnd, a, rnd.randint(0, tau + 2))
        if len(b) > tau and abs(len(a) - len(b)) <= tau:
            rows.append((a, b, distance(a, b) <= tau))
    frame = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert frame.where(within("a", "b", tau) != F.col("want")).count() == 0


def brute(rows, tau=2, per_edit=5):
    places = [(d, n, line) for d, t in rows if t is not None and d is not None for n, line in enumerate(t.split("\n"), 1)]
    first = {}
    for d, n, line in sorted(places):
        if line.strip(" \t\n\x0b\f\r"):
            first.setdefault(line, (d, n))
    fits = lambda a, b, k: k and abs(len(a) - len(b)) <= k and distance(a, b) <= k
    near = {a: [b for b in first if b != a and fits(a, b, min(tau, len(a) // per_edit, len(b) // per_edit))] for a in first}
    out = set()
    for d, n, line in places:
        at = min([first[line], *(first[b] for b in near[line])]) if line in first else (d, n)
        out.add((d, n, *at, len(near.get(line, [])), at == (d, n)))
    return out


def corpus():
    rnd = random.Random(11)
    bases = ["".join(rnd.choice("abcdeét no") for _ in range(rnd.randint(3, 60))) for _ in range(24)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            base = rnd.choice(bases)
            lines.append(rnd.choice([base, edited(rnd, base, rnd.randint(0, 3)), "short", "", "x" * rnd.randint(1, 26)]))
        rows.append((d, "\n".join(lines)))
    return [*rows, (90, None), (91, ""), (92, "\n\n"), (93, "z" * 70_000), (94, "z" * 69_998 + "yy"), (95, "z" * 69_990)]


def test_against_brute_force(docs, clash):
    rows = corpus()
    found = line_classes(clash(docs(rows[:-3] + rows[-1:]))).collect()
    want = brute(rows[:-3] + rows[-1:])
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_very_long_lines(docs):
    found = line_classes(docs(corpus()[-3:])).collect()
    assert sorted((r.doc_id, r.first_doc_id, r.n_links) for r in found) == [(93, 93, 1), (94, 93, 1), (95, 95, 0)]


def test_documents_without_repeated_lines(docs, clash):
    line, near = "this line is long enough to count", "this line is long enough to count!"
    frame = clash(docs([(1, f"{line}\nshort\n{line}"), (2, near), (3, f"new words in a line of some length\n{near}\nshort"), (4, None), (5, ""), (6, " ")]))
    out = drop_repeated_lines(frame)
    assert out.columns == frame.columns and out.schema["n_chars"].dataType == frame.schema["n_chars"].dataType
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {
        1: (f"{line}\nshort", 39), 3: ("new words in a line of some length", 34), 4: (None, None), 5: ("", 0), 6: (" ", 1)
    }
    assert drop_repeated_lines(docs([])).count() == 0


def test_repeated_rows(docs):
    line = "this line is long enough to count"
    out = drop_repeated_lines(docs([(1, line), (1, line), (2, line), (None, line)])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, line), (1, line), (1, line)]


def test_short_lines(spark, docs, tmp_path):
    from docloom.llm.line_queries import op1_line_dedup

    rows = [(1, "All rights reserved.\n\n \nabc"), (2, "abd\nAll rights reserved\n\n \nabc"), (3, " " * 30), (4, " " * 30), (5, "page 1\npage 22\nabcdefghij"),
            (6, "page 2\nabcdefgh"), (7, "abxdefghik\nabcdefgh!")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op1_line_dedup(spark, str(tmp_path)).collect()]
    assert set(got) == brute(rows) and len(got) == len(brute(rows))
    kept = {r[:2]: r[5] for r in got}
    # one edit for every five characters: near lines leave, under five characters only equal ones
    assert not kept[2, 2] and not kept[2, 5] and kept[2, 1] and not kept[6, 1] and not kept[7, 1] and kept[6, 2]


def test_blocks_of_mutual_copies(spark, docs, monkeypatch):
    from docloom.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BLOCK_TEXTS", 7)
    base = "one line of which very many variants exist in this table of documents"
    rows = [(k, base[: k % 60] + chr(97 + k % 26) + base[k % 60 + 1 :]) for k in range(120)] + [(200 + k, f"item {k:02d}") for k in range(40)]
    found = line_classes(docs(rows)).collect()
    assert {tuple(r) for r in found} == brute(rows) and len(found) == len(rows)
    assert max(r.n_links for r in found) > 90


def test_pipeline_stage_drops_short_repeats(spark, docs):
    from corpus_pipeline import line_dedup

    out = line_dedup(spark, docs([(1, "tail\n\nAll rights reserved."), (2, "head\n\nAll rights reserved.")]), "")
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("tail\n\nAll rights reserved.", 26), 2: ("head\n", 5)}
