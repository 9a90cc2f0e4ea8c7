"""Near duplicates and components against brute force."""

import random

import numpy as np
from docloom.llm.common import components
from docloom.llm.minhash import block_links, keep_one, near_duplicates, shingle_set, sketch


def sets_of(rows):
    out = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        out[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    return out


def brute(rows, num, den):
    sets, root = sets_of(rows), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    base = [word() for _ in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):  # variants close to the base, mostly not to each other
        own = list(base)
        for _ in range(rnd.randint(1, 3)):
            own[rnd.randrange(150)] = word()
        rows.append((k, " ".join(own)))
    rows += [(100 + k, " ".join(word() for _ in range(rnd.randint(1, 80)))) for k in range(40)]
    rows += [(200 + k, rows[100 - 40 + k % 3][1]) for k in range(9)]  # exact copies
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One two"), (304, "one\x0bTWO"), (305, "É one"), (306, "é one")]
    rows += [(310, "x " * 40_000), (311, "x " * 39_000)]
    return rows


def test_against_brute_force(docs, clash):
    rows = corpus()
    for num in (85, 80):
        found = near_duplicates(clash(docs(rows)), num, 100).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, num, 100)
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)
        assert len(found) == len(rows)


def test_blocks_of_a_large_bucket(docs, monkeypatch):
    monkeypatch.setattr("docloom.llm.minhash.PAIRED", 1)
    monkeypatch.setattr("docloom.llm.minhash.BLOCK", 7)
    rows = corpus()
    found = near_duplicates(docs(rows), 85, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 85, 100)


def test_block_links_are_a_forest_of_all_links():
    sets = [np.arange(k, k + 20) for k in range(0, 12)]
    ids, roots = np.arange(12), np.arange(12)
    links = block_links((ids, roots, sets), None, 80, 100)
    assert len(links) == 11
    half = block_links((ids[:6], roots[:6], sets[:6]), (ids[6:], roots[6:], sets[6:]), 80, 100)
    assert half and all(a < 6 <= b for a, b in half)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 7, 100, 5000):
        common = rng.integers(0, 1 << 62, 3 * n).astype(np.uint64)
        a, b = np.unique(common[: 2 * n]), np.unique(common[n:])
        same = (sketch(a, 2048) == sketch(b, 2048)).mean()
        assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.06
        assert sketch(a, 160).max() < np.iinfo(np.uint64).max


def test_words_are_cut_at_ascii_space_only():
    memo = {}

    class Memo(dict):
        def __missing__(self, k):
            return hash(k) & 0xFFFFFFFF

    a = shingle_set("a\xa0b c", 5, Memo(memo))
    assert len(a) == 1 and not np.array_equal(a, shingle_set("a b c", 5, Memo(memo)))


def test_nulls_repeats_and_empty(docs):
    text = "one two three four five six"
    found = near_duplicates(docs([(None, text), (5, text), (5, text), (7, text)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0, r.kept) for r in found) == [
        (False, 5, 5, True), (False, 5, 5, True), (False, 7, 5, False), (True, 0, 0, True)
    ]
    assert near_duplicates(docs([])).count() == 0


def test_keep_one_keeps_columns(docs, clash):
    text = "one two three four five six"
    frame = clash(docs([(5, text), (7, text), (8, None), (9, "other")]))
    kept = keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [5, 8, 9]


def test_components(spark):
    rnd = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 50)] + [(1000 + rnd.randrange(300), 1000 + rnd.randrange(300)) for _ in range(160)]
    edges += [(5000, 5000 + k) for k in range(1, 200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {x: find(x) for x in root if find(x) != x}
    assert {r.node: r.root for r in found if r.node != r.root} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_id_with_two_texts(docs):
    x, y = "one text of some words that is here twice or more often", "quite another text with words nobody else has in this table"
    rows = [(3, x), (5, x), (5, y), (7, y + " now"), (8, x), (8, x)]
    frame = docs(rows)
    found = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(frame).collect())
    assert found == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False), (8, 3, False), (8, 3, False)]
    assert sorted((r.doc_id, r.text) for r in keep_one(frame).collect()) == [(3, x), (5, y)]
