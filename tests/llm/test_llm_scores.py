"""Language-model scores and tokenizer alignment against plain counting."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from docloom.llm import slices
from docloom.llm.alignment import align_tokenizers, byte_of_letter
from docloom.llm.backoff_lm import MASS, score_texts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The cat sat.  the cat sat", " lead", "trail \n", "the\tCAT\x0b sat\x1cx\x85y\xa0z", "日本語 テキスト ½Ⅷ ﬁn é İ ς", "", None, "   ", "a b a b a b",
    "The cat sat.  the cat sat", "x▁y ▁z ▁▁ w", "<|endoftext|> <s> <0x41> </s>", "a  b   c    d \n\n e 　f", "a" * 3000 + " " + "ab" * 700,
    "don't I'LL 12ab,,; it's", "\x00 nul", "word " * 5000, "🙂🙂 naïve ﷺ", "\n", "a\r\nb", " \x1c x \x1c\x1c y",
]


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(TEXTS), (None, "null id cat"), (1, " lead"), (5000, "word " * 40)] + [(100 + k, f"some words {k % 7} the cat {k % 3}") for k in range(60)]


def plain_scores(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\n"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    single, pairs, states = Counter(), Counter(), Counter()
    for own, out in zip(words, held, strict=True):
        if not out:
            single.update(own)
            pairs.update(zip(["\t", *own], own, strict=False))
            states.update(["\t", *own[:-1]])
    n, v = sum(single.values()), len(single)
    out = []
    for (i, _), own, h in zip(rows, words, held, strict=True):
        p1 = [(single[w] + 0.5) / (n + 0.5 * (v + 1)) for w in own]
        score = sum(math.log10((pairs[s, w] + MASS * p) / (states[s] + MASS)) for s, w, p in zip(["\t", *own], own, p1, strict=False))
        out.append((i, h, len(own), sum(single[w] > 0 for w in own), n, sum(map(math.log10, p1)), score))
    return out


def close(a, b):
    return a[:5] == b[:5] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[5:], b[5:], strict=True))


@pytest.mark.parametrize("size", [200, 16 << 20])
def test_scores(docs, clash, rows, monkeypatch, size):
    monkeypatch.setattr(slices, "BUCKET_KEYS", 1500)
    got = sorted((tuple(r) for r in score_texts(clash(docs(rows).repartition(3)), slice_bytes=size).collect()), key=str)
    want = sorted(plain_scores(rows), key=str)
    assert len(got) == len(want) and all(close(a, b) for a, b in zip(got, want, strict=True))


def test_score_edges(docs):
    assert score_texts(docs([])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = score_texts(docs([(only, "nothing to learn from")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (5, 0, 0, 0.0, 0.0)


def test_probabilities_sum_to_one(docs):
    known = [i for i in range(99) if zlib.crc32(str(i).encode()) % 5 != 1]
    train = list(zip(known, ["a b a c", "b a", "c c b"], strict=False))
    ask = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:5]
    # the last word's share of a text "a x" for all x, the end, and unknown words
    probes = [(i, f"a {w}") for i, w in zip(ask, ("a", "b", "c", "zzz"), strict=False)] + [(ask[4], "a")]
    got = {r.doc_id: r.score for r in score_texts(docs(train + probes)).collect()}
    mass, n, v = MASS, 12, 4
    first = math.log10((1 + mass * 3.5 / (n + 0.5 * (v + 1))) / (3 + mass))
    after = {"a": 3, "b": 3, "c": 3, "zzz": 0}
    end = {w: (Counter(t.split()[-1] for _, t in train)[w] + mass * 3.5 / (n + 0.5 * (v + 1))) / (c + mass) for w, c in after.items()}
    shares = [10 ** (got[i] - first) / end[w] for i, w in zip(ask, ("a", "b", "c", "zzz"), strict=False)]
    assert sum(shares) + 10 ** (got[ask[4]] - first) == pytest.approx(1)


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    letters = byte_of_letter()
    seen, texts = defaultdict(int), {}
    for _, text in rows:
        if text and text not in texts:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            want = (" " + text).encode()
            if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
                texts[text] = None
                continue
            ends = []
            for parts in (bytes_a, bytes_b):
                at, own = 0, []
                for p in parts:
                    at += len(p)
                    own.append(at)
                ends.append(own)
            shared = sorted(set(ends[0]) & set(ends[1]))
            groups, start = [], 0
            for end in shared:
                groups.append(tuple([i for i, e in zip(ids, own, strict=True) if start < e <= end] for ids, own in zip((ids_a, ids_b), ends, strict=True)))
                start = end
            texts[text] = (len(ids_a), len(ids_b), groups)
    for _, text in rows:
        if text and texts[text]:
            for pair in {(x, y) for g, h in texts[text][2] for x in g for y in h}:
                seen[pair] += 1
    best = defaultdict(int)
    for (x, _), n in seen.items():
        best[x] = max(best[x], n)
    out = []
    for i, text in rows:
        found = texts.get(text) if text else None
        if not found:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups = found
        links = [(x, y) for g, h in groups for x in g for y in h]
        written = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, n_a, n_b, len(groups), len(links), sum(seen[p] == best[p[0]] for p in links), sum(seen[p] for p in links),
                    hashlib.sha256(written.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("size", [200, 16 << 20])
def test_alignment(docs, clash, rows, monkeypatch, size):
    monkeypatch.setattr(slices, "BUCKET_KEYS", 1500)
    got = sorted((tuple(r) for r in align_tokenizers(clash(docs(rows).repartition(3)), BYTES, PIECES, size).collect()), key=str)
    want = sorted(plain_alignment(rows), key=str)
    assert got == want and sum(r[1] > 0 for r in got) > 60


def test_alignment_edges(spark, docs):
    assert align_tokenizers(docs([]), BYTES, PIECES).count() == 0
    assert [tuple(r) for r in align_tokenizers(docs([(1, None), (2, "")]), BYTES, PIECES).orderBy("doc_id").collect()] == [
        (1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")
    ]
    broken = spark.sql("select 7L as doc_id, cast(unhex('61FF62') as string) as text union all select 8L, 'fine here'")
    got = {r.doc_id: r for r in align_tokenizers(broken, BYTES, PIECES).collect()}
    assert got[7].n_a == 0 and got[7].groups_sha256 == "" and got[8].n_a == 2


def test_whole_sample(spark):
    from docloom.llm.alignment_queries import op13_token_alignment

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op13_token_alignment(spark, folder).collect()), key=str) == sorted(plain_alignment(rows), key=str)


def test_whole_sample_scores(spark):
    from docloom.llm.lm_queries import op12_backoff_lm

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op12_backoff_lm(spark, folder).collect()), key=str)
    assert all(close(a, b) for a, b in zip(got, sorted(plain_scores(rows), key=str), strict=True))
    out = [r for r in got if r[1]]
    assert sum(r[6] for r in out) > sum(r[5] for r in out)  # better than single words on texts it has not seen
