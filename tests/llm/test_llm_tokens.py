"""Byte-level BPE and packing against the tokenizer libraries."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from docloom.llm import packing
from docloom.llm.bpe import Codec, bpe_decode, bpe_encode, bpe_round_trip, read_ranks
from docloom.llm.packing import best_fit, pack, sequences

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "It's  we're <|endoftext|> \n\n a\tb \x1c!\x1c z\x85y\xa0\xa0k  ", " lead", "trail ", "日本語 テキスト 가각 ½Ⅷ ﬁn", "\n x", " ", "",
    None, "x　y  z", "Thhetionther, oneredatnt the!! ***", "a" * 3000 + "ab" * 700, "don't I'LL é İ ς. 12ab,,;", "word " * 30_000,
]


@pytest.fixture(scope="module")
def table(docs):
    return docs(list(enumerate(TEXTS)) + [(None, "null id"), (1, " lead")])


def test_ids_are_those_of_tiktoken(table, clash):
    import tiktoken

    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    rows = bpe_round_trip(clash(table), RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.ids == plain.encode_ordinary(text)
        assert bytes(r.data) == text.encode()


def test_encode_and_decode_alone(table, spark):
    tokens = bpe_encode(table, RANKS, public_tokenizers.PATTERN)
    assert bpe_decode(tokens, RANKS, public_tokenizers.PATTERN).count() == len(TEXTS) + 2
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.data) for r in bpe_decode(nothing, RANKS, public_tokenizers.PATTERN).collect()] == [b"", b""]
    assert bpe_encode(table.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_and_short_merges_agree():
    codec = Codec(RANKS, public_tokenizers.PATTERN)
    words = [b"thhetionerhe" * 5, b"abababab", b"aaaaaaaaa", "éauxmentique".encode()]
    assert codec.merge_words(words) == [codec.merge_long(w) for w in words]
    assert codec.merge_words([]) == []


def test_best_fit():
    bins, offsets, used = best_fit([60, 50, 40, 30, 20], 100)
    assert used == 2 and sorted(zip(bins, offsets, strict=True)) == [(0, 0), (0, 60), (1, 0), (1, 50), (1, 80)]
    assert best_fit([], 100) == ([], [], 0)


def expected_pieces(rows, capacity):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(WORDS), []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def check_places(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_pack_places_every_piece(table, clash, docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (1, " lead")]
    found = pack(clash(table.repartition(30)), WORDS).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(r)[:5] for r in found), key=key) == sorted(expected_pieces(rows, 4096), key=key)
    used = check_places(found, 4096)
    assert used == -(-sum(r.length for r in found) // 4096)
    assert pack(docs([]), WORDS).count() == 0


def test_tree_of_many_groups(docs, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    rows = [(k, "a " * (5 + k * 7 % 60)) for k in range(300)]
    frame = docs(rows).repartition(23, "doc_id")
    found = pack(frame, WORDS, capacity=100).collect()
    used = check_places(found, 100)
    # groups of some 13 pieces: bins merge whole, so a little room stays
    assert len(found) == 300 and used <= 1.1 * -(-sum(r.length for r in found) // 100)
    # only bins over half full: nothing can be merged, nothing is lost
    big = pack(docs([(k, "a " * 60) for k in range(40)]).repartition(9, "doc_id"), WORDS, capacity=100).collect()
    assert check_places(big, 100) == 40


def test_sequences_hold_the_ids(docs):
    from tokenizers import Tokenizer

    rows = [(k, f"some words {k} " * (1 + k % 9)) for k in range(30)]
    frame = docs(rows)
    placed = pack(frame, WORDS, capacity=64)
    places = placed.collect()
    spark = frame.sparkSession
    ids = {r.sequence_id: r.ids for r in sequences(frame, spark.createDataFrame(places, placed.schema), WORDS).collect()}
    tokenizer = Tokenizer.from_file(WORDS)
    own = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in rows}
    for r in places:
        assert ids[r.sequence_id][r.offset : r.offset + r.length] == own[r.doc_id][r.start : r.start + r.length]


def test_query_digests(spark):
    from docloom.llm.token_queries import op3_byte_bpe

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in op3_byte_bpe(spark, folder).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
