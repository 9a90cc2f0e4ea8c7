"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

Sketch (Dahlgaard, Knudsen, Thorup, 2017).  A document is the set of hashes of its five-word
shingles.  The sketch has ``t`` coordinates.  In round ``i < t`` every element is thrown into
one hashed bin with the value (i, hash); in round ``t + j`` every element goes to bin ``j``.
A bin keeps its least value, and rounds stop once all bins are filled, so after at most ``2 t``
rounds every coordinate holds a minimum over the *whole* set: coordinates agree with the
probability of the Jaccard similarity, with the concentration of independent MinHash, while a
long document is hashed only once or twice.

Banding.  ``t = bands * rows`` coordinates; documents that agree on a whole band are candidates.
With 32 bands of 5 rows a pair at similarity 0.85 is missed with probability 7e-9, at 0.80 with
3e-6.

Verification.  Every link is confirmed on full sets.  Equal sets are one representative
beforehand, so groups of copies cost one row.  Then

1. every set is verified against the pivot (least member) it shares most buckets with, and the links'
   components are found; a group of near copies is mostly one component by then;
2. a set and another pivot of its buckets are verified only where they are in different components;
3. only buckets that still hold several components go on: in small ones all pairs *across*
   components are verified, larger ones are cut into blocks of ``BLOCK`` members, pairs of
   blocks become tasks of their own, and each emits one spanning forest of the links it found.

So no bucket is gathered whole in one task, no bucket emits all its pairs, and no link that
could join two components stays untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import components, fresh, stage

WORDS = 5
BANDS = 32
ROWS = 5
#: Buckets up to this many members list their pairs, larger ones are verified block by block.
PAIRED = 12
#: Members and shingles of a block (one longer set is a block of its own).
BLOCK = 128
BLOCK_SHINGLES = 1 << 20
#: Up to this many ids (8 bytes each) are broadcast to fetch their texts.
BROADCAST_IDS = 2_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), element by element."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    """Word -> 64-bit hash, bounded: it is emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, words: int, memo: dict) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text.

    ``bytes.lower`` folds A-Z only and ``bytes.split`` cuts at space and \\t to \\r only, which
    is what the word pattern ``[^\\x20\\x09-\\x0D]+`` says.  Fewer than ``words`` words are one
    shingle; none, or no text, is the empty set.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    n = len(found) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mix(total + hashes[k : k + n] * _ODD[k % 5] + np.uint64(k))
    return np.unique(total)


def sketch(values: np.ndarray, t: int) -> np.ndarray:
    """``t`` coordinates of a non-empty set; see the module text."""
    bins = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    n, i = len(values), 0
    step = max(1, min(t, 2 * t // n))
    while i < t:
        rounds = np.arange(i, min(t, i + step), dtype=np.uint64)
        seeds = mix(rounds + np.uint64(0x51ED27))
        hashed = mix(values[None, :] ^ seeds[:, None])
        where = ((hashed >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)
        # the round leads the value: an earlier round always wins
        value = (rounds[:, None] << np.uint64(48)) | (mix(hashed) >> np.uint64(16))
        np.minimum.at(bins, where.ravel().astype(np.intp), value.ravel())
        i += step
        if bins.max() < np.iinfo(np.uint64).max:
            return bins
    for j in np.flatnonzero(bins == np.iinfo(np.uint64).max):
        round_no = np.array([t + j], dtype=np.uint64)
        least = mix(mix(values ^ mix(round_no + np.uint64(0x51ED27)))).min()
        bins[j] = (round_no[0] << np.uint64(48)) | (least >> np.uint64(16))
    return bins


def band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    rows = coordinates.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for k in range(rows.shape[1]):
        key = mix(key * _ODD[0] + rows[:, k])
    return key.view(np.int64)


def _sketches(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in batches:
            counts, first, second, keys = [], [], [], []
            for text in batch.column(1):
                values = shingle_set(text.as_py(), words, memo)
                counts.append(len(values))
                if len(values):
                    digest = xxhash.xxh3_128_digest(values.tobytes())
                    a, b = np.frombuffer(digest, np.int64)
                    first.append(int(a))
                    second.append(int(b))
                    keys.append(band_keys(sketch(values, bands * rows), bands))
                else:
                    first.append(None)
                    second.append(None)
                    keys.append(np.empty(0, np.int64))
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), batch.column(2), batch.column(3),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "bands", "t1", "t2"],
            )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):  # sets are as large as the texts
                part = batch.slice(start, 512)
                sets = [shingle_set(x.as_py(), words, memo).view(np.int64) for x in part.column(1)]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))],
                    names=["rep", "shingles"],
                )

    return run


def _linked(inter, a, b, num: int, den: int):
    """den * intersection >= num * union, in whole numbers."""
    return inter * den >= (a + b - inter) * num


def _fits(a: str, b: str, num: int, den: int) -> str:
    """The sizes alone allow a link."""
    return f"least({a}, {b}) * {den} >= greatest({a}, {b}) * {num}"


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.where(_linked(inter, F.size("sa"), F.size("sb"), num, den)).select("a", "b")


def _forest(a: np.ndarray, b: np.ndarray, labels: dict) -> list[tuple[int, int]]:
    """Of the given links, those that join different trees."""
    out = []

    def root(x):
        while labels.get(x, x) != x:
            labels[x] = labels.get(labels[x], labels[x])
            x = labels[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            labels[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def block_links(
    left: tuple[np.ndarray, np.ndarray, list], right: tuple[np.ndarray, np.ndarray, list] | None, num: int, den: int
) -> list[tuple[int, int]]:
    """Spanning forest of the links across components between two blocks (or within one).

    A block is (ids, components, sets).  Intersections are counted through the sorted list of
    (shingle, member) entries, one member of the left block at a time; a block's sets are bounded in all.
    """
    a_ids, a_roots, a_sets = left
    b_ids, b_roots, b_sets = right or left
    a_n = np.array([len(s) for s in a_sets])
    b_n = np.array([len(s) for s in b_sets])
    elements = np.concatenate(b_sets)
    owners = np.repeat(np.arange(len(b_sets)), b_n)
    order = np.argsort(elements, kind="stable")
    elements, owners = elements[order], owners[order]
    out, labels = [], {}
    for k, own in enumerate(a_sets):
        lo = np.searchsorted(elements, own, "left")
        hi = np.searchsorted(elements, own, "right")
        reach = hi - lo
        positions = np.repeat(lo - np.concatenate(([0], np.cumsum(reach)[:-1])), reach) + np.arange(reach.sum())
        inter = np.bincount(owners[positions], minlength=len(b_sets))
        hit = _linked(inter, a_n[k], b_n, num, den) & (b_roots != a_roots[k])
        if right is None:
            hit[: k + 1] = False
        found = np.flatnonzero(hit)
        out += _forest(np.full(len(found), a_ids[k]), b_ids[found], labels)
    return out


def _blocks(num: int, den: int):
    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        def block(part: pa.Table):
            sets = [np.asarray(x.values) for x in part.column("shingles")]
            return part.column("rep").to_numpy(), part.column("root").to_numpy(), sets

        i, j = key[1].as_py(), key[2].as_py()
        own = group.column("own").to_numpy()
        left = block(group.filter(pa.array(own == i)))
        right = None if i == j else block(group.filter(pa.array(own == j)))
        links = block_links(left, right, num, den) if left[2] and (right is None or right[2]) else []
        return pa.table(
            {"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())}
        )

    return run


def near_duplicates(
    docs: DataFrame, num: int = 80, den: int = 100, words: int = WORDS, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents are linked when den * |intersection| >= num * |union| of their shingle sets;
    ``component_id`` is the least doc_id reachable over links, ``kept`` marks it.

    Nulls and edges: a null or blank text has an empty set, is linked with nothing and kept.
    A null doc_id takes no part in linking; its component is null and it is kept.  Rows that
    repeat a doc_id are told apart by their sets: those with the same set share a component, another set has its own.
    Columns other than doc_id and text are not read.
    """
    return _marked(docs, num, den, words, bands, rows).select("doc_id", "n_shingles", "component_id", "kept")


def _marked(docs: DataFrame, num: int, den: int, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``near_duplicates`` with a digest of each row's text (t1, t2)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = stage(
        base.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(23), "text").alias("t2")).mapInArrow(
            _sketches(words, bands, rows),
            "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, t1 long, t2 long",
        ),
        "minhash-sketches",
    )
    usable = sketched.where("doc_id is not null and h1 is not null")
    groups = usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    reps = stage(
        # keyed by the representative: a group of copies is no hot key
        usable.withColumn("own", F.struct("h1", "h2"))
        .join(groups.select("rep", F.struct("h1", "h2").alias("group")), F.col("doc_id") == F.col("rep"))
        .where("own = group").dropDuplicates(["rep", "h1", "h2"]).select("rep", "h1", "h2", "n_shingles", "bands"),
        "minhash-reps",
    )
    members = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bk"))
    buckets = members.groupBy("bk").agg(
        F.min(F.struct("rep", "n")).alias("pivot"), F.count("*").alias("size")
    ).where("size > 1")
    shared = stage(
        members.join(buckets, "bk").select("bk", "rep", "n", "size", F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pn")),
        "minhash-buckets",
    )
    needed = stage(shared.select("rep").distinct(), "minhash-ids")
    # a checked size decides whether ids travel to the texts or both are exchanged
    wanted = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    texts = base.where("doc_id is not null").join(wanted, F.col("doc_id") == F.col("rep"), "left_semi")
    sets = stage(
        texts.select("doc_id", "text").mapInArrow(_sets(words), "rep long, shingles array<long>"), "minhash-sets"
    )
    star = stage(
        shared.where("rep <> pivot").where(_fits("n", "pn", num, den))
        .groupBy(F.col("rep").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("buckets")),
        "minhash-star",
    )
    nearest = star.groupBy("a").agg(F.max(F.struct("buckets", -F.col("b"))).alias("x")).select("a", (-F.col("x.col2")).alias("b"))
    first = stage(_verify(nearest, sets, num, den), "minhash-links")
    roots = components(first, "minhash-first")
    rooted = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    rest = star.join(rooted("a"), "a", "left").join(rooted("b"), "b", "left").where(
        "coalesce(root_a, a) <> coalesce(root_b, b)"
    ).select("a", "b")
    first = stage(first.unionByName(_verify(rest, sets, num, den)), "minhash-star-links")
    second = _across(shared, components(first, "minhash-second"), sets, num, den)
    links = stage(first.unionByName(second), "minhash-all-links")
    final = components(links, "minhash-final")
    return _labelled(sketched, groups, final)


def _across(shared: DataFrame, roots: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between members of one bucket that lie in different components so far."""
    tagged = shared.join(roots, shared.rep == roots.node, "left").select(
        "bk", "rep", "n", F.coalesce("root", "rep").alias("root")
    )
    mixed = tagged.groupBy("bk").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"),
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
    ).where("lo <> hi").select("bk", "size", "blocks")
    open_rows = stage(tagged.join(mixed, "bk"), "minhash-open")
    listed = F.col("size") <= PAIRED
    few = open_rows.where(listed)
    x = few.select("bk", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    y = few.select("bk", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    pairs = (
        x.join(y, "bk").where("a < b and ra <> rb").where(_fits("na", "nb", num, den)).select("a", "b").distinct()
    )
    many = open_rows.where(~listed).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn(
        "last", F.col("blocks") - 1
    )
    spread = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).select(
        "bk", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "root"
    )
    blocks = (
        spread.join(sets, "rep").groupBy("bk", "i", "j").applyInArrow(_blocks(num, den), "a long, b long")
    )
    return _verify(pairs, sets, num, den).unionByName(blocks).distinct()


def _labelled(sketched: DataFrame, groups: DataFrame, final: DataFrame) -> DataFrame:
    """Bring a component's least doc_id back to every row."""
    rooted = groups.join(final, groups.rep == final.node, "left").select(
        "h1", "h2", F.coalesce("root", "rep").alias("component_id")
    )
    usable = "doc_id is not null and h1 is not null"
    linked = sketched.where(usable).join(rooted, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id", "t1", "t2")
    alone = sketched.where(f"not ({usable})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "t1", "t2")
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near duplicates: of each group the least doc_id stays, all columns kept.

    Rows leave by doc_id and text, so where rows repeat a doc_id each of its texts is decided on its own; rows that repeat
    both stay or leave together.
    """
    gone = fresh(docs, "doc_id_gone", "text_gone_1", "text_gone_2")
    drop = _marked(docs, num, den).where("not kept").select(*[F.col(c).alias(g) for c, g in zip(("doc_id", "t1", "t2"), gone, strict=True)]).distinct()
    here = (F.col("doc_id").cast("long"), F.xxhash64("text"), F.xxhash64(F.lit(23), "text"))
    return docs.join(drop, [h == F.col(g) for h, g in zip(here, gone, strict=True)], "left_anti")
