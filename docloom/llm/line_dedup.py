"""Line dedup: a segment-partition edit join over all distinct lines, DataFrame functions only.

Two lines are linked when few insertions, deletions or substitutions of characters turn one into the
other: one for every ``PER_EDIT`` characters of the shorter line, ``tau`` at most.  So lines under
``PER_EDIT`` characters link by equality alone, as a single edit makes another line of them.  A line
points at the earliest line (by doc_id, then place) among itself and the lines linked with it, and
stays if that is itself.  Blank lines are left alone.

1. Lines are reduced to distinct texts with their first place, so a line with a third of all
   occurrences is one row; counting is combined before the exchange.
2. Classes: texts whose length allows ``t`` edits are joined for t edits.  Index: a text of ``n``
   characters is cut into ``t + 1`` segments.  Within ``t`` edits at least one survives whole.
3. Probe: a text looks up the substrings that a surviving segment of a text of ``n - t .. n``
   characters can be.  If segment ``i`` is the first one without an edit, at most ``i`` edits lie
   before it and at most ``t - i`` after it, so only starts shifted that little count.  Keys
   are (t, segment number, segment length, segment); lengths that cut alike share a key.
4. Rows that share no key with another text leave by semi joins, which emit no pairs.
5. The texts of a key meet in blocks of bounded number and size: a row is a block of indexed and
   a block of probing texts.  Inside a row, a pair counts under the least key it shares only, must agree
   in a letter signature (64 parity bits, of which an edit flips at most two), and is verified by
   Hyyro's bit-parallel recurrence on a band of ``2 t + 1`` diagonals.  A row gives one row for each text
   with links: their number and the earliest place.  A group of mutual near copies never becomes pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import fresh, stage

TAU = 2
PER_EDIT = 5
#: Up to this many candidate ids (16 bytes each) are broadcast to fetch their texts.
BROADCAST_IDS = 1_000_000
#: texts and characters of a block
BLOCK_TEXTS = 128
BLOCK_CHARS = 1 << 20


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 1), line: every line of every non-null text with a doc_id."""
    return docs.where("text is not null and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no") + 1)


def _digested(docs: DataFrame) -> DataFrame:
    """Lines that are not blank, with a 128-bit identity."""
    return split_lines(docs).where(F.col("line").rlike(r"\S")).withColumns(
        {"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(17), "line")}
    )


def distinct_lines(docs: DataFrame) -> DataFrame:
    """h1, h2, doc_id, line_no, line: the first place of each distinct line.

    The limit of one row a line also runs before the exchange.
    """
    first = Window.partitionBy("h1", "h2").orderBy("doc_id", "line_no")
    return _digested(docs).withColumn("turn", F.row_number().over(first)).where("turn = 1").drop("turn")


def signature(line: Column) -> Column:
    """Parity of the number of characters with each code modulo 64, as one long."""
    return F.aggregate(
        F.split(line, ""), F.lit(0).cast("long"),
        lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)),
    )


def _place(n: Column, i: int, tau: int, shift: int = 0) -> Column:
    """Segment ``i`` of a text of ``n`` characters, moved by ``shift``: number, start and size in one long."""
    cut = lambda k: F.floor(n * k / (tau + 1)).cast("long")
    return (F.lit(i).cast("long") * (1 << 60)) + (cut(i) + shift) * (1 << 30) + cut(i + 1) - cut(i)


def index_places(n: Column, tau: int) -> Column:
    """Where the segments of a text of ``n`` characters lie."""
    return F.array(*[_place(n, i, tau) for i in range(tau + 1)])


def probe_places(n: Column, tau: int) -> Column:
    """Where a surviving segment of a text of ``n - tau`` to ``n`` characters may lie in one of ``n``."""
    return F.array_distinct(F.array(*[
        _place(n - less, i, tau, shift)
        for less in range(tau + 1)
        for i in range(tau + 1)
        for shift in range(-tau, tau + 1)
        if abs(shift) <= i and abs(less - shift) <= tau - i
    ]))


def keyed(texts: DataFrame, places: Column, tau: int, name: str) -> DataFrame:
    """A row (key, text's h1, class) for each place; the key is hashed after the rows are made, so one
    small expression runs in a loop."""
    rows = texts.select(F.col("h1").alias(name), "line", F.explode(places).alias("at"))
    start, size = F.shiftright("at", 30).bitwiseAND(F.lit((1 << 30) - 1)), F.col("at").bitwiseAND(F.lit((1 << 30) - 1))
    segment = F.substring("line", start.cast("int") + 1, size.cast("int"))
    return rows.select(F.xxhash64(F.shiftright("at", 60), size, segment, F.lit(tau)).alias("key"), name, F.lit(tau).alias("t"))


def within(a: str, b: str, tau: int) -> Column:
    """``within_sql`` as a column."""
    return F.expr(within_sql(a, b, tau))


def _compact(sql: str) -> str:
    return " ".join(sql.split())


def within_sql(a: str, b: str, tau: int) -> str:
    """Whether the edit distance of two string columns of more than ``tau`` characters, whose
    lengths differ by at most ``tau``, is at most ``tau``.

    Bit ``k`` at column ``j`` stands for row ``j - tau + k`` of the distance matrix; ``vp`` and ``vn`` say
    that a cell is one more or less than the cell above it.  ``d`` follows the band's lowest diagonal to
    the last row of ``a``, then that row to the end of ``b``.
    """
    low = (1 << (2 * tau + 1)) - 1
    hits = " + ".join(f"if(get(c.x, j - {tau + 1} + {k}) = get(c.y, j - 1), {1 << k}L, 0L)" for k in range(2 * tau + 1))
    return f"""
      transform(array(named_struct('x', split({a}, ''), 'y', split({b}, ''), 'm', char_length({a}), 'n', char_length({b}))), c ->
        aggregate(
          transform(sequence(1, c.n), j -> named_struct('eq', {hits}, 'j', j)),
          named_struct('vp', {((1 << (tau + 1)) - 1) << tau}L, 'vn', 0L, 'd', {tau}),
          (s, e) -> transform(
            array(((((e.eq & s.vp) + s.vp) ^ s.vp) | e.eq | s.vn) & {low}L),
            d0 -> transform(
              array(named_struct('p', (s.vn | ~(d0 | s.vp)) & {low}L, 'n', d0 & s.vp)),
              h -> named_struct(
                'vp', (h.n | ~(shiftright(d0, 1) | h.p)) & {low}L,
                'vn', shiftright(d0, 1) & h.p,
                'd', s.d + if(e.j <= c.m - {tau},
                  if((d0 & {1 << (2 * tau)}L) = 0, 1, 0),
                  cast(shiftright(h.p, c.m - e.j + {tau}) & 1 as int) - cast(shiftright(h.n, c.m - e.j + {tau}) & 1 as int))
              ))[0])[0],
          s -> s.d <= {tau}))[0]
    """


def edit_class(texts: DataFrame, t: int, tau: int) -> DataFrame:
    """The texts that may be the shorter or the longer one of a pair with exactly ``t`` edits allowed."""
    n = F.char_length("line")
    return texts.where(n >= PER_EDIT * t) if t == tau else texts.where(n.between(PER_EDIT * t, PER_EDIT * (t + 1) - 1 + t))


def _keys(texts: DataFrame, tau: int) -> DataFrame:
    """h1, key, t, indexed: the keys under which a text meets another one."""
    n, index, probes = F.char_length("line"), None, None
    for t in range(1, tau + 1):
        own = edit_class(texts, t, tau)
        i, p = keyed(own, index_places(n, t), t, "h1"), keyed(own, probe_places(n, t), t, "h1b")
        index, probes = (i, p) if index is None else (index.unionByName(i), probes.unionByName(p))
    other = [index.key == probes.key, index.h1 != probes.h1b]
    return stage(
        index.join(probes, other, "left_semi").select("key", "h1", "t", F.lit(True).alias("indexed"))
        .unionByName(probes.join(index, other, "left_semi").select("key", F.col("h1b").alias("h1"), "t", F.lit(False).alias("indexed"))),
        "lines-keys",
    )


def _blocks(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, t, u, v: blocks of indexed and of probing texts, each with all keys it has on its side."""
    keys = found.groupBy("h1", "t", "indexed").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    held = stage(keys.join(wanted, "h1"), "lines-held")
    members = held.withColumn("key", F.explode("keys"))
    crowded = members.groupBy("key", "indexed").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("n") / BLOCK_CHARS)).alias("blocks")
    ).where("blocks > 1")
    dealt = members.join(crowded, ["key", "indexed"], "left").withColumn(
        "block", F.pmod(F.xxhash64("h1", F.lit(5)), F.coalesce("blocks", F.lit(1)))
    )
    one = F.struct("h1", "h2", "doc_id", "line_no", "line", "n", "bits", "keys")
    grouped = dealt.groupBy("key", "t", "indexed", "block").agg(F.collect_list(one).alias("m"))
    side = lambda indexed, name: grouped.where(indexed).select("key", "t", F.col("m").alias(name))
    return side("indexed", "us").join(side("not indexed", "vs"), ["key", "t"])


def _linked_in_block(tau: int) -> Column:
    """The texts of a row of blocks that have links there: h1, h2, n_links, first (their earliest place)."""
    check = " ".join(f"when {t} then {_compact(within_sql('u.line', 'v.line', t))}" for t in range(1, tau + 1))
    linked = f"""
      (u.n < v.n or (u.n = v.n and u.h1 < v.h1)) and v.n - u.n <= t and (t = {tau} or u.n < {PER_EDIT} * (t + 1))
      and bit_count(u.bits ^ v.bits) <= 2 * t and array_min(array_intersect(u.keys, v.keys)) = key and case t {check} end
    """
    place = "named_struct('doc_id', {0}.doc_id, 'line_no', {0}.line_no)".format
    told = lambda x, y, ys, hit: f"""
      named_struct('h1', {x}.h1, 'h2', {x}.h2, 'own', {place(x)}, 'near', transform(filter({ys}, ({y}, k) -> {hit}), {y} -> {place(y)}))
    """  # noqa: E731
    return F.expr(f"""
      transform(array(transform(us, u -> transform(vs, v -> {linked}))), hits ->
        transform(
          filter(
            concat(
              transform(us, (u, i) -> {told('u', 'v', 'vs', 'hits[i][k]')}),
              transform(vs, (v, j) -> {told('v', 'u', 'us', 'hits[k][j]')})
            ),
            x -> size(x.near) > 0),
          x -> named_struct('h1', x.h1, 'h2', x.h2, 'n_links', cast(size(x.near) as long), 'first', least(x.own, array_min(x.near)))
        ))[0]
    """)


def linked_lines(texts: DataFrame, tau: int = TAU) -> DataFrame:
    """h1, h2, n_links, doc_id, line_no: of each linked text the earliest place among it and its links."""
    found = _keys(texts, tau)
    ids = stage(found.select("h1").distinct(), "lines-ids")
    # a checked size decides whether ids travel to the texts or both are exchanged
    few = ids.count() <= BROADCAST_IDS
    wanted = texts.join(F.broadcast(ids) if few else ids, "h1", "left_semi").withColumns(
        {"n": F.char_length("line"), "bits": signature(F.col("line"))}
    )
    return _blocks(found, wanted).select(F.explode(_linked_in_block(tau)).alias("e")).groupBy("e.h1", "e.h2").agg(
        F.sum("e.n_links").alias("n_links"), F.min("e.first").alias("first")
    ).select("h1", "h2", "n_links", "first.doc_id", "first.line_no")


def line_classes(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """One row per line: doc_id, line_no, first_doc_id, first_line_no, n_links, kept.

    ``first_*`` is the earliest place of the line's text or of a text linked with it; ``n_links`` counts
    the *different* texts linked with it; ``kept`` says that the line itself is that place.  Blank lines
    (nothing but white space) point at themselves and are kept.

    Nulls and edges: rows with a null text or doc_id have no lines; an empty text is one empty line.
    Rows that repeat a doc_id count as one document: places that coincide are all kept. Only doc_id
    and text are read, so other columns cannot clash.
    """
    docs = docs.select("doc_id", "text")
    texts = stage(distinct_lines(docs), "lines-distinct")
    links = stage(linked_lines(texts, tau), "lines-linked")
    firsts = texts.select("h1", "h2", F.col("doc_id").alias("own_doc"), F.col("line_no").alias("own_line")).join(
        links.select("h1", "h2", "n_links", F.col("doc_id").alias("link_doc"), F.col("line_no").alias("link_line")),
        ["h1", "h2"], "left",
    ).select(
        "h1", "h2", F.coalesce("link_doc", "own_doc").alias("first_doc_id"),
        F.coalesce("link_line", "own_line").alias("first_line_no"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    classed = _digested(docs).drop("line").join(firsts, ["h1", "h2"]).select(
        "doc_id", "line_no", "first_doc_id", "first_line_no", "n_links"
    )
    alone = split_lines(docs).where(~F.col("line").rlike(r"\S")).select(
        "doc_id", "line_no", F.col("doc_id").alias("first_doc_id"), F.col("line_no").alias("first_line_no"),
        F.lit(0).cast("long").alias("n_links"),
    )
    return classed.unionByName(alone).withColumn(
        "kept", (F.col("doc_id") == F.col("first_doc_id")) & (F.col("line_no") == F.col("first_line_no"))
    )


def drop_repeated_lines(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one; all columns kept.

    ``n_chars``, where there is one, is the new length.  Documents of which nothing but white space is
    left leave; those that had no more before stay as they are.
    """
    flags, key, cut = fresh(docs, "line_flags", "doc_key", "text_cut")
    decided = line_classes(docs, tau).groupBy(F.col("doc_id").alias(key)).agg(
        F.array_sort(F.collect_set(F.struct("line_no", "kept"))).alias(flags), F.bool_and("kept").alias(cut)
    ).where(~F.col(cut))
    # one flag a line number; where rows repeat a doc_id, a line kept in one of them is kept
    single = F.expr(f"transform(filter({flags}, (x, i) -> not (get({flags}, i + 1).line_no <=> x.line_no)), x -> x.kept)")
    joined = docs.join(
        decided.select(key, single.alias(flags)), F.col("doc_id").cast("long") == F.col(key), "left"
    ).withColumn(
        cut,
        F.when(F.col(flags).isNull(), F.col("text")).otherwise(
            F.expr(f"array_join(filter(split(text, '\\n'), (x, i) -> coalesce(get({flags}, i), true)), '\n')")
        ),
    ).where(F.col(flags).isNull() | F.col(cut).rlike(r"\S"))
    new = {"text": F.col(cut)}
    for column, kind in docs.dtypes:
        if column.lower() == "n_chars":
            new[column] = F.when(F.col(flags).isNull(), F.col(column)).otherwise(F.char_length(cut)).cast(kind)
    return joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
