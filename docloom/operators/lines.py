"""Line operators: split, clean, drop noise, collapse blanks, find boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V
from docloom.functions import text as T


def by_document(frame: DataFrame) -> DataFrame:
    """Hash-partition by document; Spark sizes the partitions from what it has written.

    The work per byte is heavy (many patterns per line): a low
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` serves such jobs.
    """
    return frame.repartition("doc_id")


def split_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 1 inside its document.

    The documents are hash-partitioned by ``doc_id`` before the lines exist, so the
    one exchange moves whole texts once and every later window, grouping or join on
    ``doc_id`` reuses it.  A document is one bounded row (see ``intake_validate``).
    """
    keep = [c for c in documents.columns if c != text]
    return (
        by_document(documents)
        .select(*keep, F.posexplode(T.split_lines(F.col(text))).alias("pos", "line"))
        .withColumn("line_no", (F.col("pos") + 1).cast("int"))
        .drop("pos")
    )


def map_lines(documents: DataFrame, text: str = "text") -> DataFrame:
    """``split_lines`` without the exchange, for uses that stay row-local."""
    keep = [c for c in documents.columns if c != text]
    return documents.select(
        *keep, F.posexplode(T.split_lines(F.col(text))).alias("pos", "line")
    ).select(*keep, (F.col("pos") + 1).cast("int").alias("line_no"), "line")


BULLET_GLYPH = "\uf0b7"
CHECK_GLYPH = "\uf0fc"
SPACE_GLYPH = "\uf020"


def _tidy(line: Column) -> Column:
    """Private-use list glyphs become bullets, each bullet after a line break."""
    has = lambda x, glyph: F.contains(x, F.lit(glyph))
    bare = T.let(
        T.normalize_ws(line),
        lambda x: F.when(has(x, SPACE_GLYPH), T.strip(F.translate(x, SPACE_GLYPH, ""))).otherwise(x),
    )
    broken = lambda x: T.strip(F.regexp_replace(x, T.cs(f"{V.WS}*{BULLET_GLYPH}{V.WS}*"), "\n• "))
    return T.let(bare, lambda x: F.when(has(x, BULLET_GLYPH), broken(x)).otherwise(x))


def clean_lines(lines: DataFrame) -> DataFrame:
    """Tidy every line; a lone check glyph turns the next non-empty line into a bullet."""
    tidy, text = _tidied(lines)
    return tidy.withColumn("line", text).drop("tidy", "pending")


def _tidied(lines: DataFrame) -> tuple[DataFrame, Column]:
    """The lines ``clean_lines`` keeps, and the text it gives them."""
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    tidy = lines.withColumn("tidy", _tidy(F.col("line")))
    glyph = F.col("tidy") == CHECK_GLYPH
    # the latest earlier non-empty line decides whether a bullet is pending
    state = F.when(glyph, F.lit(True)).when(F.col("tidy") != "", F.lit(False))
    pending = F.coalesce(F.last(state, ignorenulls=True).over(before), F.lit(False))
    led = F.col("tidy").startswith(CHECK_GLYPH)
    text = (
        F.when(led, F.concat(F.lit("• "), T.strip(F.translate("tidy", CHECK_GLYPH, ""))))
        .when(F.col("pending") & (F.col("tidy") != ""), F.concat(F.lit("• "), F.col("tidy")))
        .otherwise(F.col("tidy"))
    )
    text = T.let(text, lambda x: F.when(F.contains(x, F.lit("..")), F.regexp_replace(x, r"(?<=\d)\.\.(?=\d)", ".")).otherwise(x))

    def unmarked(x: Column) -> Column:
        bare = F.regexp_replace(x, T.ci("(?=[ip])" + V.PAGE_MARK), "")
        # tidy lines have clean edges, but for a lone bullet
        return T.let(bare, lambda y: F.when((y == x) & ~F.endswith(x, F.lit(" ")), x).otherwise(T.strip(y)))

    text = T.let(text, unmarked)
    return tidy.withColumn("pending", pending).where(~glyph), text


def noise_flag(line: Column, patterns: list[str] | None = None) -> Column:
    prefixes = "|".join(V.APPROVAL_PREFIXES)
    named = T.let(T.match_key(line), lambda key: (key == "INTERNA") | key.rlike(f"^(?:{prefixes})"))
    firsts = "".join(sorted({w[0] for w in ("INTERNA", *V.APPROVAL_PREFIXES)}))
    keyed = F.when(T.key_cannot_open_with(line, firsts), F.lit(False)).otherwise(named)
    flag = line.isin("_", ".") | line.rlike(T.cs(V.RULE_LINE)) | line.rlike(T.ci(V.NOISE_LINE)) | keyed
    if patterns:
        flag = flag | line.rlike("|".join(f"(?:{p})" for p in patterns))
    return flag


def drop_noise_lines(lines: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Remove separators, confidentiality marks, footers and approval lines."""
    return lines.where((F.col("line") == "") | ~noise_flag(F.col("line"), patterns))


def collapse_blank_lines(lines: DataFrame) -> DataFrame:
    """Keep one blank between text lines and none at either end of a document."""
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    blank = F.col("line") == ""
    previous = F.lag("line").over(doc)
    later_text = F.max(F.when(~blank, F.col("line_no"))).over(Window.partitionBy("doc_id"))
    flagged = lines.withColumn("_prev", previous).withColumn("_last", later_text)
    keep = ~blank | (
        F.col("_prev").isNotNull() & (F.col("_prev") != "") & (F.col("line_no") < F.col("_last"))
    )
    return flagged.where(keep).drop("_prev", "_last")


def clean_text_lines(documents: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Documents to cleaned lines (multi-bullet lines split into rows of their own)."""
    tidy, text = _tidied(split_lines(documents))
    keep = [c for c in tidy.columns if c not in ("line", "line_no", "tidy", "pending")]
    # a filter on the cleaned text would repeat its patterns in every test, so noise lines explode to nothing
    kept = T.let(text, lambda x: F.when((x == "") | ~noise_flag(x, patterns), F.split(x, "\n")))
    split = tidy.select(*keep, F.col("line_no").alias("_n"), F.posexplode(kept).alias("_p", "line"))
    order = Window.partitionBy("doc_id").orderBy("_n", "_p")
    numbered = split.withColumn("line_no", F.row_number().over(order)).drop("_n", "_p")
    return collapse_blank_lines(numbered)


def boilerplate_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """Line keys seen in at least ``min_docs`` documents.

    A repeated line may own a third of all rows, so rows are first reduced to one per
    (key, document) and only then counted by key; both steps combine map-side.
    """
    keyed = lines.select("doc_id", T.match_key(F.col("line")).alias("line_key")).where("line_key <> ''")
    per_doc = keyed.groupBy("line_key", "doc_id").agg(F.count(F.lit(1)).alias("hits"))
    return (
        per_doc.groupBy("line_key")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("hits").alias("n_lines"))
        .where(F.col("n_docs") >= min_docs)
    )


def drop_boilerplate(lines: DataFrame, min_docs: int) -> DataFrame:
    """Lines that are not boilerplate.

    One anti join on the line key.  Blank lines have no key to look up and join under one of their
    own, so they gather nowhere; a repeated line's partition is an ordinary skewed one, which
    Spark splits.
    """
    keys = boilerplate_keys(lines, min_docs).select("line_key")
    key = T.match_key(F.col("line"))
    own = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(c) for c in lines.columns]).cast("string"))
    keyed = lines.withColumn("line_key", T.let(key, lambda k: F.when(k != "", k).otherwise(own)))
    return keyed.join(keys, "line_key", "left_anti").drop("line_key")
