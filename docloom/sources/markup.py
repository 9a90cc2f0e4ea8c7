"""Page text extraction: HTML to ordered text lines, one row-local expression chain."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

# applied in order; blocks end lines, cells end with a tab
_STEPS = (
    (r"(?is)<!--.*?-->", " "),
    (r"(?is)<script\b.*?</script\s*>", " "),
    (r"(?is)<style\b.*?</style\s*>", " "),
    (r"(?is)<nav\b.*?</nav\s*>", " "),
    (r"(?is)<head\b.*?</head\s*>", " "),
    (r"(?is)<noscript\b.*?</noscript\s*>", " "),
    (r"[\t\r\n]+", " "),
    (r"(?i)</(?:td|th)\s*>", "\t"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|footer|header|body|html|blockquote|pre)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
)

#: control characters go after decoding, as references may name them
_CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"

#: name -> code point of the references decoded by name
ENTITIES = {**name2codepoint, "apos": 39}
_REPLACEMENT = 0xFFFD


def _character(point: Column) -> Column:
    """The character of a code point; blanks of any kind are a space, what is no character U+FFFD."""
    legal = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
    safe = F.when(point.isin(9, 10, 13, 160), 32).when(legal, point).otherwise(_REPLACEMENT)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def decode_entities(text: Column, entities: dict[str, int] = ENTITIES) -> Column:
    """Named, decimal and hexadecimal references to characters, each once; unknown ones stay as they are.

    The text is cut at its ampersands, so a decoded ampersand never starts another reference.
    """
    points = F.create_map(*[F.lit(x) for pair in entities.items() for x in pair])

    def piece(part: Column, at: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{0,31});", 1)
        hexed = F.conv(F.substring(name, 3, 7), 16, 10).try_cast("int")
        point = (
            F.when(name.rlike("^#[xX]"), hexed).when(name.startswith("#"), F.substring(name, 2, 9).try_cast("int"))
            .otherwise(F.try_element_at(points, name))
        )
        known = (at > 0) & (name != "") & point.isNotNull()
        return (
            F.when(known, F.concat(_character(point), F.substr(part, F.length(name) + 2)))
            .when(at > 0, F.concat(F.lit("&"), part)).otherwise(part)
        )

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&"), piece), "")).otherwise(text)


def markup_text(html: Column, entities: dict[str, int] = ENTITIES) -> Column:
    out = html
    for pattern, repl in _STEPS:
        out = F.regexp_replace(out, pattern, repl)
    return F.regexp_replace(decode_entities(out, entities), _CONTROL, "")


def _row_text(line: Column) -> Column:
    cells = F.transform(F.split(line, "\t"), T.squeeze)
    return F.array_join(F.filter(cells, lambda c: c != ""), "\t")


def _text_lines(html: Column, entities: dict[str, int]) -> Column:
    return F.filter(F.transform(F.split(markup_text(html, entities), "\n"), _row_text), lambda x: x != "")


def page_text_extract(pages: DataFrame, entities: dict[str, int] = ENTITIES) -> DataFrame:
    """``(page_id, html)`` to numbered lines; pages without text yield no row here but one in ``page_text_rejected``.

    Document order is kept, paragraphs end lines, table rows are tab-joined non-empty
    cells, references are decoded, control characters go.  Nothing is shuffled.
    """
    return pages.select("page_id", F.posexplode(_text_lines(F.col("html"), entities)).alias("_p", "line")).select(
        "page_id", (F.col("_p") + 1).cast("int").alias("line_no"), "line"
    )


def page_text_rejected(pages: DataFrame, entities: dict[str, int] = ENTITIES) -> DataFrame:
    """``(page_id, reason)`` of the pages that yield no line: ``no_content`` (null or blank) or ``no_text``."""
    html = F.col("html")
    blank = html.isNull() | (T.squeeze(html) == "")
    empty = F.size(F.coalesce(_text_lines(html, entities), F.array().cast("array<string>"))) == 0
    reason = F.when(blank, "no_content").when(empty, "no_text")
    return pages.select("page_id", reason.alias("reason")).where("reason is not null")
