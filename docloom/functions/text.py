"""Text columns: normalisation, keys, outline numbers, flags.  Column -> Column.

Patterns carry ``(?U)`` (Unicode classes and word boundaries) and ``(?d)`` (only a
newline ends a line), so results do not depend on the JVM's regex defaults.
"""

from __future__ import annotations

import json
import re
import string
import unicodedata
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import fixed_values as V


def _close(pattern: str, start: int) -> int:
    """Position of the bracket that closes the one at ``start``."""
    depth, i, in_class = 0, start, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    raise ValueError(f"unbalanced pattern: {pattern}")


def _alternatives(body: str) -> list[str]:
    """``body`` cut at its own bars, not at those of groups and classes."""
    out, last, i, in_class = [], 0, 0, False
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            i = _close(body, i)
        elif c == "|":
            out.append(body[last:i])
            last = i + 1
        i += 1
    return [*out, body[last:]]


def _plain_start(word: str) -> bool:
    """Does the alternative open with one ASCII letter that no quantifier follows?"""
    return word[:1].isascii() and word[:1].isalpha() and word[1:2] not in ("?", "*", "+", "{")


def _by_letter(words: list[str]) -> str:
    """Alternatives as a tree over their first letters.

    Alternatives of different letters exclude each other and those of one letter keep their
    order, so the group matches the same text as the flat list.
    """
    if len(words) == 1:
        return words[0]
    if not all(map(_plain_start, words)):
        return f"(?:{'|'.join(words)})"
    heads: dict[str, list[str]] = {}
    for word in words:
        heads.setdefault(word[0].lower(), []).append(word[1:])
    arms = [letter + _by_letter(rest) for letter, rest in heads.items()]
    return arms[0] if len(arms) == 1 else f"(?:{'|'.join(arms)})"


#: shorter lists are tried as they stand
_MIN_WORDS = 5


def _is_word_list(body: str, words: list[str]) -> bool:
    return len(words) >= _MIN_WORDS and all(map(_plain_start, words)) and not re.search(r"(?<!\\)\((?!\?)", body)


def _either_case(letters: str) -> str:
    """Lower-case ASCII letters and all that equals one of them without regard to case, as one table lookup."""
    more = {"i": "\\u0130\\u0131", "k": "\\u212a", "s": "\\u017f"}
    others = "".join(more.get(x, "") for x in letters)
    return f"(?-i:[{letters}{letters.upper()}{f'[{others}]' if others else ''}])"


@lru_cache(maxsize=None)
def _factored(pattern: str) -> str:
    """A case-insensitive pattern with its long word lists as trees; matches the same text.

    Java tries the alternatives of a group one after the other at every word.  Where a word
    boundary stands before the list, the list's first letters are asked for ahead of it, as the
    Unicode boundary is the dearer test.
    """
    out, i, in_class, opened = "", 0, False, -1
    if pattern.startswith(r"\b") and _plain_start(pattern[2:]) and len(_alternatives(pattern)) == 1:
        out = f"(?={_either_case(pattern[2].lower())})"
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out += pattern[i:i + 2]
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif pattern.startswith("(?:", i):
            end = _close(pattern, i)
            words = _alternatives(pattern[i + 3:end])
            if _is_word_list(pattern[i + 3:end], words):
                letters = "".join(sorted({w[0].lower() for w in words}))
                before = next((b for b in (r"\b", r"\b(") if out.endswith(b) and not out.endswith("\\" + b)), None)
                if before == r"\b(" and len(_alternatives(pattern[opened + 1:_close(pattern, opened)])) > 1:
                    before = None
                if before and pattern[end + 1:end + 2] not in ("?", "*", "+", "{"):
                    out = out[:-len(before)] + f"(?={_either_case(letters)})" + before
                out += "(?:" + _by_letter(words) + ")"
                i = end + 1
                continue
        if c == "(" and not in_class:
            opened = i
        out += c
        i += 1
    return out


def ci(pattern: str) -> str:
    """Case-insensitive form of a pattern."""
    return "(?iUd)" + _factored(pattern)


def cs(pattern: str) -> str:
    """Case-sensitive form of a pattern."""
    return "(?Ud)" + pattern


_RUN = cs(f"{V.WS}+")
# V.WS_CHARS without the blank; the wide range is tested first, so other characters fail after one comparison
_WIDE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
# listed one by one, Latin characters share one table lookup; a range is a comparison of its own
_ODD = rf"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0{_WIDE}"
# single blanks need no replacement, so only longer runs and other whitespace match
_LONG_RUN = f" [ {_ODD}]+|[{_ODD}][ {_ODD}]*"


def let(col: Column, body) -> Column:
    """``body(value)`` with ``col`` evaluated once.

    Spark repeats an expression in every branch of a conditional that mentions it; a
    lambda over a one-element array binds it to a variable instead.
    """
    return F.get(F.transform(F.array(col), body), F.lit(0))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Trim Unicode whitespace.  Looks at the ends only, unlike a pattern."""
    return F.trim(col, F.lit(V.WS_CHARS))


def _any(tests) -> Column:
    return reduce(or_, tests)


def strip_chars(col: Column, chars: str) -> Column:
    return F.trim(col, F.lit(chars))


def rstrip_chars(col: Column, chars: str) -> Column:
    return F.rtrim(col, F.lit(chars))


def _any(tests) -> Column:
    return reduce(or_, tests)


def strip_ends(col: Column, chars: str) -> Column:
    """``strip_chars`` for long texts: Spark's trim walks the whole text, so the ends are looked at first."""
    loose = lambda x: _any([f(x, F.lit(c)) for f in (F.startswith, F.endswith) for c in chars])
    return let(col, lambda x: F.when(loose(x), F.trim(x, F.lit(chars))).otherwise(x))


def rstrip_ends(col: Column, chars: str) -> Column:
    loose = lambda x: _any([F.endswith(x, F.lit(c)) for c in chars])
    return let(col, lambda x: F.when(loose(x), F.rtrim(x, F.lit(chars))).otherwise(x))


# Latin characters but the odd ones, and blocks without any; a run of a class is read in one loop
_LATIN = "".join(f"\\x{c:02x}" for c in range(256) if chr(c) == " " or not chr(c).isspace())
_EVEN = rf"^[{_LATIN}[\u0100-\u167f\u2010-\u2027\u2030-\u205e\u2060-\u2fff\u3001-\ud7ff\ue000-\uffff]]*+\z"


def squeeze(col: Column) -> Column:
    """Every whitespace run becomes one blank; edges trimmed."""
    odd = lambda x: F.contains(x, F.lit("  ")) | ~x.rlike(_EVEN)
    return F.trim(let(col, lambda x: F.when(odd(x), F.regexp_replace(x, _LONG_RUN, " ")).otherwise(x)))


# V.LINE_BREAK, met by one class test a character
_BREAK = r"[\n\x0b\f\r\x1c\x1d\x1e\x85\u2028-\u2029](?:(?<=\r)\n)?"


_CUT = "\x01"


def split_at(col: Column, pattern: str) -> Column:
    """``split`` by a long pattern that never matches the empty string.

    Spark compiles the pattern of a split anew for every text, that of a replacement once; only texts
    that hold the mark already are split the slow way.
    """
    marked = lambda x: F.split(F.regexp_replace(x, pattern, _CUT), _CUT)
    return let(col, lambda x: F.when(F.contains(x, F.lit(_CUT)), F.split(x, pattern)).otherwise(marked(x)))


def split_lines(col: Column) -> Column:
    return F.split(col, _BREAK)


def first_line(col: Column) -> Column:
    return F.substring_index(col, "\n", 1)


def normalize_ws(col: Column) -> Column:
    """Blanks, tabs and no-break spaces in a row become one blank; edges trimmed.

    Few texts have any, and three byte searches cost less than one pattern.
    """
    return let(col, _normalized)


def _normalized(x: Column) -> Column:
    odd = F.contains(x, F.lit("  ")) | F.contains(x, F.lit("\t")) | F.contains(x, F.lit("\u00a0"))
    spaced = F.regexp_replace(F.replace(x, F.lit("\u00a0"), F.lit(" ")), "[ \t]{2,}|\t", " ")
    return strip(F.when(odd, spaced).otherwise(x))


def normalize_multiline(col: Column) -> Column:
    cleaned = F.transform(split_lines(col), normalize_ws)
    return F.array_join(F.filter(cleaned, lambda x: x != ""), "\n")


def cell_text(col: Column) -> Column:
    """Squeezed lines, blank ones dropped, breaks kept: the form of every output cell.

    Most cells are one tidy line; only others are taken apart.
    """
    return let(text_or_empty(col), _cell)


def _cell(x: Column) -> Column:
    blank = F.lit(" ")
    # all line breaks are among the odd characters
    odd = F.contains(x, F.lit("  ")) | F.startswith(x, blank) | F.endswith(x, blank) | x.rlike(f"[{_ODD}]")
    cleaned = F.filter(F.transform(split_lines(x), squeeze), lambda y: y != "")
    return F.when(odd, F.array_join(cleaned, "\n")).otherwise(x)


@lru_cache(maxsize=None)
def _folding(form: str) -> tuple[str, str, dict[str, str], str]:
    """What each code point becomes without its marks under a normal form.

    One-to-one results as two strings for ``translate``; all others (several characters, as for
    ligatures and fractions) as a mapping, with the ranges its characters lie in.  Hangul
    syllables only come apart into letters no key keeps, so they are left whole.
    """
    source, target, wide = [], [], {}
    for code in range(0xA0, 0x110000):
        if 0xAC00 <= code < 0xD7A4 or 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if unicodedata.category(char) == "Mn":
            continue
        base = "".join(c for c in unicodedata.normalize(form, char) if unicodedata.category(c) != "Mn")
        if base == char:
            continue
        if len(base) == 1:
            source.append(char)
            target.append(base)
        else:
            wide[char] = base
    runs: list[list[int]] = []
    for code in sorted(map(ord, wide)):
        if runs and code - runs[-1][1] < 64:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    listed = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)
    # one comparison tells the characters of most texts from all ranges
    return "".join(source), "".join(target), wide, f"\\x{{{runs[0][0]:x}}}-\\x{{10ffff}}&&[{listed}]"


#: first code point past the Latin blocks; combining marks come after it
_LATIN_END = 0x250


@lru_cache(maxsize=None)
def _latin_folding(form: str) -> tuple[tuple[str, str], str]:
    """The table of Latin letters, and a pattern for characters it does not serve."""
    source, target, wide, _ = _folding(form)
    pairs = [(a, b) for a, b in zip(source, target) if ord(a) < _LATIN_END]
    longer = "".join(f"\\x{{{ord(c):x}}}" for c in wide if ord(c) < _LATIN_END)
    return ("".join(a for a, _ in pairs), "".join(b for _, b in pairs)), f"[\\x{{{_LATIN_END:x}}}-\\x{{10ffff}}{longer}]"


def _fold(col: Column, form: str) -> Column:
    """``col`` decomposed, without combining marks.

    Plain ASCII is passed on, and texts of Latin letters need the short table alone: Spark compares
    the tables of ``translate`` in every row.  Only texts with a character in the ranges of longer
    results are taken apart for them.
    """
    source, target, wide, ranges = _folding(form)
    latin, beyond = _latin_folding(form)
    mapping = F.from_json(F.lit(json.dumps(wide)), "map<string,string>")
    parts = F.regexp_extract_all(col, F.lit(f"[{ranges}]|(?:(?![{ranges}])(?s:.))+"), F.lit(0))
    opened = F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(mapping, x), x)), "")
    longer = F.when(col.rlike(f"[{ranges}]"), opened).otherwise(col)
    folded = F.regexp_replace(F.translate(longer, source, target), r"[\u0300-\x{10ffff}&&\p{Mn}]+", "")
    return (
        F.when(F.octet_length(col) == F.length(col), col)
        .when(~col.rlike(beyond), F.translate(col, *latin))
        .otherwise(folded)
    )


def match_key(col: Column) -> Column:
    """Accent-free, whitespace-normalised, upper-cased comparison key."""
    return F.upper(normalize_ws(_fold(col, "NFD")))


def key_cannot_open_with(col: Column, letters: str) -> Column:
    """A cheap look at the first character: does it rule out a key that opens with one of the letters?

    A printable ASCII character keeps its place in the key; any other may vanish from it.
    """
    code = F.ascii(col)
    return code.between(33, 126) & ~code.isin(*[ord(c) for x in letters for c in (x.upper(), x.lower())])


def token_array(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(_fold(col, "NFKD")), F.lit("[a-z0-9]+"), F.lit(0))


_TOKEN = string.ascii_lowercase + string.digits
# what stands between tokens, but for single blanks
_BETWEEN = f"[^{_TOKEN}](?:(?<=[^ {_TOKEN}])[^{_TOKEN}]*|[^{_TOKEN}]+)"


def token_key(col: Column) -> Column:
    """Blank-joined lower-case alphanumeric tokens."""
    return F.trim(F.regexp_replace(F.lower(_fold(col, "NFKD")), _BETWEEN, " "))


# --- outline numbers ---------------------------------------------------------

_HIERARCHY = r"^(\d+(?:\.\d+){0,5})\.?\s+"


def outline_number(col: Column) -> Column:
    return F.regexp_extract(col, cs(_HIERARCHY), 1)


def outline_level(number: Column) -> Column:
    """Dots + 1; 0 where there is no number."""
    return F.when(number == "", F.lit(0)).otherwise(F.size(F.split(number, r"\.")))


def outline_rest(col: Column) -> Column:
    return strip(F.regexp_replace(col, cs(_HIERARCHY), ""))


def standard_item(text: Column) -> Column:
    """Number of the first line with its trailing dot kept."""
    return F.regexp_extract(first_line(text), cs(V.STANDARD_ITEM), 1)


def _unnumbered(text: Column) -> Column:
    """Does the text open with something other than a digit?  Spares most texts the dearer tests."""
    return ~text.rlike(cs(f"^{V.WS}*\\d"))


def numbered_item(line: Column) -> Column:
    number = rstrip_chars(F.regexp_extract(normalize_ws(line), cs(V.NUMBERED_ITEM), 1), ".")
    return F.when(_unnumbered(line), F.lit("")).otherwise(number)


def numbered_content(text: Column) -> Column:
    rest = F.regexp_extract(normalize_ws(text), cs(V.NUMBERED_ITEM), 2)
    return F.when(_unnumbered(text), F.lit("")).otherwise(strip(F.regexp_replace(rest, "^[-–— ]+", "")))


def item_depth(item: Column) -> Column:
    return F.size(F.split(rstrip_chars(item, "."), r"\."))


# --- tags, ratios, flags -----------------------------------------------------

def plain_key(value: str) -> str:
    """Driver-side twin of ``match_key`` for literals."""
    text = "".join(c for c in unicodedata.normalize("NFD", value) if unicodedata.category(c) != "Mn")
    return " ".join(text.split()).upper()


def keyword_tags(text: Column, lexicon=V.KEYWORDS, key: Column | None = None) -> Column:
    """Lexicon terms present in the text, lexicon order.  ``key``: the text's key, where it is known."""

    def tags(key: Column) -> Column:
        hits = [F.when(F.contains(key, F.lit(plain_key(term))), F.lit(term)) for term in lexicon]
        return F.array_compact(F.array(*hits))

    return let(match_key(text) if key is None else key, tags)


def caps_ratio(col: Column) -> Column:
    """Upper-case letters / letters; null without letters."""
    letters = F.length(F.regexp_replace(col, r"[^\p{L}]+", ""))
    upper = F.length(F.regexp_replace(col, r"[^\p{Lu}]+", ""))
    return upper / F.nullif(letters, F.lit(0))


def is_caps_item(text: Column) -> Column:
    return F.coalesce(caps_ratio(numbered_content(text)) >= V.CAPS_ITEM_RATIO, F.lit(False))


def ui_fragment(text: Column) -> Column:
    def of_key(key: Column) -> Column:
        words = F.filter(F.split(key, _RUN), lambda w: w != "")
        lone = F.size(F.filter(words, lambda w: F.length(w) == 1))
        return (
            (key == "")
            | key.rlike(cs(r"^\d+(?:\s+\d+){0,3}$"))
            | key.isin(*V.UI_LABELS)
            | text.rlike(cs(f"^{V.WS}*\\.:"))
            | ((F.size(words) >= 4) & (lone / F.size(words) >= 0.5))
        )

    return let(match_key(text), of_key)


def heading_markup(line: Column) -> Column:
    """Numbered upper-case lines become second-level headings."""
    return F.when(line.rlike(cs(V.MARKDOWN_HEADING)), F.concat(F.lit("## "), line)).otherwise(line)


def is_named_section(line: Column) -> Column:
    return ~_unnumbered(line) & strip(line).rlike(ci(V.NAMED_SECTION))


def is_structural_title(line: Column) -> Column:
    return ~_unnumbered(line) & let(
        normalize_ws(line), lambda x: x.rlike(ci(V.NAMED_SECTION)) | x.rlike(cs(V.NUMBERED_TITLE))
    )


def leaves_table(line: Column) -> Column:
    """A section of the document body, as opposed to a numbered table row."""
    return line.rlike(cs(V.OUTSIDE_TABLE)) | is_named_section(line)


# --- annexes, codes, suffixes ------------------------------------------------

def annex_from_filename(filename: Column) -> tuple[Column, Column]:
    """(annex id, title) named by the file, both empty for ordinary documents."""
    stem = strip(F.regexp_replace(strip(text_or_empty(filename)), cs(V.FILE_SUFFIX), ""))
    found = F.regexp_extract(stem, ci(V.ANNEX_FILENAME), 1)
    title = F.regexp_extract(stem, ci(V.ANNEX_FILENAME), 2)
    return F.upper(found), strip(title)


def is_flowchart(filename: Column) -> Column:
    return text_or_empty(filename).rlike(ci(V.FLOWCHART))


def annex_item(item: Column, scope: Column) -> Column:
    """Prefix items of annexes embedded in a document with the annex letter."""
    embedded = scope.startswith("anexo_") & ~scope.startswith("anexo_arquivo_")
    letter = F.upper(F.regexp_replace(scope, "^anexo_", ""))
    return F.when(
        (item != "") & embedded, F.concat(F.lit("Anexo "), letter, F.lit(" - "), item)
    ).otherwise(item)


def document_code_header(text: Column) -> Column:
    pattern = ci(V.DOCUMENT_CODE_TITLE)
    code = F.regexp_extract(text, pattern, 1)
    rewritten = F.concat(
        code, F.lit("-"), F.regexp_extract(text, pattern, 2), F.lit(" - "),
        strip(F.regexp_extract(text, pattern, 3)),
    )
    return F.when(code != "", rewritten).otherwise(text)


def bare_item(item: Column) -> Column:
    return rstrip_chars(strip(text_or_empty(item)), ".")


def hierarchy_item(item: Column) -> Column:
    """Item without annex prefix and trailing dots: the grouping key of numbering."""
    return rstrip_chars(F.regexp_replace(bare_item(item), ci(V.ANNEX_ITEM_PREFIX), ""), ".")


def suffix_item(text: Column, item: Column) -> Column:
    """Append `` (item)`` unless the text already ends with it."""
    tidy, shown, bare = squeeze(text_or_empty(text)), strip(text_or_empty(item)), bare_item(item)
    has = F.endswith(tidy, F.concat(F.lit("("), bare, F.lit(")"))) | F.endswith(
        tidy, F.concat(F.lit("("), bare, F.lit(".)"))
    )
    return F.when((tidy == "") | (bare == "") | has, tidy).otherwise(
        F.concat(tidy, F.lit(" ("), shown, F.lit(")"))
    )


def join_visual_lines(lines: Column) -> Column:
    """Only list items start a new line; every other line is glued to the previous one."""
    tidy = F.filter(F.transform(lines, normalize_ws), lambda x: x != "")
    joined = F.transform(
        tidy,
        lambda x, i: F.when(i == 0, x)
        .when(x.rlike(cs(V.LIST_ITEM)), F.concat(F.lit("\n"), x))
        .otherwise(F.concat(F.lit(" "), x)),
    )
    return F.array_join(joined, "")
