"""Cleaning, clipping and measuring texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresmith import vocab
from loresmith.functions.lookup import let

# --- fixed values: patterns ------------------------------------------------------------------------------------------
# White space of any kind, beyond ASCII too (the pattern sign for it means ASCII only).
SPACES = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACES}]"
INVISIBLE = "[\u200b-\u200f\u202a-\u202e\ufeff]"
MENTION = "<@[A-Z0-9]+>"
CHANNEL = r"<#[A-Z0-9]+\|([^>]+)>"
LINK = r"<(https?://[^|>]+)\|([^>]+)>"
KEEP_LAYOUT = ("table", "excel_raw_table", "conversation")
URL = rf"https?://[^{SPACES})]+"
LINE_BREAK = "\r\n|\n|\r"
_SPACE_RANGES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
                 (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]  # the same characters as in SPACES
SPACE_CHARACTERS = "".join(chr(c) for first, last in _SPACE_RANGES for c in range(first, last + 1))
BOT_MENTION = r"<@([UW][A-Z0-9]+)(\|[^>]*)?>"
DEBUG_FLAG = r"(?i)(^|\s)--debug\b"
WIDE_SPACES = "[\u00a0\u2007\u202f\u2009\u200a\u200b]"
HEADING_LINE = r"^\s{0,3}#{1,6}\s+(.*?)\s*$"
EMPHASIS_LINE = r"^[\*_]{1,2}[^*_]+[\*_]{1,2}\s*:?\s*$"
OMITTED = "\n\n... (중략, 원본은 길어서 일부만 전달) ...\n\n"


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def replaced(text: Column, mark: Callable[[Column], Column], pattern: str, by: str) -> Column:
    """``regexp_replace``, run only where ``mark``, a cheap condition that every match implies, holds."""
    return let(text, lambda s: F.when(mark(s), F.regexp_replace(s, pattern, by)).otherwise(s))


def holds(*parts: str) -> Callable[[Column], Column]:
    """A mark: the text contains one of the parts."""
    return lambda s: reduce(lambda a, b: a | b, [F.contains(s, F.lit(p)) for p in parts])


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def strip_end(text: Column) -> Column:
    """Remove white space of any kind at the end."""
    return F.rtrim(text, F.lit(SPACE_CHARACTERS))


def compose(text: Column) -> Column:
    """Canonical composition; only rows beyond ASCII leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def clean_markup(text: Column, content_type: Column) -> Column:
    """Everything of :func:`clean_text` except the composition."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), INVISIBLE, "")
    s = replaced(s, holds("\r"), "\r\n|\r", "\n")
    s = replaced(s, holds("<@"), MENTION, "[멘션]")
    s = replaced(s, holds("<#"), CHANNEL, "#$1")
    s = replaced(s, holds("<http"), LINK, "$2 ($1)")
    s = replaced(s, holds(" \n", "\t\n"), "[ \t]+\n", "\n")
    loose = holds("  ", " \t", "\t ", "\t\t")
    s = replaced(s, lambda x: ~F.coalesce(content_type.isin(*KEEP_LAYOUT), F.lit(False)) & loose(x), "[ \t]{2,}", " ")
    return strip(replaced(s, holds("\n\n\n"), "\n{3,}", "\n\n"))


def clean_text(text: Column, content_type: Column, normalize: bool = True) -> Column:
    """Light cleaning; tables and conversations keep their inner blanks."""
    return clean_markup(compose(text) if normalize else text, content_type)


def shorten_urls(text: Column) -> Column:
    """Every URL becomes ``[link:domain]``."""
    def shorten(given: Column) -> Column:
        named = F.regexp_replace(given, rf"https?://([^{SPACES})/?#]+)[^{SPACES})]*", "[link:$1]")
        return F.when(F.contains(given, F.lit("://")), F.regexp_replace(named, URL, "[link:link]")).otherwise(given)

    return strip(let(text, shorten))


def drop_noise_lines(text: Column, min_chars: int = 1) -> Column:
    kept = F.filter(F.split(text, LINE_BREAK), lambda line: F.length(strip(line)) >= min_chars)
    return F.array_join(kept, "\n")


def truncate(text: Column, n: int | Column) -> Column:
    """Keep n characters, the last three being dots."""
    limit = n if isinstance(n, Column) else F.lit(n)
    short = strip_end(F.substring(text, F.lit(1), (limit - 3).cast("int")))
    cut = F.when(limit <= 3, F.substring(text, F.lit(1), limit.cast("int"))).otherwise(F.concat(short, F.lit("...")))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def clip(text: Column, n: int) -> Column:
    """Keep n characters, the last one being an ellipsis."""
    cut = F.concat(strip_end(F.substring(text, 1, n - 1)), F.lit("…"))
    return F.when(F.length(text) <= n, text).otherwise(cut)


def head_and_tail(text: Column, n: int = 8000, tail: int = 200) -> Column:
    """Keep the start and the last characters around a note about the omission."""
    cut = F.concat(F.substring(text, 1, n - tail), F.lit(OMITTED), F.substring(text, -tail, tail))
    return F.when(F.length(text) <= n, text).otherwise(cut)


def rough_token_count(text: Column) -> Column:
    """The larger of the word count and length / 2.5; 0 for an empty text."""
    words = F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))
    chars = F.greatest(F.lit(1), F.floor(F.length(text) / 2.5).cast("int"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(words, chars)).cast("long")


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def clean_question(text: Column, max_chars: int, prefixes=vocab.INFORMAL_PREFIXES) -> Column:
    """struct(question, debug): mentions, leading marks, informal prefix and flag removed, then clipped."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), BOT_MENTION, " ")
    s = strip(F.regexp_replace(s, "\u200b", ""))
    s = squeeze(F.regexp_replace(s, r"^[\s,.:;>]+", ""))
    called = F.coalesce(*[F.when(F.startswith(F.lower(s), F.lit(p)), len(p)) for p in prefixes])
    rest = F.regexp_replace(F.substring(s, called + 1, F.length(s)), r"^[ ,.:;>]+", "")
    s = F.when(called.isNotNull(), rest).otherwise(s)
    debug = s.rlike(DEBUG_FLAG)
    s = F.when(debug, squeeze(F.regexp_replace(s, DEBUG_FLAG, " "))).otherwise(s)
    clipped = F.substring(s, 1, max_chars) if max_chars > 0 else s
    return F.struct(clipped.alias("question"), debug.alias("debug"))


def _heading_body(line: Column) -> Column:
    body = F.when(line.rlike(HEADING_LINE), strip(F.regexp_extract(line, HEADING_LINE, 1)))
    return strip(F.regexp_replace(body, r"\s+#+\s*$", ""))


def _is_cut_heading(body: Column, headings) -> Column:
    """The heading text, numbering and colon removed, is one of the closing headings."""
    name = strip(F.regexp_replace(F.regexp_replace(body, r"^[\d\.\)\s]+", ""), "[ :：]+$", ""))
    packed = F.regexp_replace(name, " ", "")
    return F.coalesce(
        name.isin(*headings) | packed.isin(*[h.replace(" ", "") for h in headings]),
        F.lit(False),
    )


def _cut_line(lines: Column, i: Column, headings) -> Column:
    line = F.get(lines, i)
    bare = F.regexp_replace(strip(F.regexp_replace(strip(line), "[*_`~]+", "")), "[ :：]+$", "")
    following = strip(F.coalesce(F.get(lines, i + 1), F.lit("")))
    lists_next = (following == "") | following.rlike(r"^([-•*·]|\d+[\.\)])")
    emphasized = strip(line).rlike(EMPHASIS_LINE)
    return _is_cut_heading(_heading_body(line), headings) | (_is_cut_heading(bare, headings) & (emphasized | lists_next))


def trim_answer(text: Column, headings=vocab.ANSWER_CUT_HEADINGS) -> Column:
    """Cut an answer where its closing sections (sources, open points, diagnostics) begin."""

    def cut(lines: Column) -> Column:
        marks = F.transform(lines, lambda line, i: _cut_line(lines, i, headings))
        at = F.array_position(marks, True)
        return let(at, lambda p: F.when(p > 0, F.slice(lines, F.lit(1), (p - 1).cast("int"))).otherwise(lines))

    kept = let(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), cut)
    return F.regexp_replace(F.array_join(kept, "\n"), r"(\n[^\S\n]*)+$", "")


def headings_to_bold(text: Column) -> Column:
    """Markdown headings become bold lines."""

    def convert(line: Column) -> Column:
        body = F.regexp_replace(_heading_body(line), r"\*", "")
        bold = F.when(body != "", F.concat(F.lit("*"), body, F.lit("*"))).otherwise("")
        return F.when(line.rlike(HEADING_LINE), bold).otherwise(line)

    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), convert), "\n")


def tidy_blanks(text: Column) -> Column:
    s = F.regexp_replace(F.coalesce(text, F.lit("")), WIDE_SPACES, " ")
    s = F.regexp_replace(F.regexp_replace(s, LINE_BREAK, "\n"), r"[^\S\n]+(\n|$)", "$1")
    return strip(F.regexp_replace(s, "\n{3,}", "\n\n"))


def markup_convert(text: Column, headings=vocab.ANSWER_CUT_HEADINGS) -> Column:
    """The answer as a chat message: closing sections cut, headings bold, blanks tidy."""
    return tidy_blanks(headings_to_bold(trim_answer(text, headings)))


def fixed(value: Column, digits: int) -> Column:
    """A number with a fixed number of decimals; halves go up, by plain arithmetic on the double."""
    scale = float(10**digits)
    return F.format_string(f"%.{digits}f", F.floor(value * scale + 0.5) / scale)
