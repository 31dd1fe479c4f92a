"""Text expressions that mean the same in Java and RE2 regular expressions: no look-around, Unicode white space spelled out."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space in Unicode text.
SPACE = r"\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{SPACE}]"
#: The same characters as a plain text, for trimming.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Where a text breaks into lines.
LINE_BREAK = r"\r\n|[\n\r\x{000B}\x{000C}\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}]"
#: What a comparison key leaves out: everything but letters, digits and the underscore, in any script.
NOT_WORD = r"[^\p{L}\p{N}_]+"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def lines(c: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(F.split(text_or_empty(c), LINE_BREAK), strip), lambda x: x != "")


def drop_repeats(a: Column) -> Column:
    """Array without elements equal to the one before."""
    return bind(a, lambda v: F.filter(v, lambda x, i: (i == 0) | (x != F.get(v, i - 1))))


def normalize_lines(c: Column) -> Column:
    """Squeezed lines, blank ones and repeats of the line before dropped."""
    squeezed = F.filter(F.transform(F.split(text_or_empty(c), LINE_BREAK), squeeze), lambda x: x != "")
    return F.array_join(drop_repeats(squeezed), "\n")


def truncate(c: Column, n: int) -> Column:
    """Squeezed text, cut with ``...`` to at most n characters."""
    return bind(squeeze(text_or_empty(c)), lambda s: F.when(F.length(s) <= n, s).otherwise(F.concat(F.rtrim(F.left(s, F.lit(n - 3))), F.lit("..."))))


def truncate_at_word(c: Column, n: int) -> Column:
    """Squeezed text, cut with ``...`` after the last whole word that fits; a longer first word is cut as it stands."""
    def cut(s: Column) -> Column:
        return bind(F.regexp_extract(F.left(s, F.lit(n - 2)), r"^(.+) ", 1), lambda whole: F.when(whole != "", F.rtrim(whole)).otherwise(F.left(s, F.lit(n - 3))))

    return bind(squeeze(text_or_empty(c)), lambda s: F.when(F.length(s) <= n, s).otherwise(F.concat(cut(s), F.lit("..."))))


def comparison_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(c)), NOT_WORD, "")


def contains_any(c: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def hits(c: Column, words: Iterable[str]) -> Column:
    """How many of the words are in the text."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(c, F.lit(w)).cast("int")
    return out


def found(c: Column, words: Iterable[str]) -> Column:
    """Array of the words that are in the text, in the order of the list."""
    ws = list(words)
    return F.array_compact(F.array(*[F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in ws])) if ws else F.array().cast("array<string>")


def first_hit(c: Column, words: Iterable[str], default: str = "") -> Column:
    return F.coalesce(*[F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words], F.lit(default))


def to_int(c: Column, default: int = 0) -> Column:
    """Lenient whole number: what does not parse is the default."""
    return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(default))


def terms(c: Column, stopwords: Iterable[str], least: int = 2, digits: bool = True) -> Column:
    """Lower-case ASCII word tokens of at least ``least`` characters without stopwords (and, on request, without numbers)."""
    stop = tuple(stopwords)
    got = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(f"[a-z0-9]{{{least},}}"), 0)
    if not stop and digits:
        return got
    keep = lambda x: (~x.isin(*stop) if stop else F.lit(True)) & (F.lit(True) if digits else F.ltrim(x, F.lit("0123456789")) != "")
    return F.filter(got, keep)
