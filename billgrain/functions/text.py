"""Text helpers with Unicode rules, as Spark columns.

Java's ``\\w``, ``\\d``, ``\\s`` and ``\\b`` are ASCII by default. Invoice text is
not, so the classes are spelled out.
"""

from __future__ import annotations


import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that count as white space, from the language's own definition.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

WORD = r"[\p{L}\p{N}_]"
# The same characters as a class. Spark turns a pattern into a string anew for each value it looks at outside of
# compiled code, so patterns are kept short and in ASCII.
SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = f"[^{SPACE[1:]}"
DIGIT = r"\p{Nd}"
WORD_START = rf"(?<!{WORD})"
WORD_END = rf"(?!{WORD})"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    """True if any needle occurs as a plain substring.

    A chain of byte searches is several times faster than one alternation pattern, as
    long as ``text`` is a plain column and not computed again for each needle.
    """
    found = text.contains(needles[0])
    for needle in needles[1:]:
        found = found | text.contains(needle)
    return found


def _initials(words: tuple[str, ...]) -> str:
    """Pattern that looks ahead for a first letter of the words: at most places of a text this is all that is tried."""
    return f"(?=[{''.join(sorted({re.escape(word[0]) for word in words}))}])"


def has_phrase(text: Column, wanted: tuple[str, ...]) -> Column:
    """``contains_any`` as one pattern, for lambdas, where each byte search would be a step of its own."""
    return text.rlike(f"{_initials(wanted)}(?:{'|'.join(map(re.escape, wanted))})")


def has_word(text: Column, wanted: tuple[str, ...]) -> Column:
    """True if any part between white space is one of the words."""
    return text.rlike(rf"{_initials(wanted)}(?<![!-~])(?<!{NOT_SPACE})(?:{'|'.join(map(re.escape, wanted))})(?!{NOT_SPACE})")


def missing(text: Column) -> Column:
    """NULL and the empty string both count as missing."""
    return F.coalesce(text, F.lit("")) == ""


def truncate_middle(text: Column, limit: int = 150_000, head: int = 100_000, tail: int = 50_000) -> Column:
    """Keep the first and last part of an over-long text (code points)."""
    marker = "\n\n[... MIDDLE CONTENT TRUNCATED ...]\n\n"
    return F.when(
        F.length(text) > limit,
        F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(tail))),
    ).otherwise(text)
