"""Tokens and stems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MIN_BYTES = 3
SEPARATOR = r"\p{IsWhite_Space}\p{Punct}"


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of at least three bytes, cut at white space and ASCII punctuation."""
    words = F.split(F.lower(text), f"[{SEPARATOR}]+")
    return F.array_distinct(F.filter(words, lambda w: F.octet_length(w) >= MIN_BYTES))


def stem(word: Column) -> Column:
    """The first ending that fits goes: s, ing or ed, if enough of the word is left."""
    size, chars = F.octet_length(word), F.char_length(word)
    cut = lambda n: F.substring(word, F.lit(1), chars - n)
    return (
        F.when(F.endswith(word, F.lit("s")) & (size > 3), cut(1))
        .when(F.endswith(word, F.lit("ing")) & (size > 5), cut(3))
        .when(F.endswith(word, F.lit("ed")) & (size > 4), cut(2))
        .otherwise(word)
    )


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(tokens(text), stem))


def of_literal(make: Column) -> list[str]:
    """The value of an array expression without columns, such as the stems of a query."""
    return SparkSession.getActiveSession().sql("SELECT 1").select(make).first()[0]


def _stem_of(word: str) -> str:
    """As :func:`stem`, of a string."""
    size = len(word.encode())
    for ending, least in (("s", 3), ("ing", 5), ("ed", 4)):
        if word.endswith(ending) and size > least:
            return word[: -len(ending)]
    return word


def words_of_stem(wanted: str) -> list[str]:
    """All tokens that have a stem: it and what the endings make of it."""
    return [w for w in (wanted, f"{wanted}s", f"{wanted}ing", f"{wanted}ed") if len(w.encode()) >= MIN_BYTES and _stem_of(w) == wanted]


def says(text: Column, part: str, words: list[str]) -> Column:
    """Whether one of ``words``, all of which contain ``part``, is a token of a text; no token is made for it."""
    low, one = F.lower(text), "|".join(rf"\Q{w}\E" for w in words)
    return low.contains(part) & low.rlike(rf"(?<![^{SEPARATOR}])(?:{one})(?![^{SEPARATOR}])") if words else F.lit(False)


def says_stem(text: Column, wanted: str) -> Column:
    return says(text, wanted, words_of_stem(wanted))


def any_of(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def all_of(tests: list[Column]) -> Column:
    return reduce(Column.__and__, tests) if tests else F.lit(False)
