"""Tokenizers as Column expressions.

No expression is quadratic in the length of a text: q-grams come from one regex
scan (``substring`` would rescan the UTF-8 bytes for every position).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a whitespace split treats as separators, and the
# word-character runs a TF-IDF vectorizer takes as terms.
WHITESPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]+"
TERM = r"[\p{L}\p{N}_]{2,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-cased whitespace tokens, without empty edge tokens."""
    return F.filter(F.split(F.lower(text), WHITESPACE), lambda t: t != "")


def terms(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def qgrams(text: Column, q: int = 3) -> Column:
    """Lower-cased sliding q-grams; a shorter text is its own single gram."""
    s = F.lower(text)
    empty = F.array().cast("array<string>")
    sliding = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{q}}}))."), F.lit(1))
    return (
        F.when(F.length(s) >= q, sliding)
        .when(F.length(s) > 0, F.array(s))
        .otherwise(empty)
    )


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only texts."""
    return ~F.coalesce(text, F.lit("")).rlike(r"[^\t-\r\x1c-\x1f\x85\p{Z}]")


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of every kind."""
    return F.regexp_replace(text, rf"^{WHITESPACE}|{WHITESPACE}$", "")
