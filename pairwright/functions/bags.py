"""Similarities of whole texts by their words and q-grams, as Arrow UDFs.

A slice of pairs is one table: the tokens of both sides are numbered together, row and
token make one integer, and sorting, counting and summing are NumPy steps over all rows of
the slice. Spark lower-cases the texts and partitions the pairs; the UDF only sees one
bounded slice at a time. Nothing is quadratic in the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters of both sides in one NumPy slice; a longer pair is a slice of its own.
_SLICE_CHARS = 1_000_000

# Grams are ticked off in a table of rows and codes where that has no more cells than this for
# each gram, and sorted otherwise; codes are numbered through a table up to so many cells.
_TABLE_SHARE = 16
_TABLE_CELLS = 1 << 22

# What parts the terms of a TF-IDF vectorizer, as far as it is ASCII.
_TERM_BYTES = bytes(c if c >= 128 or chr(c).isalnum() or c == 95 else 32 for c in range(256))

# Okapi BM25 constants, and the corpus of two texts plus three
# empty ones, in which a shared word has document frequency two.
BM25_K1 = 1.5
BM25_B = 0.75
BM25_DOCS = 5
BM25_SHARED_IDF = float(np.log((BM25_DOCS - 2 + 0.5) / (2 + 0.5)))

# Fixed value: smoothed inverse document frequency over a two-text corpus.
TFIDF_UNSHARED_IDF = float(np.log(3.0 / 2.0)) + 1.0


@dataclass
class Bags:
    """Word counts of a slice of pairs, one entry per row and distinct word of a side.

    ``x`` counts a word on the left and ``y`` on the right; ``left_y`` and ``right_x`` are
    the other side's counts of the words of ``left_row`` and ``right_row``.
    """

    rows: int
    left_row: np.ndarray
    x: np.ndarray
    left_y: np.ndarray
    right_row: np.ndarray
    y: np.ndarray
    right_x: np.ndarray

    def left(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.left_row, weights=values, minlength=self.rows)

    def right(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.right_row, weights=values, minlength=self.rows)


def _bags(left: list[str], right: list[str], least: int) -> Bags:
    """Counts of the whitespace-separated words of at least ``least`` characters."""
    rows = len(left)
    split = pc.utf8_split_whitespace(pa.array([*left, *right], pa.large_string()))
    words, text = pc.list_flatten(split), pc.list_parent_indices(split)
    known = pc.greater_equal(pc.utf8_length(words), least)
    words, text = words.filter(known).dictionary_encode(), text.filter(known).to_numpy().astype(np.int64)
    many = max(1, len(words.dictionary))
    key = text % rows * many + words.indices.to_numpy()
    cut = int(np.searchsorted(text, rows))
    a, x = np.unique(key[:cut], return_counts=True)
    b, y = np.unique(key[cut:], return_counts=True)
    _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    x, y = x.astype(np.float64), y.astype(np.float64)
    left_y, right_x = np.zeros(len(a)), np.zeros(len(b))
    left_y[in_a], right_x[in_b] = y[in_b], x[in_a]
    return Bags(rows, a // many, x, left_y, b // many, y, right_x)


def _quotient(top: np.ndarray, bottom: np.ndarray, empty: float) -> np.ndarray:
    return np.divide(top, bottom, out=np.full(len(top), empty), where=bottom != 0)


def _cosine_tokens(left: list[str], right: list[str]) -> np.ndarray:
    bags = _bags(left, right, 1)
    norm = np.sqrt(bags.left(bags.x * bags.x)) * np.sqrt(bags.right(bags.y * bags.y))
    return _quotient(bags.left(bags.x * bags.left_y), norm, 0.0)


def _parted(text: str) -> str:
    """The text with a blank for whatever is neither letter, number nor underscore."""
    parted = text.encode().translate(_TERM_BYTES).decode()
    if not text.isascii():
        for letter in set(parted):
            if letter > "\x7f" and not letter.isalnum():
                parted = parted.replace(letter, " ")
    return parted


def _cosine_tfidf(left: list[str], right: list[str]) -> np.ndarray:
    bags = _bags(*[[_parted(text) for text in side] for side in (left, right)], 2)
    x = bags.x * np.where(bags.left_y > 0, 1.0, TFIDF_UNSHARED_IDF)
    y = bags.y * np.where(bags.right_x > 0, 1.0, TFIDF_UNSHARED_IDF)
    norm = np.sqrt(bags.left(x * x)) * np.sqrt(bags.right(y * y))
    return _quotient(bags.left(bags.x * bags.left_y), norm, 0.0)


def _bm25(left: list[str], right: list[str]) -> np.ndarray:
    bags = _bags(left, right, 1)
    n_left, n_right = bags.left(bags.x), bags.right(bags.y)
    average = (n_left + n_right) / float(BM25_DOCS)

    def norm(length: np.ndarray) -> np.ndarray:
        return BM25_K1 * (1.0 - BM25_B + BM25_B * _quotient(length, average, 0.0))

    x, y, row = bags.x, bags.left_y, bags.left_row
    met = x * y * BM25_SHARED_IDF * (BM25_K1 + 1.0)
    return bags.left(met / (x + norm(n_left)[row]) + np.where(y > 0, met, 0.0) / (y + norm(n_right)[row])) / 2.0


def _sorted_distinct(keys: np.ndarray) -> np.ndarray:
    """As ``numpy.unique``, which hashes whole numbers and is slow on keys that lie close together."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) != 0]


def _qgram_jaccard(left: list[str], right: list[str], q: int) -> np.ndarray:
    """Shared over all distinct q-grams; a shorter text is its own gram, two empty ones are alike."""
    rows, texts = len(left), [*left, *right]
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    seen = np.zeros(int(points.max(initial=0)) + 1, dtype=bool)
    seen[points] = True
    # Letters are numbered from 1 as they occur in the slice; 0 is what a short text lacks.
    number = np.cumsum(seen)
    letters = np.concatenate([number[points], np.zeros(q, dtype=np.int64)])
    base = int(number[-1]) + 1
    grams = np.where(size >= q, size - q + 1, np.minimum(size, 1))
    ends = np.cumsum(size)
    code, bound = letters[: len(points)], base

    def numbered(code: np.ndarray, bound: int, factor: int) -> tuple[np.ndarray, int]:
        """Codes in fewer numbers, where a product with ``factor`` would not fit 63 bits."""
        if bound * factor < 1 << 63:
            return code, bound
        distinct, code = np.unique(code, return_inverse=True)
        return code, len(distinct)

    # A code for every letter, as if a gram began there; then those go that reach into the next text.
    for j in range(1, q):
        code, bound = numbered(code, bound, base)
        following = letters[j : j + len(points)].copy()
        lacking = (size > 0) & (size <= j)
        following[(ends - size)[lacking]] = 0
        code, bound = code * base + following, bound * base
    begins = np.ones(len(points), dtype=bool)
    for k in range(1, q):
        begins[(ends - k)[size - k >= grams]] = False
    code = code[begins]
    if bound <= _TABLE_CELLS:
        occurs = np.zeros(bound, dtype=bool)
        occurs[code] = True
        number = np.cumsum(occurs)
        code, bound = number[code] - 1, max(1, int(number[-1]))
    code, bound = numbered(code, bound, rows)
    key = np.repeat(np.arange(len(texts)) % rows, grams) * bound + code
    cut = int(grams[:rows].sum())
    if rows * bound <= _TABLE_SHARE * len(key):
        in_a, in_b = np.zeros((2, rows * bound), dtype=bool)
        in_a[key[:cut]] = True
        in_b[key[cut:]] = True
        n_a, n_b, shared = (np.count_nonzero(x.reshape(rows, bound), axis=1) for x in (in_a, in_b, in_a & in_b))
    else:
        a, b = _sorted_distinct(key[:cut]), _sorted_distinct(key[cut:])
        n_a, n_b, shared = (
            np.bincount(keys // bound, minlength=rows) for keys in (a, b, np.intersect1d(a, b, assume_unique=True))
        )
    return _quotient(shared.astype(np.float64), n_a + n_b - shared, 1.0)


def _in_slices(left: pd.Series, right: pd.Series, score: Callable[..., np.ndarray], *more: int) -> pd.Series:
    left, right = list(left), list(right)
    result = np.zeros(len(left), dtype=np.float64)
    start = held = 0
    for stop in range(len(left) + 1):
        size = len(left[stop]) + len(right[stop]) if stop < len(left) else _SLICE_CHARS
        if stop > start and held + size > _SLICE_CHARS:
            result[start:stop] = score(left[start:stop], right[start:stop], *more)
            start, held = stop, 0
        held += size
    if start < len(left):
        result[start:] = score(left[start:], right[start:], *more)
    return pd.Series(result)


def _lowered(text: Column) -> Column:
    return F.coalesce(F.lower(text), F.lit(""))


@F.pandas_udf(T.DoubleType())
def _cosine_tokens_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _in_slices(a, b, _cosine_tokens)


@F.pandas_udf(T.DoubleType())
def _cosine_tfidf_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _in_slices(a, b, _cosine_tfidf)


@F.pandas_udf(T.DoubleType())
def _bm25_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _in_slices(a, b, _bm25)


@F.pandas_udf(T.DoubleType())
def _qgram_jaccard_udf(a: pd.Series, b: pd.Series, q: pd.Series) -> pd.Series:
    return _in_slices(a, b, _qgram_jaccard, int(q.iloc[0]) if len(q) else 1)


def cosine_tokens(a: Column, b: Column) -> Column:
    """Cosine of raw word counts; 0 when either text has no word."""
    return _cosine_tokens_udf(_lowered(a), _lowered(b))


def cosine_tfidf(a: Column, b: Column) -> Column:
    """TF-IDF cosine in the corpus made of just these two texts."""
    return _cosine_tfidf_udf(_lowered(a), _lowered(b))


def bm25(a: Column, b: Column) -> Column:
    """Mean of both directions' Okapi BM25."""
    return _bm25_udf(_lowered(a), _lowered(b))


def jaccard_qgrams(a: Column, b: Column, q: int = 3) -> Column:
    return _qgram_jaccard_udf(_lowered(a), _lowered(b), F.lit(q))
