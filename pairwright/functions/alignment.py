"""Alignment similarities Spark has no built-in for, as Arrow UDFs.

Needleman-Wunsch and Smith-Waterman run one dynamic program for a whole Arrow
batch: row ``i`` of every pair is one NumPy operation, and the left-gap
recurrence becomes a running maximum because a gap costs exactly one. Jaro-Winkler
finds the matching letters of all pairs letter by letter in the same way, and
Monge-Elkan compares each distinct pair of words of a batch once. Spark partitions
the pairs; the UDF only sees one bounded slice at a time.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bounds the padded character matrix of one NumPy slice.
_SLICE_CELLS = 4_000_000

# Length from which ``difflib`` leaves frequent letters out; pairs and cells of a slice of its blocks.
_AUTOJUNK = 200
_BLOCK_ROWS = 4096
_BLOCK_CELLS = 65_536

# Jaro-Winkler prefix scale, longest rewarded prefix and the
# similarity above which the prefix counts.
JW_PREFIX_SCALE = 0.1
JW_MAX_PREFIX = 4
JW_BOOST_ABOVE = 0.7


def _code_points(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    width = int(lengths.max()) if len(texts) else 0
    codes = np.full((len(texts), width), pad, dtype=np.int32)
    for row, text in enumerate(texts):
        codes[row, : len(text)] = np.frombuffer(text.encode("utf-32-le"), dtype=np.int32)
    return codes, lengths


def _align(left: list[str], right: list[str], local: bool) -> np.ndarray:
    a, a_len = _code_points(left, -1)
    b, b_len = _code_points(right, -2)
    rows, width = a.shape[0], b.shape[1]
    offsets = np.arange(width + 1, dtype=np.int32)
    previous = np.zeros((rows, width + 1), np.int32) if local else np.tile(-offsets, (rows, 1))
    out = np.zeros(rows, dtype=np.int32)
    if not local:
        done = a_len == 0
        out[done] = -b_len[done]
    for i in range(1, a.shape[1] + 1):
        current = np.empty_like(previous)
        current[:, 0] = 0 if local else -i
        hit = (b == a[:, i - 1 : i]).astype(np.int32)
        np.maximum(previous[:, :-1] + hit, previous[:, 1:] - 1, out=current[:, 1:])
        if local:
            np.maximum(current, 0, out=current)
        current += offsets
        np.maximum.accumulate(current, axis=1, out=current)
        current -= offsets
        if local:
            np.maximum(out, current.max(axis=1), out=out)
        else:
            ended = np.flatnonzero(a_len == i)
            out[ended] = current[ended, b_len[ended]]
        previous = current
    return out


def _align_batch(a: pd.Series, b: pd.Series, local: bool) -> pd.Series:
    left = [t.lower() for t in a]
    right = [t.lower() for t in b]
    result = np.zeros(len(left), dtype=np.float64)
    order = sorted(range(len(left)), key=lambda i: (len(right[i]), len(left[i])))
    start = 0
    while start < len(order):
        stop, widest = start, 1
        while stop < len(order):
            widest = max(widest, len(right[order[stop]]) + len(left[order[stop]]) + 1)
            if stop > start and widest * (stop - start + 1) > _SLICE_CELLS:
                break
            stop += 1
        rows = order[start:stop]
        result[rows] = _align([left[i] for i in rows], [right[i] for i in rows], local)
        start = stop
    return pd.Series(result)


@F.pandas_udf(T.DoubleType())
def needleman_wunsch(a: pd.Series, b: pd.Series) -> pd.Series:
    """Global alignment score: match 1, mismatch 0, gap -1. May be negative."""
    return _align_batch(a, b, local=False)


@F.pandas_udf(T.DoubleType())
def smith_waterman(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best local alignment score, never below 0."""
    return _align_batch(a, b, local=True)


def _jaro_winkler_slice(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro-Winkler of non-empty strings, one NumPy step per letter of the longest left one."""
    a, a_len = _code_points(left, -1)
    b, b_len = _code_points(right, -2)
    rows = np.arange(len(left))
    window = np.maximum(np.maximum(a_len, b_len) // 2 - 1, 0)[:, None]
    at = np.arange(b.shape[1])[None, :]
    free = np.ones(b.shape, dtype=bool)
    met = np.zeros(a.shape, dtype=bool)
    for i in range(a.shape[1]):
        fits = free & (b == a[:, i : i + 1]) & (np.abs(at - i) <= window)
        first = fits.argmax(axis=1)
        met[:, i] = fits[rows, first]
        free[rows[met[:, i]], first[met[:, i]]] = False
    common = met.sum(axis=1)
    # The k-th letter met on one side stands against the k-th met on the other.
    width = int(common.max())
    of_a = np.take_along_axis(a, np.argsort(~met, axis=1, kind="stable")[:, :width], axis=1)
    of_b = np.take_along_axis(b, np.argsort(free, axis=1, kind="stable")[:, :width], axis=1)
    moved = ((of_a != of_b) & (np.arange(width)[None, :] < common[:, None])).sum(axis=1) // 2
    shared = np.maximum(common, 1)
    jaro = np.where(common > 0, (common / a_len + common / b_len + (common - moved) / shared) / 3.0, 0.0)
    reach = min(JW_MAX_PREFIX, a.shape[1], b.shape[1])
    prefix = np.logical_and.accumulate(a[:, :reach] == b[:, :reach], axis=1).sum(axis=1)
    return np.where(jaro > JW_BOOST_ABOVE, jaro + prefix * JW_PREFIX_SCALE * (1.0 - jaro), jaro)


def _jaro_winkler(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro-Winkler of any strings, in slices of like lengths; 0 where one is empty."""
    result = np.zeros(len(left), dtype=np.float64)
    order = sorted((i for i in range(len(left)) if left[i] and right[i]), key=lambda i: len(left[i]) + len(right[i]))
    start = 0
    while start < len(order):
        # Sorted by length, so the last row of a slice is its widest.
        stop = min(len(order), start + max(1, _SLICE_CELLS // (len(left[order[start]]) + len(right[order[start]]))))
        while stop > start + 1:
            last = order[stop - 1]
            most = max(1, _SLICE_CELLS // (len(left[last]) + len(right[last])))
            if stop - start <= most:
                break
            stop = start + most
        rows = order[start:stop]
        result[rows] = _jaro_winkler_slice([left[i] for i in rows], [right[i] for i in rows])
        start = stop
    return result


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity of the lower-cased strings."""
    return pd.Series(_jaro_winkler([x.lower() for x in a], [y.lower() for y in b]))


def _monge_elkan(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """Every distinct pair of words of the batch is compared once; rows only look it up.

    Left words are taken in runs that meet a bounded number of right words in all.
    """
    vocabulary: dict[str, int] = {}
    a = np.array([vocabulary.setdefault(w, len(vocabulary)) for words in left for w in words], dtype=np.int64)
    b = np.array([vocabulary.setdefault(w, len(vocabulary)) for words in right for w in words], dtype=np.int64)
    words = list(vocabulary)
    n_left = np.fromiter(map(len, left), dtype=np.int64, count=len(left))
    n_right = np.fromiter(map(len, right), dtype=np.int64, count=len(right))
    # A text without words is like another one without words, and like nothing else.
    result = ((n_left == 0) & (n_right == 0)).astype(np.float64)
    row = np.repeat(np.arange(len(left)), n_left)
    partners, begin = n_right[row], (np.cumsum(n_right) - n_right)[row]
    best = np.zeros(len(a))
    asked = np.flatnonzero(partners > 0)
    run = np.cumsum(partners[asked]) // _SLICE_CELLS
    for part in np.split(asked, np.flatnonzero(np.diff(run)) + 1) if len(asked) else []:
        sizes = partners[part]
        heads = np.cumsum(sizes) - sizes
        other = b[np.repeat(begin[part] - heads, sizes) + np.arange(sizes.sum())]
        distinct, where = np.unique(np.repeat(a[part], sizes) * len(words) + other, return_inverse=True)
        first, second = np.divmod(distinct, len(words))
        scores = _jaro_winkler([words[i] for i in first], [words[i] for i in second])
        best[part] = np.maximum.reduceat(scores[where], heads)
    both = (n_left > 0) & (n_right > 0)
    result[both] = np.bincount(row, weights=best, minlength=len(left))[both] / n_left[both]
    return result


@F.pandas_udf(T.DoubleType())
def monge_elkan(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean over the first text's words of the best Jaro-Winkler in the second."""
    return pd.Series(_monge_elkan([x.lower().split() for x in a], [y.lower().split() for y in b]))


def _longest_blocks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start on both sides and size of each column's longest common block, the earliest of several.

    ``a`` and ``b`` hold a text a column, padded with letters that never meet.
    """
    width, columns = b.shape
    place = np.arange(width - 1, -1, -1, dtype=np.int32)[:, None]
    run = np.zeros((width + 1, columns), dtype=np.int32)
    best, end_a, end_b = (np.zeros(columns, dtype=np.int64) for _ in range(3))
    for i, letter in enumerate(a):
        run[1:] = (run[:-1] + 1) * (b == letter)
        # One maximum finds the longest run and the first place where it ends.
        size, where = np.divmod((run[1:] * width + place).max(axis=0), width)
        longer = np.flatnonzero(size > best)
        best[longer], end_a[longer], end_b[longer] = size[longer], i + 1, width - where[longer]
    return end_a - best, end_b - best, best


def _matched_letters(left: list[str], right: list[str]) -> np.ndarray:
    """Letters in the matching blocks of ``difflib``, for right texts under its 200 letters of autojunk.

    The parts beside the blocks of all pairs are one list, worked off in slices of like lengths.
    """
    a, a_len = _code_points(left, -1)
    b, b_len = _code_points(right, -2)
    # A column of padding, which every place beyond a part reads.
    a, b = np.pad(a, ((0, 0), (0, 1)), constant_values=-1), np.pad(b, ((0, 0), (0, 1)), constant_values=-2)
    matched = np.zeros(len(left), dtype=np.int64)
    zeros = np.zeros(len(left), dtype=np.int64)
    parts = np.stack([np.arange(len(left)), zeros, a_len, zeros, b_len])
    while parts.size:
        parts = parts[:, (parts[2] > parts[1]) & (parts[4] > parts[3])]
        n_a, n_b = parts[2] - parts[1], parts[4] - parts[3]
        parts = parts[:, np.lexsort((n_b, np.ceil(np.log2(n_a))))]
        found, start = [], 0
        while start < parts.shape[1]:
            ahead = parts[:, start : start + _BLOCK_CELLS]
            widest = np.maximum.accumulate(ahead[4] - ahead[3])
            fits = int(np.searchsorted(widest * np.arange(1, len(widest) + 1), _BLOCK_CELLS, "right"))
            row, a_from, a_to, b_from, b_to = part = ahead[:, : max(1, fits)]
            start += part.shape[1]
            at_a = a_from + np.arange((a_to - a_from).max())[:, None]
            at_b = b_from + np.arange((b_to - b_from).max())[:, None]
            in_a, in_b, size = _longest_blocks(
                a[row, np.where(at_a < a_to, at_a, a.shape[1] - 1)], b[row, np.where(at_b < b_to, at_b, b.shape[1] - 1)]
            )
            met = size > 0
            row, a_from, a_to, b_from, b_to = part[:, met]
            size, in_a, in_b = size[met], a_from + in_a[met], b_from + in_b[met]
            np.add.at(matched, row, size)
            found += [np.stack([row, a_from, in_a, b_from, in_b]), np.stack([row, in_a + size, a_to, in_b + size, b_to])]
        parts = np.concatenate(found, axis=1) if found else np.zeros((5, 0), dtype=np.int64)
    return matched


def _ratcliff_obershelp(left: list[str], right: list[str]) -> np.ndarray:
    """The ratio of ``difflib.SequenceMatcher``, which is asked itself where texts are long."""
    result = np.ones(len(left), dtype=np.float64)
    short = [i for i in range(len(left)) if len(right[i]) < _AUTOJUNK and len(left[i]) < _AUTOJUNK]
    for start in range(0, len(short), _BLOCK_ROWS):
        rows = short[start : start + _BLOCK_ROWS]
        x, y = [left[i] for i in rows], [right[i] for i in rows]
        total = np.fromiter((len(s) + len(t) for s, t in zip(x, y)), dtype=np.int64, count=len(rows))
        result[rows] = np.divide(2.0 * _matched_letters(x, y), total, out=np.ones(len(rows)), where=total > 0)
    for i in set(range(len(left))).difference(short):
        result[i] = difflib.SequenceMatcher(None, left[i], right[i]).ratio()
    return result


@F.pandas_udf(T.DoubleType())
def tool_edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """One minus the Ratcliff-Obershelp ratio; case-sensitive."""
    return pd.Series(1.0 - _ratcliff_obershelp(list(a), list(b)))
