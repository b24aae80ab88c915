"""Token ids of whole texts by a byte-level BPE file, distinct units encoded once a process.

A text may be cut before any single space that a visible character follows: the
pattern of these vocabularies starts a token there whatever stands before. The parts
between such cuts are *units*; encoding them one by one gives the ids of the whole
text, special strings included, since those hold no space.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from typing import Generic, TypeVar

import numpy as np
import public_tokenizers

from pairwright.llm.common import quiet_tokenizers

#: A space at which a text can't be cut: white space or the end follows.
_UNSAFE = re.compile(r" (?!\S)")
_SAFE = re.compile(r" (?=\S)")
#: Entries kept by one process; beyond it the memory starts anew, results don't change.
KEPT_UNITS = 800_000
#: Longer units go to the library itself, whose time doesn't grow with their square.
RANKED_UNIT = 256

T = TypeVar("T")


def units(text: str) -> list[str]:
    """The text's units; all but the first stand for a space and the unit."""
    return _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    quiet_tokenizers()
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def ranked(path: str):
    """The same vocabulary as ranks of byte strings, which encode short units faster.

    None where the file's merges aren't in the order of its ids, so that ranks would
    merge in another order.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    special = {t["content"] for t in held["added_tokens"]}
    byte_of = _byte_of()
    ranks = {
        bytes(map(byte_of.__getitem__, t)): i
        for t, i in held["model"]["vocab"].items() if t not in special
    }
    pairs = (m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"])
    merged = [ranks[bytes(map(byte_of.__getitem__, a + b))] for a, b in pairs]
    if merged != sorted(merged):
        return None
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return own.encode_ordinary, special


def encoded(path: str, units_: list[str]) -> Iterable[list[int]]:
    """The ids of each unit as the library for the file gives them.

    Short units without special strings go through the ranks; ids are the same.
    """
    fast = ranked(path)
    if fast is None:
        rest = units_
    else:
        encode, special = fast
        hard = {u for u in units_ if len(u) > RANKED_UNIT or any(s in u for s in special)}
        rest = [u for u in units_ if u in hard]
    slow = iter(
        tokenizer(path).encode_batch_fast(rest, add_special_tokens=False) if rest else ()
    )
    if fast is None:
        return [next(slow).ids for _ in units_]
    return [next(slow).ids if u in hard else encode(u) for u in units_]


class UnitCoder(Generic[T]):
    """What ``make`` makes of the ids of each unit, remembered."""

    def __init__(self, path: str, make: Callable[[list[int]], T]):
        self.path, self.make = path, make
        self.known: dict[str, T] = {}
        self.first: dict[str, T] = {}

    def _learn(self, known: dict[str, T], found: set[str], lead: str) -> None:
        new = [u for u in found if u not in known]
        ids = encoded(self.path, [lead + u for u in new])
        known.update(zip(new, map(self.make, ids)))

    def __call__(self, batch: list[str]) -> list[list[T]]:
        """For each text, what its units give, in order."""
        if len(self.known) + len(self.first) > KEPT_UNITS:
            self.known, self.first = {}, {}
        split = [units(text) for text in batch]
        self._learn(self.first, {s[0] for s in split}, "")
        self._learn(self.known, {u for s in split for u in s[1:]}, " ")
        get, first = self.known.__getitem__, self.first
        return [[first[s[0]], *map(get, s[1:])] for s in split]


@lru_cache(maxsize=2)
def length_coder(path: str) -> UnitCoder[int]:
    """Lengths only; a process keeps the coder for its later tasks."""
    return UnitCoder(path, len)


@lru_cache(maxsize=2)
def id_coder(path: str) -> UnitCoder[bytes]:
    """Ids as little-endian unsigned 32-bit numbers."""
    return UnitCoder(path, lambda ids: np.array(ids, "<u4").tobytes())
