"""Whole texts as runs of interned pieces, so that a tokenizer sees each distinct piece once.

A text is cut before each single space that stands between two characters that aren't white space.
There the pre-tokenizing pattern of the byte-level vocabularies always has a boundary (a word, number or
sign run takes one space before it and ends before the next), so the ids of a text are the ids of its
pieces in order.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back, spread

_NEAR = re.compile(r"\s\s")
#: The same for RE2, over all characters that Python's \s takes.
_NEAR_ALL = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
_CUT = re.compile(r"(?<=\S) (?=\S)")


def cut(text: str) -> list[str]:
    """The pieces; all but the first have lost the space before them."""
    return _CUT.split(text) if _NEAR.search(text) else text.split(" ")


class PieceCoder:
    """encode_new(first, later): distinct pieces that begin a text, and distinct pieces with the space before them ->
    (ids of all in that order, number of ids of each)."""

    def __init__(self, encode_new: Callable[[list[str], list[str]], tuple[np.ndarray, np.ndarray]], most: int = 450_000) -> None:
        self.encode_new, self.most = encode_new, most
        self._clear()

    def _clear(self) -> None:
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})  # first, later: piece -> place
        self.size = 0
        self.flat = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int32)
        self.used = np.zeros(0, dtype=np.int32)  # calls of encode that a piece stood in

    def _trim(self) -> None:
        """Bounded memory: pieces that stood in one call only go, for most words of a corpus occur once; if too many are left, those of
        most calls stay."""
        keep = self.used > 1
        if 2 * int(keep.sum()) > self.most:
            keep = self.used > np.sort(self.used)[-(self.most // 2)]
        place = np.cumsum(keep) - 1
        stay, to = keep.tolist(), place.tolist()
        self.known = tuple({p: to[k] for p, k in known.items() if stay[k]} for known in self.known)
        count = self.count[keep]
        self.flat = self.flat[spread(self.start[keep], count.astype(np.int64))]
        self.start = np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64) if len(count) else np.zeros(0, np.int64)
        self.count, self.used = count, np.ones(len(count), dtype=np.int32)
        self.size = len(count)

    def release(self) -> None:
        """Give memory back at the end of a task, but for the pieces that stood in several calls: the worker process goes on to
        other work, and the next task needs those again."""
        self._trim()
        give_back()

    def _learn(self, first: list[str], later: list[str]) -> None:
        """Code those pieces (each list without repeats) that aren't known yet."""
        new = [[p for p in some if p not in known] for some, known in zip((first, later), self.known, strict=True)]
        if new[0] or new[1]:
            self._add(new)

    def _add(self, new: list[list[str]]) -> None:
        """Code pieces that aren't known, those that begin a text and those within; they get the next places in that order."""
        for some, known in zip(new, self.known, strict=True):
            known.update(zip(some, range(self.size, self.size + len(some)), strict=True))
            self.size += len(some)
        flat, count = self.encode_new(new[0], [" " + p for p in new[1]])
        start = np.concatenate(([0], np.cumsum(count)[:-1])) + len(self.flat)
        self.flat = np.concatenate((self.flat, flat.astype(np.int32)))
        self.start = np.concatenate((self.start, start))
        self.count = np.concatenate((self.count, count.astype(np.int32)))
        self.used = np.concatenate((self.used, np.zeros(len(count), dtype=np.int32)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (one more value than texts)."""
        if not texts:
            return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        if self.size > self.most:
            self._trim()
        whole = pa.array(texts, pa.large_string())
        plain = pc.invert(pc.match_substring_regex(whole, _NEAR_ALL))
        lists = pc.split_pattern(pc.if_else(plain, whole, ""), " ")
        plain = plain.to_pylist()
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        heads = ends[:-1]  # of each text's first piece, which has no space before it
        begins = np.bincount(code[heads], minlength=len(names))
        within = np.bincount(code, minlength=len(names)) - begins
        some = [np.flatnonzero(used) for used in (begins, within)]
        told = [names[at].tolist() for at in some]
        odd = {i: cut(texts[i]) for i, ok in enumerate(plain) if not ok}  # runs of white space: cut by rule
        places = [np.fromiter(map(known.get, pieces, repeat(-1)), np.int32, len(pieces)) for known, pieces in zip(self.known, told, strict=True)]
        missing = [np.flatnonzero(row < 0) for row in places]
        if len(missing[0]) or len(missing[1]):
            size = self.size
            self._add([names[have[gone]].tolist() for have, gone in zip(some, missing, strict=True)])
            for row, gone in zip(places, missing, strict=True):
                row[gone] = np.arange(size, size + len(gone))
                size += len(gone)
        if odd:
            self._learn(list(dict.fromkeys(p[0] for p in odd.values())), list(dict.fromkeys(x for p in odd.values() for x in p[1:])))
        first, later = self.known
        at = np.zeros((2, len(names)), dtype=np.int32)
        for row, have, place in zip(at, some, places, strict=True):
            row[have] = place
            self.used[place] += 1
        r = at[1][code]
        r[heads] = at[0][code[heads]]
        if odd:
            rows = np.split(r, ends[1:-1])
            for i, p in odd.items():
                rows[i] = np.array([first[p[0]], *map(later.__getitem__, p[1:])], dtype=np.int32)
            r = np.concatenate(rows)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
        n = self.count[r]
        total = np.zeros(len(r) + 1, dtype=np.int64)
        np.cumsum(n, out=total[1:])
        place = np.repeat((self.start[r] - total[:-1]).astype(np.int32), n)  # both are far below 2**31
        place += np.arange(total[-1], dtype=np.int32)
        ids = self.flat[place]
        return ids, total[ends]


def batches_of(texts: list[str], most: int = 1 << 23):
    """(first, end) of runs of whole texts of about ``most`` characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
