"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Texts are runs of words (letters, digits and all non-ASCII, A-Z lower-cased), so case and punctuation
don't matter.  Every word n-gram of a test item is a seed, however often the corpus holds it.  Wherever a
document holds a seed, the window around it, wide enough for any alignment that passes, is aligned with
the item (match 2, mismatch and gap -1), and the best local score over twice the item's words is the
score, 0 to 1.  A document leaks an item when the score is at least ``THRESHOLD``; a phrase in common
isn't enough.

A window is left unaligned only where it can't pass: each match takes a word of the window that the item
holds, and a passing score needs ``threshold`` times the item's words of them.

Items are searched in blocks of a bounded number of words, each a pass over the documents; only such a
block is ever broadcast.  Nothing is shuffled but the leaks themselves.

Defined cases: null or empty texts on either side leak nothing; an item with fewer words than a seed has
none and is never found, nor is a copy without ``SEED`` words of the item in a row; repeated rows on
either side are each reported; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, shingles, spread, text_chunks, words

SEED = 3  # words of a seed
THRESHOLD = 0.5
BLOCK_WORDS = 1_000_000  # of the items that are searched in one pass
MATCH, MISS, GAP = 2, -1, -1


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, buf, offs in text_chunks(pa.array(texts, pa.large_string())):
        h, _, _, counts = words(LOWER[buf], offs, ALNUM)
        out += [h[counts[i] : counts[i + 1]].copy() for i in range(len(offs) - 1)]
    return out


def align(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score of each (item, window) row pair, with the ends of the alignment in both.  Rows are
    padded, items with 0 and windows with 1, which are no word's hash."""
    b, w = windows.shape
    slope = np.arange(w, dtype=np.int32) * -GAP
    above = np.zeros((b, w + 1), dtype=np.int32)
    best = np.zeros(b, dtype=np.int32)
    at_i = np.zeros(b, dtype=np.int64)
    at_j = np.zeros(b, dtype=np.int64)
    rows = np.arange(b)
    for i in range(items.shape[1]):
        s = np.where(items[:, i : i + 1] == windows, MATCH, MISS).astype(np.int32)
        now = np.maximum(above[:, :-1] + s, above[:, 1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # gaps along the window
        j = now.argmax(axis=1)
        top = now[rows, j]
        better = top > best
        best[better], at_i[better], at_j[better] = top[better], i, j[better]
        above[:, 1:] = now
    return best, at_i, at_j


def _padded(parts: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts))), fill, dtype=np.uint64)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def _aligned(jobs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(score, item end, window end) of each job; those of like size go together."""
    out: list = [None] * len(jobs)
    by: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, (a, w) in enumerate(jobs):
        by[(-(-len(a) // 16), -(-len(w) // 32))].append(k)
    for (la, lw), ks in by.items():
        step = max(1, (1 << 19) // (lw * 32))
        for lo in range(0, len(ks), step):
            some = ks[lo : lo + step]
            got = align(_padded([jobs[k][0] for k in some], 0), _padded([jobs[k][1] for k in some], 1))
            for k, s, i, j in zip(some, *got, strict=True):
                out[k] = (int(s), int(i), int(j))
    return out


class Seeds:
    """All n-grams of a block of items: sorted hashes with the places (item, offset) that hold each, and the items' words."""

    def __init__(self, items: list[np.ndarray]) -> None:
        self.items = items
        self.sizes = np.array([len(w) for w in items], dtype=np.int64)
        every = np.concatenate([*items, np.zeros(0, dtype=np.uint64)])
        item = np.repeat(np.arange(len(items)), self.sizes)
        self.words, which = np.unique(every, return_inverse=True)
        self.holds = np.unique(item * len(self.words) + which)  # (item, word) as one number
        g, at = shingles(every, np.concatenate([[0], np.cumsum(self.sizes)]), SEED)
        long = self.sizes >= SEED  # a shorter text counts as one gram
        item = np.repeat(np.arange(len(items)), np.diff(at))
        offset = np.arange(len(g)) - np.repeat(at[:-1], np.diff(at))
        g, item, offset = g[long[item]], item[long[item]], offset[long[item]]
        order = np.argsort(g, kind="stable")
        self.keys, self.first = np.unique(g[order], return_index=True)
        self.first = np.append(self.first, len(g))
        self.item, self.offset = item[order], offset[order]
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in g that are seeds, and which."""
        hit = np.flatnonzero(self.seen[(g >> np.uint64(48)).astype(np.int64)])
        if not len(self.keys) or not len(hit):
            return hit[:0], hit[:0]
        at = np.searchsorted(self.keys, g[hit])
        at[at == len(self.keys)] = 0
        ok = self.keys[at] == g[hit]
        return hit[ok], at[ok]


def _windows(row: np.ndarray, item: np.ndarray, slope: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(row, item, first word, word after the last) of the ranges to align, from the seeds' places in the document less those
    in the item.  A passing score bears ``slack`` words more than the item has; ranges that touch are one."""
    order = np.lexsort((slope, item, row))
    row, item, slope = row[order], item[order], slope[order]
    length = sizes[item]
    slack = np.ceil(MATCH * (1 - threshold) * length / -GAP).astype(np.int64) + 2
    a, b = np.maximum(0, slope - slack), np.minimum(lengths[row], slope + length + slack)
    new = np.ones(len(a), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (a[1:] > b[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1 if len(a) else first
    return row[first], item[first], a[first], b[last]


def _can_pass(seeds: Seeds, h: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which ranges a..b of the words h hold as many words of the item as a passing score has matches."""
    if not len(a):
        return np.zeros(0, dtype=bool)
    at = np.searchsorted(seeds.words, h)
    at[at == len(seeds.words)] = 0
    word = np.where(seeds.words[at] == h, at, -1)
    out = np.zeros(len(a), dtype=bool)
    step = max(1, (1 << 21) // max(1, int((b - a).max(initial=1))))
    for lo in range(0, len(a), step):
        part = slice(lo, lo + step)
        n = b[part] - a[part]
        w, job = word[spread(a[part], n)], np.repeat(np.arange(len(n)), n)
        w, job = w[w >= 0], job[w >= 0]
        key = item[part][job] * len(seeds.words) + w
        at = np.searchsorted(seeds.holds, key)
        at[at == len(seeds.holds)] = 0
        matches = np.bincount(job[seeds.holds[at] == key], minlength=len(n))
        out[part] = matches >= threshold * seeds.sizes[item[part]]
    return out


def _search(batch, seeds: Seeds, threshold: float):
    """(row, item, score, first word, last word) of each leak; the best for each row and item."""
    base = 0
    for _, _, buf, offs in text_chunks(batch.column("text")):
        h, _, _, counts = words(LOWER[buf], offs, ALNUM)
        g, at = shingles(h, counts, SEED)
        hit, which = seeds.find(g)
        d = np.searchsorted(at, hit, side="right") - 1
        n = seeds.first[which + 1] - seeds.first[which]
        place = spread(seeds.first[which], n)
        item, slope = seeds.item[place], np.repeat(hit - at[d], n) - seeds.offset[place]
        row, item, a, b = _windows(np.repeat(d, n), item, slope, seeds.sizes, np.diff(counts), threshold)
        ok = _can_pass(seeds, h, item, a + counts[row], b + counts[row], threshold)
        of = list(zip(row[ok].tolist(), item[ok].tolist(), a[ok].tolist(), strict=True))
        jobs = [(seeds.items[k], h[counts[r] + x : counts[r] + y]) for (r, k, x), y in zip(of, b[ok].tolist(), strict=True)]
        found: dict[tuple[int, int], tuple] = {}
        for (row, item, a), (own, window), (score, i, j) in zip(of, jobs, _aligned(jobs), strict=True):
            if score < threshold * MATCH * len(own):
                continue
            back, _, jb = _aligned([(own[: i + 1][::-1], window[: j + 1][::-1])])[0]
            assert back == score
            new = (score / (MATCH * len(own)), a + j - jb, a + j)
            if (row, item) not in found or new[0] > found[(row, item)][0]:
                found[(row, item)] = new
        for (row, item), rest in sorted(found.items()):
            yield base + row, item, *rest
        base += len(offs) - 1


def _blocks(docs: DataFrame, benchmark: DataFrame, block_words: int):
    """(item ids, seeds) of each block of items, broadcast."""
    spark = docs.sparkSession
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * block_words)))  # a word and what parts it from the next are two characters at least
    for k in range(blocks):
        rows = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield spark.sparkContext.broadcast(([r["item_id"] for r in rows], Seeds(item_words([r["text"] for r in rows]))))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word (the aligned words of the document, from 0) of every
    leaked item of every document row."""
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_arrow = {"string": pa.string(), "int": pa.int32()}.get(item_type, pa.int64())
    docs = docs.select("doc_id", "text")
    out = None
    for shared in _blocks(docs, benchmark, block_words):

        def run(batches, shared=shared):
            names, seeds = shared.value
            for batch in batches:
                got = list(_search(batch, seeds, threshold))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64())),
                        pa.array([names[g[1]] for g in got], item_arrow),
                        pa.array([g[2] for g in got], pa.float64()),
                        pa.array([g[3] for g in got], pa.int64()),
                        pa.array([g[4] for g in got], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "score", "first_word", "last_word"],
                )

        part = docs.mapInArrow(run, f"doc_id {doc_type}, item_id {item_type}, score double, first_word long, last_word long")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that leak no item; nothing is joined or shuffled."""
    out = docs
    for shared in _blocks(docs.select("doc_id", "text"), benchmark, block_words):

        def run(batches, shared=shared):
            _, seeds = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[g[0] for g in _search(batch, seeds, threshold)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
