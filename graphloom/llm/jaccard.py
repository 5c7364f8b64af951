"""Exact set join on word n-gram Jaccard, as connected components, by set-relation skipping.

Texts with equal shingle sets are one class.  Tokens (shingle hashes) have one global order: those that no
task saw often by hash, then the frequent ones by frequency over all texts, so that prefixes hold what is
rare.  Two sets that link share a token among the first n - ceil(t n) + 1 of each (prefix filter); only
these are put into inverted lists, as packed records.

* Index level: a list is kept by size, in blocks that know their sizes and least position.  A block is skipped when no
  entry in it can link: sizes too far apart, or too few tokens left behind the common one (positional filter).
* Answer level: each class is first compared with one hub, the set that heads most of its lists, then in ``ROUNDS``
  rounds with the likeliest set of another component that it hasn't met.  Every link found makes the answers of
  its component those of the set, so a group of n near copies costs a few n comparisons.  Then only entries of
  different components can add anything; of these, x and y compared with the same hub h can't link when
  |d(x, h) - d(y, h)| exceeds 1 - t (Jaccard distance is a metric), nor when the parity sketches of the two
  sets differ in more bits than linked sets differ in tokens.  What is left is counted exactly.

So no pair inside a component is made twice over, none is dropped, and components equal those of all links.

Defined cases: null text and text without words have an empty set, link with nothing, and are components of
their own; a text with fewer words than a shingle has one, its whole sequence; repeated rows and equal or
null doc_ids are rows of their own, in one component if their sets are equal (a component's id is its
least doc_id that isn't null); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, components, give_back, mix, partitions_for, shingles, spread, text_chunks, words, written
from .packed import PACKED, Bloom, blobs, reduced, text_key

WORDS, PERCENT = 5, 80
ORDERED = 1 << 17  # frequent tokens that are ordered by frequency; the others by hash
OFTEN = 3  # classes among HELD tokens that make a token worth counting
SKETCH = 512  # bits
BLOCK = 64  # entries of a block of a list
PART = 2048  # entries of a list that meet in one task
PAIRS = 1 << 17  # that are looked at together
ROUNDS = 2  # of comparisons with the likeliest set of another component
LISTED = np.dtype([(c, "<i8") for c in ("token", "s1", "s2", "part", "id", "comp", "n", "pos", "hub")] + [("dist", "<f8"), ("sketch", "<u8", (SKETCH // 64,))])
HELD = 1 << 20  # tokens among which a task looks for frequent ones
SENT = 1 << 18  # entries that a task holds before it sends them
ENTRY = np.dtype([("token", "<u8"), ("k", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def sets_of(buf: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, _, _, counts = words(LOWER[buf], offs, NOT_SPACE)
    g, at = shingles(h, counts, n)
    out = []
    for i in range(len(offs) - 1):
        s = np.sort(g[at[i] : at[i + 1]])
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s)
    return out


def class_keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two longs."""
    a, b = mix(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64), mix(s + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def parity(s: np.ndarray) -> bytes:
    """Bit i: whether an odd number of tokens fall to i.  Two sketches differ in at most as many bits as the sets
    do in tokens."""
    bit = np.bincount((mix(s) >> np.uint64(64 - 9)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(bit.astype(np.uint8)).tobytes()


def wide_parity(s: np.ndarray) -> bytes:
    """The same with about four bits a token (a power of two, 512 at least): halves folded by xor make any smaller one."""
    m = max(512, 1 << int(4 * len(s) - 1).bit_length()) if len(s) else 512
    bit = np.bincount((mix(s) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(bit.astype(np.uint8)).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ, at the size of the smaller."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def need(n: int | np.ndarray, percent: int):
    """Least overlap of a set of n with any set it links to."""
    return -(-percent * n // 100)


def overlap_needed(a, b, percent: int):
    """Least intersection of two sets of a and b that link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _often(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of at least ``OFTEN`` of the sets, and in how many."""
    every = np.sort(np.concatenate([*sets, np.zeros(0, np.uint64)]))
    new = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    c = np.diff(np.append(new, len(every)))
    return every[new[c >= OFTEN]], c[c >= OFTEN]


def summaries(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, t1, t2 (text), k1, k2 (set), n, sketch, wide; on a row now and then the tokens frequent in the ``HELD`` tokens
    of distinct sets before it, with their counts.  What a task holds is bounded by that and one batch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def told(batch, rows: list[tuple], often: tuple[np.ndarray, np.ndarray]):
        k1, k2, size, sketch, wide = zip(*rows, strict=True)
        u, c = often
        ends = pa.array([0] + [len(u)] * len(rows), pa.int32())  # all on the first row
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(size, pa.int64()),
                pa.array(sketch, pa.binary()), pa.array(wide, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(u.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(c.astype(np.int64))),
            ],
            names=["doc_id", "t1", "t2", "k1", "k2", "n", "sketch", "wide", "tokens", "counts"],
        )

    def run(batches):
        seen: dict[tuple[int, int], np.ndarray] = {}  # equal sets count once
        size = 0
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                often = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                if size >= HELD:
                    often, seen, size = _often(list(seen.values())), {}, 0
                yield told(*last, often)
            rows = []
            for _, _, buf, offs in text_chunks(batch.column("text")):
                for x in sets_of(buf, offs, n):
                    key = class_keys(x)
                    rows.append((*key, len(x), parity(x), wide_parity(x)))
                    if key not in seen:
                        seen[key] = x
                        size += len(x)
            last = (batch.select(["doc_id", "t1", "t2"]), rows)
        if last is not None:
            yield told(*last, _often(list(seen.values())))
        give_back()

    schema = f"doc_id {kind}, t1 long, t2 long, k1 long, k2 long, n long, sketch binary, wide binary, tokens array<long>, counts array<long>"
    return docs.mapInArrow(run, schema)


class Order:
    """Global token order: (frequency rank or 0, hash)."""

    def __init__(self, frequent: np.ndarray) -> None:
        a = np.asarray(frequent, dtype=np.int64).view(np.uint64)  # rarest first
        by = np.argsort(a)
        self.keys, self.rank = a[by], by.astype(np.int64) + 1

    def prefix(self, s: np.ndarray, size: int) -> np.ndarray:
        """The first ``size`` tokens of a set sorted by hash."""
        if not len(self.keys):
            return s[:size]
        at = np.searchsorted(self.keys, s)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == s
        if not known.any():
            return s[:size]
        often = s[known]
        often = often[np.argsort(self.rank[at[known]])]
        return np.concatenate((s[~known], often))[:size]


def _entries(docs: DataFrame, frequent: np.ndarray, n: int, percent: int, targets: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Order(frequent))

    def run(batches):
        order = shared.value
        held: dict[tuple[int, int], np.ndarray] = {}  # equal sets of a portion send one set of entries
        size = 0

        def sent():
            e = np.concatenate(list(held.values()))
            return blobs(0, e["token"] % np.uint64(targets), e)

        for batch in batches:
            for _, _, buf, offs in text_chunks(batch.column("text")):
                for x in sets_of(buf, offs, n):
                    key = class_keys(x)
                    if not len(x) or key in held:
                        continue
                    p = order.prefix(x, len(x) - need(len(x), percent) + 1)
                    e = np.empty(len(p), dtype=ENTRY)
                    e["token"], e["k"], e["n"], e["pos"] = p, key[0], len(x), np.arange(len(p))
                    held[key] = e
                    size += len(e)
                if size >= SENT:
                    yield sent()
                    held, size = {}, 0
        if held:
            yield sent()
        give_back()

    return docs.select("text").mapInArrow(run, PACKED)


LISTS = "token long, k long, n long, pos long, hub long, hub_n long"


def _lists(percent: int):
    def work(held: dict[int, np.ndarray]):
        e = held[0]
        e = e[np.lexsort((e["k"], e["n"], e["token"]))]
        same = (e["token"][1:] == e["token"][:-1]) & (e["k"][1:] == e["k"][:-1]) & (e["n"][1:] == e["n"][:-1])
        e = e[np.concatenate(([True], ~same))]  # equal sets of other batches
        begin = np.flatnonzero(np.concatenate(([True], e["token"][1:] != e["token"][:-1])))
        size = np.diff(np.append(begin, len(e)))
        e, lists = e[np.repeat(size > 1, size)], size[size > 1]
        if not len(e):
            return
        # head of each entry: the first of its list that isn't too small
        where = np.repeat(np.arange(len(lists)), lists)
        # (list, size) in one ordered number
        key = where.astype(np.uint64) << np.uint64(32) | e["n"].astype(np.uint64)
        least = where.astype(np.uint64) << np.uint64(32) | need(e["n"].astype(np.int64), percent).astype(np.uint64)
        hub = np.searchsorted(key, least)
        columns = (e["token"].astype(np.int64), e["k"], e["n"].astype(np.int64), e["pos"].astype(np.int64), e["k"][hub], e["n"][hub].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["token", "k", "n", "pos", "hub", "hub_n"])

    return work


def _of(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``table`` whose id is among ``ids``; only those and a few more are shuffled."""
    return Bloom.of(ids, "id", "id").filtered(table, key, key).join(ids.withColumnRenamed("id", key), key, "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("id")).union(pairs.select(F.col("y").alias("id"))).distinct()


def _sifted(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose wide sketches don't rule a link out, written."""
    w = written(_of(classes.select("id", "n", "wide"), _ends(pairs)), "wide")

    def run(batches):
        for batch in batches:
            nx, ny = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("nx", "ny"))
            bits = np.array([apart(a, b) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)], dtype=np.int64)
            ok = bits <= nx + ny - 2 * overlap_needed(nx, ny, percent)
            yield batch.select(["x", "y"]).filter(pa.array(ok))

    j = pairs.join(w.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("wide").alias("a")), "x").join(w.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("wide").alias("b")), "y")
    return written(j.select("x", "y", "nx", "ny", "a", "b").mapInArrow(run, "x long, y long"), "sifted")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """x, y, both: the pairs of class ids with their exact intersection, written.  One text of each class is fetched; sets are
    made where a pair meets, since texts are smaller than their sets."""
    needed = written(_of(classes.select("id", "d1", "t1"), _ends(pairs)), "needed")
    texts = Bloom.of(needed, "d1", "t1").filtered(docs.select("d1", "t1", "text"), "d1", "t1")
    texts = written(texts.join(needed, ["d1", "t1"]).dropDuplicates(["id"]).select("id", "text"), "texts")

    def count(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                both = []
                a, b = ([s for _, _, buf, offs in text_chunks(part.column(c)) for s in sets_of(buf, offs, n)] for c in ("a", "b"))
                for u, v in zip(a, b, strict=True):
                    if len(u) > len(v):
                        u, v = v, u
                    at = np.searchsorted(v, u)
                    at[at == len(v)] = 0
                    both.append(int((v[at] == u).sum()))
                yield pa.RecordBatch.from_arrays([part.column("x"), part.column("y"), pa.array(both, pa.int64())], names=["x", "y", "both"])

    left = pairs.join(texts.select(F.col("id").alias("x"), F.col("text").alias("a")), "x")
    full = left.join(texts.select(F.col("id").alias("y"), F.col("text").alias("b")), "y").select("x", "y", "a", "b")
    return written(full.mapInArrow(count, "x long, y long, both long"), "verified")


def _different_bits(a: str, b: str) -> str:
    """SQL: bits in which two sketches differ."""
    part = lambda s, i: f"conv(hex(substring({s}, {8 * i + 1}, 8)), 16, -10)"
    return " + ".join(f"bit_count(cast({part(a, i)} AS BIGINT) ^ cast({part(b, i)} AS BIGINT))" for i in range(SKETCH // 64))


class _List:
    """One inverted list by size, in blocks.  rows: id, comp, n, pos, hub, distance to hub, sketch (k, SKETCH / 64)."""

    def __init__(self, rows: list[np.ndarray], percent: int) -> None:
        order = np.lexsort((rows[3], rows[2]))
        self.order, self.percent = order, percent
        self.ids, self.comp, self.n, self.pos, self.hub, self.dist, self.bits = (x[order] for x in rows)
        m = len(order)
        self.starts = range(0, m, BLOCK)
        self.head = np.array([self.n[a] for a in self.starts])
        self.last = np.array([self.n[min(m, a + BLOCK) - 1] for a in self.starts])
        self.left = np.array([(self.n[a : a + BLOCK] - self.pos[a : a + BLOCK]).max() for a in self.starts])  # tokens from the common one on
        self.only = np.array([self.comp[a] if (self.comp[a : a + BLOCK] == self.comp[a]).all() else -1 for a in self.starts])

    def partners(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Places after i, of other components, that may link with it, and the bits in which they differ."""
        n, pos, percent, m = self.n, self.pos, self.percent, len(self.ids)
        ahead = n[i] - pos[i]
        found, bits = [], []
        for k, a in enumerate(self.starts):
            if a + BLOCK <= i + 1:
                continue
            if need(int(self.head[k]), percent) > n[i]:
                break  # too large, and so is all that follows
            if self.only[k] == self.comp[i] or min(int(ahead), int(self.left[k])) < overlap_needed(int(n[i]), int(self.head[k]), percent):
                continue
            j = np.arange(max(a, i + 1), min(m, a + BLOCK))
            lap = overlap_needed(n[i], n[j], percent)
            ok = (self.comp[j] != self.comp[i]) & (np.minimum(ahead, n[j] - pos[j]) >= lap) & (need(n[j], percent) <= n[i])
            ok &= (self.hub[j] != self.hub[i]) | (np.abs(self.dist[j] - self.dist[i]) <= 1 - percent / 100 + 1e-9)
            j, lap = j[ok], lap[ok]
            if len(j):
                apart = np.bitwise_count(self.bits[j] ^ self.bits[i]).sum(axis=1).astype(np.int64)
                near = apart <= n[i] + n[j] - 2 * lap
                found.append(j[near])
                bits.append(apart[near])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(bits)


def _candidates(r: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bits) of all pairs of records that may link, over whole groups.  Groups are runs of equal (token, s1, s2); those
    of up to a block are paired together in array operations, larger ones walk their blocks."""
    new = np.ones(len(r), dtype=bool)
    for c in ("token", "s1", "s2"):
        new[1:] &= r[c][1:] == r[c][:-1]
    new[1:] = ~new[1:]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(r)))
    found = []
    small = (size > 1) & (size <= BLOCK)
    # each record of a small group with those after it
    left = np.repeat(size[small], size[small]) - 1 - spread(np.zeros(small.sum(), np.int64), size[small])
    at = spread(first[small], size[small])
    step = 0
    while step < len(at):  # a bounded number of pairs at a time
        end = max(step + 1, int(np.searchsorted(np.cumsum(left[step:]), PAIRS, side="right")) + step)
        i, j = np.repeat(at[step:end], left[step:end]), spread(at[step:end] + 1, left[step:end])
        own = {c: (r[c][i], r[c][j]) for c in ("comp", "n", "pos", "part", "hub", "dist")}
        n, most = sum(own["n"]), np.maximum(*own["n"])
        lap = overlap_needed(n, 0, percent)
        behind = np.minimum(*(m - p for m, p in zip(own["n"], own["pos"], strict=True)))
        ok = np.not_equal(*own["comp"]) & (behind >= lap) & (need(most, percent) <= n - most)
        ok &= np.not_equal(*own["hub"]) | (np.abs(np.subtract(*own["dist"])) <= 1 - percent / 100 + 1e-9)
        ok &= np.not_equal(*own["part"]) | (r["s1"][i] == r["s2"][i])
        i, j, lap, n = i[ok], j[ok], lap[ok], n[ok]
        bits = np.bitwise_count(r["sketch"][i] ^ r["sketch"][j]).sum(axis=1).astype(np.int64)
        near = bits <= n - 2 * lap
        found.append((i[near], j[near], bits[near]))
        step = end
    for a, m in zip(first[size > BLOCK].tolist(), size[size > BLOCK].tolist(), strict=True):
        own = r[a : a + m]
        if (own["comp"] == own["comp"][0]).all():
            continue
        walk = _List([own[c] for c in ("id", "comp", "n", "pos", "hub", "dist", "sketch")], percent)
        sides = own["part"][walk.order] if own["s1"][0] != own["s2"][0] else None
        for i in range(m):
            j, bits = walk.partners(i)
            if sides is not None and len(j):
                other = sides[j] != sides[i]
                j, bits = j[other], bits[other]
            if len(j):
                found.append((np.full(len(j), a + walk.order[i]), a + walk.order[j], bits))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _least(x: np.ndarray, bits: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each x its k distinct y of least (bits, y)."""
    order = np.lexsort((y, bits, x))
    x, y, bits = x[order], y[order], bits[order]
    same = np.zeros(len(x), dtype=bool)
    same[1:] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])  # a pair has the same bits wherever it meets
    x, y, bits = x[~same], y[~same], bits[~same]
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(x)))
    few = spread(np.zeros(len(first), np.int64), size) < k
    return x[few], y[few], bits[few]


def _scan(lists: DataFrame, percent: int, targets: int, what: str) -> DataFrame:
    """lists: token, s1, s2, part, id, comp, n, pos, hub, dist, sketch.  Gives token, x, y, bits:
    ``entries``: token, id and pos of the entries with a partner that may link;
    ``nearest``: each x with its likeliest partners of each portion, more than it can have met, and the bits in which they differ;
    ``pairs``: all x < y that may link."""

    def told(r: np.ndarray):
        i, j, bits = _candidates(r, percent)
        if what == "entries":
            k = np.unique(np.concatenate((i, j)))
            out = (r["token"][k], r["id"][k], r["pos"][k], np.zeros(len(k), np.int64))
        else:
            x, y = r["id"][i], r["id"][j]
            if what == "nearest":
                x, y, bits = _least(np.concatenate((x, y)), np.concatenate((bits, bits)), np.concatenate((y, x)), ROUNDS + 1)
                out = (np.zeros(len(x), np.int64), x, y, bits)
            else:
                both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
                out = (np.zeros(len(both), np.int64), both[:, 0], both[:, 1], np.zeros(len(both), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, dtype=np.int64)) for c in out], names=["token", "x", "y", "bits"])

    def run(batches):
        kept = np.zeros(0, dtype=LISTED)  # the last group, which may go on
        for batch in batches:
            r = np.empty(batch.num_rows, dtype=LISTED)
            for c in ("token", "s1", "s2", "part", "id", "comp", "n", "pos", "hub", "dist"):
                r[c] = batch.column(c).to_numpy(zero_copy_only=False)
            r["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(r), SKETCH // 64)
            r = np.concatenate((kept, r))
            if not len(r):
                continue
            differs = np.flatnonzero((r["token"] != r["token"][-1]) | (r["s1"] != r["s1"][-1]) | (r["s2"] != r["s2"][-1]))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            kept = r[cut:].copy()
            if cut:
                yield told(r[:cut])
        if len(kept):
            yield told(kept)
        give_back()

    keys = ("token", "s1", "s2")
    return lists.repartition(targets, *keys).sortWithinPartitions(*keys).mapInArrow(run, "token long, x long, y long, bits long")


def _dealt(entries: DataFrame, comp: DataFrame) -> DataFrame:
    """entries: token, id, pos -> token, s1, s2, part, id, comp, pos: only of lists that hold two components, counted with
    map-side combine before any list is gathered.  A list of more than ``PART`` entries is parted by id; each two parts meet in
    a group of their own, so no task holds a whole hot list."""
    placed = entries.join(comp.select("id", "root"), "id", "left").select("token", "id", "pos", F.coalesce("root", "id").alias("comp"))
    per = placed.groupBy("token").agg(F.count("*").alias("m"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b")
    parts = per.select("token", F.ceil(F.col("m") / PART).cast("int").alias("parts"))
    own = placed.join(parts, "token").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    met = own.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("token", F.least("part", "with").alias("s1"), F.greatest("part", "with").alias("s2"), "part", "id", "comp", "pos")


def row_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, t1, t2 (key of the text), n_shingles, component_id for every row."""
    targets = partitions_for(docs)
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t1, t2 = text_key("text")
    docs = text.select("doc_id", t1.alias("t1"), t2.alias("t2"), "text").withColumn("d1", F.xxhash64("doc_id", "t2"))
    rows = written(summaries(docs, n), "summaries")
    frequent = (
        rows.where("size(tokens) > 0")
        .select(F.explode(F.arrays_zip("tokens", "counts")).alias("z"))
        .groupBy(F.col("z.tokens").alias("token"))
        .agg(F.sum("z.counts").alias("c"))
        .orderBy(F.desc("c"), "token")
        .limit(ORDERED)
        .select("token")
        .toArrow()
    )
    order = frequent.column("token").to_numpy()[::-1]
    classes = (
        rows.where("n > 0")
        .groupBy("k1", "k2", "n")
        .agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "t1", "t2")).alias("t"), F.any_value("sketch").alias("sketch"), F.any_value("wide").alias("wide"))
        .select("k1", "k2", "n", "low", "t.t1", F.xxhash64("t.doc_id", "t.t2").alias("d1"), "sketch", "wide")
    )
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    lists = written(reduced(_entries(docs, order, n, percent, targets), targets, {0: ENTRY}, _lists(percent), LISTS), "lists")

    # first: each class with the hub that heads most of its lists
    votes = lists.where("k <> hub OR n <> hub_n").groupBy("k", "n", "hub", "hub_n").agg(F.count("*").alias("v"))
    best = votes.groupBy("k", "n").agg(F.max(F.struct("v", "hub", "hub_n")).alias("b")).select("k", "n", F.col("b.hub").alias("hub"), F.col("b.hub_n").alias("hub_n"))
    c = classes.select(F.col("k1").alias("k"), "n", F.col("id").alias("x"), F.col("sketch").alias("sx"))
    h = classes.select(F.col("k1").alias("hub"), F.col("n").alias("hub_n"), F.col("id").alias("y"), F.col("sketch").alias("sy"))
    first = best.join(c, ["k", "n"]).join(h, ["hub", "hub_n"])
    lap = f"cast(ceil({percent} * (n + hub_n) / {100 + percent}.0D) AS BIGINT)"
    asked = written(first.where(f"{_different_bits('sx', 'sy')} <= n + hub_n - 2 * ({lap} - 1)").select("x", "y"), "first")
    size = classes.select("id", "n")
    linked = F.expr(f"100 * both >= {percent} * (nx + ny - both)")

    def tried(pairs: DataFrame) -> DataFrame:
        t = _verified(docs, classes, _sifted(classes, pairs, percent), n)
        t = t.join(size.select(F.col("id").alias("x"), F.col("n").alias("nx")), "x").join(size.select(F.col("id").alias("y"), F.col("n").alias("ny")), "y")
        return written(t.select("x", "y", linked.alias("linked"), F.expr("1D - both / cast(nx + ny - both AS DOUBLE)").alias("dist")), "tried")

    def components_with(comp: DataFrame | None, new: DataFrame) -> DataFrame:
        """id, root after more links: only their ends' roots are joined anew."""
        edges = new.where("linked").select("x", "y")
        if comp is None:
            return written(components(edges, "x", "y").select(F.col("node").alias("id"), "root"), "comp")
        r = comp.select("id", "root")
        ends = edges.join(r.select(F.col("id").alias("x"), F.col("root").alias("a")), "x", "left").join(r.select(F.col("id").alias("y"), F.col("root").alias("b")), "y", "left")
        top = components(ends.select(F.coalesce("a", "x").alias("a"), F.coalesce("b", "y").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
        old = r.join(top, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
        return written(old.union(top.select("root", "top").join(r.select(F.col("id").alias("root")), "root", "left_anti")), "comp")

    # a class that was compared with none is its own hub; its members then measure from it
    seen = tried(asked)
    hubs = seen.select(F.col("x").alias("id"), F.col("y").alias("hub"), "dist")
    comp = components_with(None, seen)
    slim = written(lists.join(classes.select(F.col("k1").alias("k"), "n", "id"), ["k", "n"]).select("token", "id", "pos"), "slim")
    base = classes.join(slim.select("id").distinct(), "id", "left_semi").select("id", "n", "sketch").join(hubs, "id", "left")
    base = written(base.select("id", "n", "sketch", F.coalesce("hub", "id").alias("hub"), F.coalesce("dist", F.lit(0.0)).alias("dist")), "base")

    def scan(entries: DataFrame, what: str) -> DataFrame:
        known = base.select("id", "n", "sketch", "hub", "dist")
        return _scan(_dealt(entries, comp).join(known, "id"), percent, targets, what)

    entries = written(scan(slim, "entries").select("token", F.col("x").alias("id"), F.col("y").alias("pos")), "entries")
    for step in range(ROUNDS + 1):
        if step < ROUNDS:
            known = asked.union(asked.select("y", "x"))
            new = scan(entries, "nearest").join(known, ["x", "y"], "left_anti").groupBy("x").agg(F.min(F.struct("bits", "y")).alias("b")).select("x", F.col("b.y").alias("y"))
        else:
            new = scan(entries, "pairs").select("x", "y").distinct()
        new = written(new, "asked")
        if new.isEmpty():
            break
        asked = written(asked.union(new), "asked") if step < ROUNDS else asked
        both = lambda t: t.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        fresh = tried(both(new).distinct().join(both(seen), ["x", "y"], "left_anti"))
        seen = written(seen.union(fresh), "seen")
        comp = components_with(comp, fresh)
    of = classes.select("k1", "k2", "n", "id", "low").join(comp, "id", "left").select("k1", "k2", "n", "low", F.coalesce("root", "id").alias("top"))
    lows = of.groupBy("top").agg(F.min("low").alias("component_id"))
    of = of.join(lows, "top").select("k1", "k2", "n", "component_id")
    out = rows.select("doc_id", "t1", "t2", "k1", "k2", "n").join(of, ["k1", "k2", "n"], "left")
    return out.select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    return row_components(docs, n, percent).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, one of each component: that of the component's id (of repeated rows one).  Rows with
    empty sets all stay.  All columns stay, whatever their names.  Only rows whose key may be that of a
    dropped or repeated row are shuffled."""
    rows = written(row_components(docs, n, percent), "components")
    same = rows.where("n_shingles > 0").groupBy("doc_id", "t1", "t2", "component_id").agg(F.count("*").alias("times"))
    heads = same.groupBy(F.col("component_id").alias("c")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t1", "t2")).alias("h"))
    stays = F.col("doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("t1") == F.col("h.t1")) & (F.col("t2") == F.col("h.t2"))
    odd = same.join(heads, F.col("component_id").eqNullSafe(F.col("c"))).withColumn("stays", stays).where("NOT stays OR times > 1")
    odd = written(odd.select(F.col("doc_id").alias("d_"), F.col("t1").alias("t1_"), F.col("t2").alias("t2_"), "stays"), "odd")
    t1, t2 = text_key("t")
    keyed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("t")).select("row", t1.alias("t1_"), t2.alias("t2_"))
    bloom = Bloom.of(odd, "t1_", "t2_")
    sure = bloom.filtered(keyed, "t1_", "t2_", among=False).select("row")
    some = bloom.filtered(keyed, "t1_", "t2_").alias("k")
    met = some.join(odd.alias("o"), F.expr("k.t1_ = o.t1_ AND k.t2_ = o.t2_ AND k.row.doc_id <=> o.d_"), "left").where("o.stays IS NULL OR o.stays")
    once = met.where("o.stays").select("k.row", F.col("k.row.doc_id").alias("d"), "k.t1_", "k.t2_").dropDuplicates(["d", "t1_", "t2_"])
    rest = met.where("o.stays IS NULL").select("k.row")
    return sure.unionAll(once.select("row").unionAll(rest)).select("row.*")
