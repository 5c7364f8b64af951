"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Windows of ``LENGTH`` bytes are suffixes cut at that length.  Suffix buckets are formed by content: the
anchor of a window is its k-gram of least hash, so equal windows have equal anchors at equal offsets, and
the windows of a text fall into runs that share one anchor (about one run for seventy bytes).

1. Every run is sent to the bucket of its anchor as a few numbers: the hashes of anchor and run.  Runs that
   occur twice whole are repeated; a run alone under its anchor is unique.  Equal runs of one task are
   resolved there and sent once.
2. Of the rest (runs that share their anchor with a different run: where repeated passages begin and end)
   the bytes are fetched, and each bucket's suffixes are sorted by blockwise difference-cover sorting: one
   bucket block at a time, by their first ``V`` bytes, longer ties by the precomputed ranks of the block's
   cover sample (positions whose residue modulo ``V`` is in a difference cover), at most one more read for any
   pair.  Memory is bounded by the block.
3. Neighbours that agree over ``LENGTH`` bytes are repeated.

Anchors that a bounded sample of documents shows to be hot are not used as buckets: the windows of their runs
are dealt by the hash of the whole window, so no bucket grows with the copies of one passage.  All tasks share
that list, and the result doesn't depend on it.

Defined cases: null text counts as empty; texts shorter than ``LENGTH`` keep all bytes; equal texts are
each other's copies, so all of their windows are repeated; matches never cross documents; repeated rows and
null ids are documents like any other; extra columns are ignored or kept.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, give_back, mix, partitions_for, powers, text_chunks, written
from .packed import PACKED, Bloom, blobs, reduced, text_key

LENGTH = 200
GRAM = 64  # bytes of an anchor
SAMPLE_DOCS = 4_000  # at which hot anchors are looked for
HOT = 0.004  # share of the sample's documents that makes an anchor hot
FLUSH = 1 << 18  # runs that a task holds before it sends them
BLOCK = 1 << 18  # bytes that are sorted at a time; the work arrays are over a hundred times as large
V = 32

RUN = np.dtype([("anchor", "<u8"), ("seg", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("a", "<u4"), ("n", "u1"), ("off", "u1"), ("many", "u1")])
SPAN = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("a", "<u4"), ("b", "<u4")])


# ---------------------------------------------------------------- runs


def runs_of(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(first window, last window, anchor place, anchor hash, run hash, prefix hashes) over a chunk of whole texts."""
    n = len(buf)
    width = length - gram + 1
    none = np.zeros(0, dtype=np.int64)
    p, inv = powers(n + 1)
    c = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * p[:n], out=c[1:])
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), (c, inv)
    h = mix((c[gram:] - c[:-gram]) * inv[: n - gram + 1])
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    # least key of each ``width`` in a row: prefix and suffix minima of blocks
    blocks = -(-len(key) // width)
    pad = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    pad[: len(key)] = key
    pad = pad.reshape(blocks, width)
    pre = np.minimum.accumulate(pad, axis=1).ravel()
    suf = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    at = (np.minimum(suf[:windows], pre[width - 1 : width - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offs)
    valid = np.zeros(n + 1, dtype=np.int64)
    long = size >= length
    valid[offs[:-1][long]] += 1
    np.subtract.at(valid, offs[:-1][long] + size[long] - length + 1, 1)
    ok = np.cumsum(valid)[:windows] > 0
    change = np.empty(windows, dtype=bool)
    change[0] = True
    change[1:] = (at[1:] != at[:-1]) | (ok[1:] != ok[:-1])
    change[offs[:-1][long]] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], windows) - 1
    own = ok[first]
    first, last = first[own], last[own]
    place = at[first]
    seg = mix((c[last + length] - c[first]) * inv[first] + (last - first).astype(np.uint64))
    return first, last, place, h[place], seg, (c, inv)


_OTHER = mix(_BYTE + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def window_hashes(buf: np.ndarray, c: np.ndarray, inv: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the window at each start, from two tables of byte values."""
    p, _ = powers(len(buf) + 1)
    c2 = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_OTHER[buf] * p[: len(buf)], out=c2[1:])
    one, two = ((x[starts + length] - x[starts]) * inv[starts] for x in (c, c2))
    return mix(one ^ np.uint64(0xA5A5A5A5A5A5A5A5)), mix(two + np.uint64(length))


def hot_anchors(docs: DataFrame, length: int, gram: int, sample: int = SAMPLE_DOCS, share: float = HOT) -> np.ndarray:
    """Anchors in at least ``share`` of a sample of about ``sample`` documents, chosen by a hash of the text."""
    total = docs.count()
    part = min(1.0, sample / max(1, total))
    some = docs.where(F.pmod(F.xxhash64(F.lit("hot"), "text", "doc_id"), F.lit(1 << 20)) < F.lit(int(part * (1 << 20)) + 1)).select("text")

    def anchors(batches):
        for batch in batches:
            for _, _, buf, offs in text_chunks(batch.column("text")):
                first, _, _, anchor, _, _ = runs_of(buf, offs, length, gram)
                d = np.searchsorted(offs, first, side="right")
                pairs = np.unique(np.stack((anchor, d.astype(np.uint64)), axis=1), axis=0)
                u, n = np.unique(pairs[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    least = max(8, int(share * min(total, sample)))
    rows = some.mapInArrow(anchors, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h").collect()
    return np.sort(np.array([r["h"] for r in rows], dtype=np.int64).view(np.uint64))


def _among(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x


def _groups(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records sorted by (anchor, seg), and whether each begins a new such pair."""
    r = r[np.lexsort((r["seg"], r["anchor"]))]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r["anchor"][1:] != r["anchor"][:-1]) | (r["seg"][1:] != r["seg"][:-1])
    return r, new


def _spans(r: np.ndarray) -> np.ndarray:
    out = np.empty(len(r), dtype=SPAN)
    out["k1"], out["k2"], out["a"], out["b"] = r["k1"], r["k2"], r["a"], r["a"] + r["n"]
    return out


def _joined(s: np.ndarray) -> np.ndarray:
    """Spans of one text that overlap or follow on each other as one."""
    if not len(s):
        return s
    s = s[np.lexsort((s["a"], s["k2"], s["k1"]))]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s["k1"][1:] != s["k1"][:-1]) | (s["k2"][1:] != s["k2"][:-1])
    text = np.cumsum(new).astype(np.int64) << 32
    reach = np.maximum.accumulate(text + s["b"])  # texts are in order, so earlier ones don't reach in
    new[1:] |= text[1:] + s["a"][1:] > reach[:-1] + 1
    at = np.flatnonzero(new)
    out = s[at].copy()
    out["b"] = np.maximum.reduceat(s["b"], at)
    return out


def _send(parts: list[np.ndarray], targets: int):
    """Equal runs of this task are resolved here; one of each goes to its bucket, marked."""
    r, new = _groups(np.concatenate(parts))
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(r)))
    many = np.repeat(size > 1, size)
    one = r[at].copy()
    one["many"] = size > 1
    yield blobs(0, one["anchor"] % np.uint64(targets), one)
    done = _joined(_spans(r[many]))
    yield blobs(1, np.arange(len(done)) // 4096 % targets, done)


def _sent(docs: DataFrame, hot: np.ndarray, targets: int, length: int, gram: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            k1, k2 = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("k1", "k2"))
            for lo, _, buf, offs in text_chunks(batch.column("text")):
                first, last, place, anchor, seg, (c, inv) = runs_of(buf, offs, length, gram)
                if not len(first):
                    continue
                d = np.searchsorted(offs, first, side="right") - 1
                r = np.zeros(len(first), dtype=RUN)
                r["anchor"], r["seg"], r["k1"], r["k2"] = anchor, seg, k1[lo + d], k2[lo + d]
                r["a"], r["n"], r["off"] = first - offs[d], last - first, place - first
                out = _among(shared.value, anchor)
                if out.any():
                    n = (last - first + 1)[out]
                    each = np.repeat(r[out], n)
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    each["a"] += step.astype(np.uint32)
                    each["n"] = each["off"] = 0
                    each["anchor"], each["seg"] = window_hashes(buf, c, inv, np.repeat(first[out], n) + step, length)
                    r = np.concatenate((r[~out], each))
                held.append(r)
                size += len(r)
                if size >= FLUSH:
                    yield from _send(held, targets)
                    held, size = [], 0
        if held:
            yield from _send(held, targets)
        give_back()

    return docs.select("k1", "k2", "text").mapInArrow(run, PACKED)


FOUND = "anchor long, k1 long, k2 long, a long, n int, off int, open boolean, cand boolean"


def _resolve(held: dict[int, np.ndarray]):
    """Of a bucket range: runs repeated whole (cand false) and runs to be sorted (cand true; open: not yet
    known to be repeated)."""
    out = [(x, False, False) for k, x in held.items() if k == 1]
    rows = []
    for x, _, _ in out:
        rows.append((np.zeros(len(x), np.uint64), x["k1"], x["k2"], x["a"], x["b"] - x["a"], np.zeros(len(x), np.uint8), np.zeros(len(x), bool), np.zeros(len(x), bool)))
    if 0 in held:
        r, new = _groups(held[0])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(r)))
        many = (size > 1) | np.maximum.reduceat(r["many"], at).astype(bool)
        # runs that weren't resolved in their task
        whole = r[np.repeat(many, size) & (r["many"] == 0)]
        rows.append((np.zeros(len(whole), np.uint64), whole["k1"], whole["k2"], whole["a"], whole["n"], whole["off"], np.zeros(len(whole), bool), np.zeros(len(whole), bool)))
        one = r[at]
        begins = np.ones(len(one), dtype=bool)
        begins[1:] = one["anchor"][1:] != one["anchor"][:-1]
        g = np.flatnonzero(begins)
        kinds = np.diff(np.append(g, len(one)))
        some_open = np.add.reduceat(~many, g) > 0
        pick = np.repeat((kinds > 1) & some_open, kinds)
        c = one[pick]
        rows.append((c["anchor"], c["k1"], c["k2"], c["a"], c["n"], c["off"], ~many[pick], np.ones(len(c), bool)))
    for anchor, k1, k2, a, n, off, still, cand in rows:
        if len(k1):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(anchor).view(np.int64)), pa.array(np.ascontiguousarray(k1)), pa.array(np.ascontiguousarray(k2)), pa.array(a.astype(np.int64)),
                    pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(still), pa.array(cand),
                ],
                names=["anchor", "k1", "k2", "a", "n", "off", "open", "cand"],
            )


# ---------------------------------------------------------------- sorting


@functools.lru_cache(maxsize=4)
def cover(v: int = V) -> tuple[np.ndarray, np.ndarray]:
    """A difference cover of the residues modulo v, and for each pair of residues the least shift that
    brings both into it."""
    chosen = [0]
    missing = set(range(1, v))
    while missing:
        gain = lambda x: len({y for d in chosen for y in ((x - d) % v, (d - x) % v)} & missing)  # noqa: B023, E731
        best = max((x for x in range(v) if x not in chosen), key=lambda x: (gain(x), -x))
        missing -= {y for d in chosen for y in ((best - d) % v, (d - best) % v)}
        chosen.append(best)
    d = np.zeros(v, dtype=bool)
    d[chosen] = True
    shift = np.array([[next(s for s in range(v) if d[(i + s) % v] and d[(j + s) % v]) for j in range(v)] for i in range(v)])
    return d, shift


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks (equal for equal) of rows by the keys, first key first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_suffixes(text: np.ndarray, starts: np.ndarray, length: int = LENGTH, v: int = V) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of ``text`` at ``starts``, each cut at ``length`` bytes (which it must have; v divides 64,
    length is over 2 v), and whether each equals the one before it in that order."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    n = len(text)
    t = np.zeros(n + length + 2 * v, dtype=np.uint8)
    t[:n] = text
    w = np.zeros(len(t) - 8, dtype=np.uint64)
    for k in range(8):
        w = (w << np.uint64(8)) | t[k : k + len(w)]
    block = lambda i, size: [w[i + k] for k in range(0, size - 7, 8)] + ([w[i + size - 8]] if size % 8 else [])
    inside, shift = cover(v)
    mid = length - v  # bytes that a sample rank stands for
    sample = np.flatnonzero(inside[np.arange(n) % v])
    rank = np.zeros(n + length + 2 * v, dtype=np.int64)
    rank[sample] = _dense(block(sample, v))
    have = v
    while have * 2 <= mid:
        rank[sample] = _dense([rank[sample], rank[sample + have]])
        have *= 2
    if have < mid:
        # the last ``mid`` - ``have`` bytes: ranks of v-byte names don't reach, so take the words themselves
        rank[sample] = _dense([rank[sample], *block(sample + have, mid - have)])
    order = np.lexsort(block(starts, v)[::-1])
    s = starts[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in block(s, v)], axis=0)
    group = np.cumsum(new) - 1
    residue = s % v
    first = np.flatnonzero(new)
    mixed = np.minimum.reduceat(residue, first) != np.maximum.reduceat(residue, first)
    # ties of one residue: the next cover position serves all of them
    own = s + shift[residue, residue]
    tail = block(s + mid, v)
    fine = np.lexsort([*tail[::-1], rank[own], group])
    order, s = order[fine], s[fine]
    same = np.zeros(len(s), dtype=bool)
    same[1:] = (group[fine][1:] == group[fine][:-1]) & (rank[s[1:] + shift[s[1:] % v, s[1:] % v]] == rank[s[:-1] + shift[s[:-1] % v, s[:-1] % v]])
    same[1:] &= ~np.any([x[1:] != x[:-1] for x in block(s + mid, v)], axis=0)
    raw = None
    for g in np.flatnonzero(mixed):
        # ties across residues: any two compare at the shift that brings both into the cover
        a, b = first[g], first[g + 1] if g + 1 < len(first) else len(s)
        if raw is None:
            raw = t.tobytes()

        def compare(x: int, y: int, raw=raw) -> int:
            d = shift[x % v, y % v]
            p, q = rank[x + d], rank[y + d]
            if p != q:
                return -1 if p < q else 1
            p, q = raw[x + mid : x + length], raw[y + mid : y + length]
            return (p > q) - (p < q)

        at = sorted(range(a, b), key=functools.cmp_to_key(lambda i, j: compare(int(s[i]), int(s[j]))))  # noqa: B023
        order[a:b], s[a:b] = order[at], s[at]
        same[a] = False
        for i in range(a + 1, b):
            same[i] = compare(int(s[i - 1]), int(s[i])) == 0
    return order, same


def _sort_block(rows: list[tuple], length: int):
    """(k1, k2, first window, last window) of the repeated windows of open runs in one block of buckets.
    rows: k1, k2, a, n, off, open, bytes."""
    at = 0
    starts, owner, text_parts = [], [], []
    for k, (_, _, _, n, off, _, raw) in enumerate(rows):
        pad = -(at + off) % V  # anchors stand at residue 0, so that equal windows have equal residues
        text_parts.append(b"\0" * pad + raw)
        at += pad
        starts.append(np.arange(at, at + n + 1))
        owner.append(np.full(n + 1, k))
        at += len(raw)
    starts_, owner_ = np.concatenate(starts), np.concatenate(owner)
    text = np.frombuffer(b"".join(text_parts), dtype=np.uint8)
    order, same = sort_suffixes(text, starts_, length)
    twin = same.copy()
    twin[:-1] |= same[1:]
    hit = np.zeros(len(starts_), dtype=bool)
    hit[order] = twin
    begin = np.concatenate(([0], np.cumsum([len(s) for s in starts])))
    for k, (k1, k2, a, _, _, still, _) in enumerate(rows):
        if not still:
            continue
        x = np.flatnonzero(np.diff(np.concatenate(([0], hit[begin[k] : begin[k + 1]].astype(np.int8), [0]))))
        for i, j in zip(x[::2], x[1::2], strict=True):
            yield k1, k2, a + int(i), a + int(j) - 1


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """k1, k2 (key of a text), a, b: first and last start of repeated windows of that text.
    docs: k1, k2, doc_id, text (no nulls)."""
    targets = partitions_for(docs)
    hot = hot_anchors(docs, length, gram)
    sent = _sent(docs, hot, targets, length, gram)
    found = written(reduced(sent, targets, {0: RUN, 1: SPAN}, _resolve, FOUND), "runs")
    whole = found.where("NOT cand").select("k1", "k2", "a", (F.col("a") + F.col("n")).alias("b"))
    cand = found.where("cand")
    texts = Bloom.of(cand).filtered(docs.select("k1", "k2", "text")).dropDuplicates(["k1", "k2"])

    segments = cand.join(texts, ["k1", "k2"]).select(
        "anchor", "k1", "k2", "a", "n", "off", "open", F.substring(F.col("text").cast("binary"), F.col("a").cast("int") + 1, F.col("n") + length).alias("raw")
    )

    def sort(batches):
        held, size, now = [], 0, None

        def done():
            got = list(_sort_block(held, length))
            cols = list(zip(*got, strict=True)) if got else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k1", "k2", "a", "b"])

        for batch in batches:
            for anchor, *row in zip(*(batch.column(x).to_pylist() for x in ("anchor", "k1", "k2", "a", "n", "off", "open", "raw")), strict=True):
                if size >= BLOCK and anchor != now:
                    yield done()
                    held, size = [], 0
                now = anchor
                held.append(tuple(row))
                size += len(row[-1])
        if held:
            yield done()
        give_back()

    edge = segments.repartition(targets, "anchor").sortWithinPartitions("anchor").mapInArrow(sort, "k1 long, k2 long, a long, b long")
    return written(whole.union(edge), "spans")


# ---------------------------------------------------------------- results


def merge(ranges: list, length: int) -> list[tuple[int, int]]:
    """Maximal covered byte runs of windows that start in the (first, last) ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [tuple(x) for x in out]


def cut_out(raw: bytes, ranges: list, length: int) -> tuple[bytes, int, int]:
    """Kept bytes, number removed, number of maximal removed runs."""
    spans = merge(ranges, length)
    at, parts = 0, []
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts), sum(b - a for a, b in spans), len(spans)


def _with_ranges(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(rows without repeats: row, text), (other rows: row, text, ranges): row is the struct of all columns of ``docs``, so
    that no name clashes; ranges may be null."""
    keyed = docs.select(F.struct(*[f"`{x}`" for x in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    k1, k2 = text_key("text")
    keyed = keyed.withColumns({"k1": k1, "k2": k2})
    spans = repeated_windows(keyed.select("k1", "k2", F.col("row.doc_id").alias("doc_id"), "text"), length, gram)
    per = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    bloom = Bloom.of(spans)
    clean = bloom.filtered(keyed.drop("text"), among=False).select("row", F.coalesce("row.text", F.lit("")).alias("text"))
    some = bloom.filtered(keyed.drop("text")).join(per, ["k1", "k2"], "left")
    return clean, some.select("row", F.coalesce("row.text", F.lit("")).alias("text"), "ranges")


def _cut_rows(touched: DataFrame, length: int, made: Callable[[bytes, list, int], tuple], columns: list[tuple[str, T.DataType, pa.DataType]]) -> DataFrame:
    """``row`` with the columns that ``made`` gives for (bytes, ranges, length)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [
                    made(text.encode("utf-8", "surrogatepass"), [(x["a"], x["b"]) for x in ranges or ()], length)
                    for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True)
                ]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(c, t) for c, (_, _, t) in zip(cols, columns, strict=True)]], names=["row", *[n for n, _, _ in columns]])

    return touched.mapInArrow(run, T.StructType([touched.schema["row"], *[T.StructField(n, t) for n, t, _ in columns]]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (all columns) with kept binary, n_bytes, n_removed, n_spans added at the end; columns of these names
    are replaced."""
    added = ("kept", "n_bytes", "n_removed", "n_spans")
    docs = docs.drop(*added)
    clean, touched = _with_ranges(docs, length, gram)
    clean = clean.select("row.*", F.col("text").cast("binary").alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))

    def made(raw: bytes, ranges: list, length: int) -> tuple:
        kept, gone, spans = cut_out(raw, ranges, length)
        return kept, len(raw), gone, spans

    long = (T.LongType(), pa.int64())
    cut = _cut_rows(touched, length, made, [("kept", T.BinaryType(), pa.binary()), *[(n, *long) for n in added[1:]]])
    return clean.unionAll(cut.select("row.*", *added))


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs.select("doc_id", "text"), length, gram).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def kept_text(raw: bytes, ranges: list, length: int) -> str:
    """The text without its repeated bytes; what is left of a cut character goes too, other characters all stay."""
    at, parts = 0, []
    for a, b in [*merge(ranges, length), (len(raw), len(raw))]:
        parts.append(raw[at:a].decode("utf-8", "ignore"))  # broken only where it was cut: at its ends
        at = b
    return "".join(parts)


def dedup_text(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated bytes taken out of text (what is left of a cut character goes too); n_chars, where it is
    a column, follows.  All other columns stay, whatever their names."""
    clean, touched = _with_ranges(docs, length, gram)
    rest = touched.where("ranges IS NULL").select("row.*")  # let through by the filter's size
    cut = _cut_rows(touched.where("ranges IS NOT NULL"), length, lambda raw, ranges, n: (kept_text(raw, ranges, n),), [("kept", T.StringType(), pa.string())])
    n_chars = lambda x: F.length("kept").cast(docs.schema[x].dataType)
    new = {"text": lambda x: F.col("kept"), "n_chars": n_chars}
    cut = cut.select(*[(new[x](x) if x in new else F.col("row")[x]).alias(x) for x in docs.columns])
    return clean.select("row.*").unionAll(rest).unionAll(cut)
