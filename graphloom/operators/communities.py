"""Communities by modularity: local moves, contraction, and moves again on every level.

A level is a weighted graph; a row of its nodes has the node's strength k (twice its loop's weight included) and its community.  In
a round each node finds the neighbouring community that it gains most by, from three aggregates: its weight into each one, the
communities' strengths, and the graph's.  Only a part of the nodes (by a hash that changes with the round) moves at once, for two
that swap places gain nothing; the sum over all is measured after each round, and a round that lost is taken again with
a quarter of the nodes.  So modularity never falls, and the moves end by themselves.

Communities then become the nodes of the next level.  When no level gains any more, nodes of the first level move once more between
the communities found, which mends what early rounds decided, and if that gains, levels are built again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cut import cut

#: Fixed values.
CLUSTERING_TYPES = ("CALLS", "EXTENDS", "IMPLEMENTS")
SYMBOL_LABELS = ("Function", "Class", "Method", "Interface")
MIN_CONFIDENCE_LARGE = 0.5
LARGE_FROM = 10_000
RESOLUTION_LARGE = 2.0
#: Arcs of a block, on the mean.
ARCS_A_BLOCK = 500_000


def community_graph(nodes: DataFrame, edges: DataFrame, labels: Sequence[str] = SYMBOL_LABELS, large_from: int | None = LARGE_FROM) -> tuple[DataFrame, DataFrame, float]:
    """nodes(id, label), edges(src, dst, type, confidence) -> vertices(id), pairs(src, dst) and the resolution.  Vertices are symbols of
    ``labels`` with an edge of the clustering types to any other node; with over ``large_from`` symbols, edges need a confidence of
    0.5, vertices two edges, and the resolution is 2 (without ``large_from``, never)."""
    symbols = nodes.where(F.col("label").isin(list(labels))).select("id")
    large = large_from is not None and symbols.limit(large_from + 1).count() > large_from
    e = edges.where(F.col("type").isin(list(CLUSTERING_TYPES)) & (F.col("src") != F.col("dst")))
    if large:
        e = e.where(F.col("confidence") >= MIN_CONFIDENCE_LARGE)
    e = cut(e.select("src", "dst"))  # read for degrees and for pairs
    degree = e.select(F.col("src").alias("id")).unionAll(e.select("dst")).groupBy("id").agg(F.count("*").alias("n"))
    vertices = cut(symbols.join(degree.where(F.col("n") >= (2 if large else 1)), "id", "left_semi").distinct())
    pairs = e.select("src", "dst").join(vertices.withColumnRenamed("id", "src"), "src", "left_semi").join(vertices.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").distinct()
    return vertices, pairs, RESOLUTION_LARGE if large else 1.0


def _hashed(x: np.ndarray, seed: int = 42, last: int | None = None) -> np.ndarray:
    """``F.xxhash64`` of whole numbers (with ``last``, of them and an int), for tasks to deal by what Spark deals by."""
    one, two, three, four, five = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(h, n):
        return (h << np.uint64(n)) | (h >> np.uint64(64 - n))

    def mixed(h):
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = np.full(len(x), seed, "uint64") + five + np.uint64(8)
        h = mixed(turned(h ^ (turned(x.astype("int64").view("uint64") * two, 31) * one), 27) * one + four)
        if last is not None:
            h = mixed(turned((h + five + np.uint64(4)) ^ (np.uint64(last) * one), 23) * two + three)
    return h.view("int64")


def _block(x: np.ndarray, blocks: int) -> np.ndarray:
    return _hashed(x) % blocks


#: What blocks tell each other: to a block, from a block (from -1: its own nodes), arrays.
TOLD = "i long, peer long, a binary, b binary, c binary, d binary, e binary"
STATE = "i long, x binary, k binary, loop binary, c binary, inside binary, held binary, to binary, gain binary, inner long, outer double, movers long"


def _table(names: str, rows: Iterable[Sequence]) -> pa.Table:
    """Rows of numbers and arrays by a DDL text; arrays go as bytes."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [(n, kinds[t]) for n, t in (f.split() for f in names.split(", "))]
    rows = list(rows)
    columns = [[v.tobytes() if isinstance(v, np.ndarray) else v for v in column] for column in zip(*rows, strict=True)] if rows else [[] for _ in fields]
    return pa.table([pa.array(v, t) for v, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _longs(value: bytes, kind: str = "int64") -> np.ndarray:
    return np.frombuffer(value, kind)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _parted(by: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each value of ``by`` and the places where it stands, in their order."""
    order = np.argsort(by, kind="stable")
    return [(int(by[p[0]]), p) for p in np.split(order, _runs(by[order])[1:])] if len(by) else []


class Blocks(NamedTuple):
    """The arcs of a level, dealt by their node x to ``parts`` blocks and kept there for all rounds: ``reads`` has of a block its nodes and arcs, an arc
    by the places of x and of what its y tells; ``sends`` has which nodes are told to which block."""

    reads: DataFrame
    sends: DataFrame
    parts: int

    def drop(self) -> None:
        self.reads.unpersist()
        self.sends.unpersist()


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.withColumn("i", F.pmod(F.xxhash64("x"), F.lit(parts).cast("long"))).repartition(parts, "i")


def laid(arcs: DataFrame, state: DataFrame, number: int) -> Blocks:
    """arcs(x, y, w) both ways without loops, ``number`` of them, state(x, k, loop, c) of all nodes -> blocks, as many as go by the number of arcs."""
    parts = number // ARCS_A_BLOCK + 1
    names = "i long, x binary, at binary, place binary, w binary, more binary, peers binary, sends binary, ends binary"

    def lay(key, arcs, nodes):
        ids = np.sort(nodes["x"].to_numpy())
        x, y, w = (arcs[n].to_numpy() for n in ("x", "y", "w"))
        order = np.argsort(x, kind="stable")
        x, y, w = x[order], y[order], w[order]
        at, peer = np.searchsorted(ids, x).astype("int32"), _block(y, parts)
        order = np.lexsort((y, peer))  # as told: by the other block, then by node
        new = np.zeros(len(y), "int32")
        new[_runs(peer[order], y[order])] = 1
        place = np.empty(len(y), "int32")
        place[order] = np.cumsum(new) - 1
        order = np.lexsort((at, peer))
        one = _runs(peer[order], at[order])
        sends, to = at[order][one], peer[order][one]
        ends = _runs(to)
        return _table(names, [(key[0].as_py(), ids, at, place, w, y > x, to[ends], sends, np.r_[ends[1:], len(to)])])

    whole = _dealt(arcs.select("x", "y", "w"), parts).groupBy("i").cogroup(_dealt(state.select("x"), parts).groupBy("i")).applyInArrow(lay, names)
    whole = cut(whole)
    return Blocks(whole.select("i", "x", "at", "place", "w", "more").repartition(parts, "i").persist(), whole.select("i", "peers", "sends", "ends").repartition(parts, "i").persist(), parts)


def _entered(blocks: Blocks, state: DataFrame) -> DataFrame:
    """state(x, k, loop, c) as rows of blocks."""

    def enter(key, nodes):
        x, k, loop, c = (nodes[n].to_numpy() for n in ("x", "k", "loop", "c"))
        o = np.argsort(x)
        still = np.zeros(len(x))
        return _table(STATE, [(key[0].as_py(), x[o], k[o], loop[o], c[o], still.astype("int64"), still.astype("int64"), c[o], still, 0, 0.0, 0)])

    return _dealt(state.select("x", "k", "loop", "c"), blocks.parts).groupBy("i").applyInArrow(enter, STATE)


def _nodes(state: DataFrame) -> DataFrame:
    """Rows of blocks -> x, k, loop, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.select(["x", "k", "loop", "c"]).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_longs(v)) for v in r.values()], names=list(r))

    return state.mapInArrow(run, "x long, k long, loop long, c long")


def _told(blocks: Blocks, state: DataFrame, turn: int, part: int) -> DataFrame:
    """What each block is told once the nodes whose turn it is have moved: communities and their strengths, of its own nodes (from -1) and of those that its arcs come
    from.  A strength below 0 is of a community of one.  Strengths are summed where a community's hash lies, and go back to the blocks that have it."""
    parts = blocks.parts

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, k, c, to, gain = _longs(r["x"]), _longs(r["k"]), _longs(r["c"]), _longs(r["to"]), _longs(r["gain"], "float64")
                c = np.where((gain > 1e-9) & (_hashed(x, last=turn) % part == 0), to, c)
                o = np.argsort(c, kind="stable")
                one = _runs(c[o])
                held, n, of = np.add.reduceat(k[o], one), np.diff(np.r_[one, len(o)]), c[o][one]
                own = [(r["i"], -1, r["x"], r["k"], r["loop"], c, None)]
                yield from _table(TOLD, own + [(j, r["i"], of[p], held[p], n[p], None, None) for j, p in _parted(_block(of, parts))]).to_batches()

    def add(key, rows):
        rows = rows.to_pylist()
        own, said = [r for r in rows if r["peer"] < 0], [r for r in rows if r["peer"] >= 0]
        out = [tuple(r.values()) for r in own]
        if said:
            of, k, n = (np.concatenate([_longs(r[v]) for r in said]) for v in "abc")
            o = np.argsort(of, kind="stable")
            one = _runs(of[o])
            ids, held, n = of[o][one], np.add.reduceat(k[o], one), np.add.reduceat(n[o], one)
            held = np.where(n == 1, -held, held)
            out += [(r["peer"], key[0].as_py(), r["a"], held[np.searchsorted(ids, _longs(r["a"]))], None, None, None) for r in said]
        return _table(TOLD, out)

    def send(key, lists, rows):
        rows, lists = rows.to_pylist(), lists.to_pylist()[0]
        own = next(r for r in rows if r["peer"] < 0)
        of, held = (np.concatenate([_longs(r[v]) for r in rows if r["peer"] >= 0]) for v in "ab")
        o, c, me = np.argsort(of), _longs(own["d"]), key[0].as_py()
        held = held[o][np.searchsorted(of[o], c)]
        sends, peers, ends = _longs(lists["sends"], "int32"), _longs(lists["peers"]), _longs(lists["ends"])
        each = np.split(sends, ends[:-1]) if len(peers) else []
        return _table(TOLD, [(me, -1, own["a"], own["b"], own["c"], c, held), *((int(j), me, c[s], held[s], None, None, None) for j, s in zip(peers, each, strict=True))])

    summed = state.mapInArrow(move, TOLD).repartition(parts, "i").groupBy("i").applyInArrow(add, TOLD)
    return blocks.sends.groupBy("i").cogroup(summed.repartition(parts, "i").groupBy("i")).applyInArrow(send, TOLD)


def _arcs_told(arcs: pa.Table, rows: pa.Table) -> tuple:
    """A block's nodes (x, k, loop, c, held) and of its arcs, by node and community: at, to, w summed, b (strength of the community; below 0 for one that the
    node, if alone, doesn't move to)."""
    arcs, rows = arcs.to_pylist()[0], sorted(rows.to_pylist(), key=lambda r: r["peer"])
    own = tuple(_longs(rows[0][v]) for v in "abcde")
    at, place, w, more = _longs(arcs["at"], "int32"), _longs(arcs["place"], "int32"), _longs(arcs["w"]), _longs(arcs["more"], "bool")
    if not len(at):
        return own, (at, at, at, at)
    to, b = (np.concatenate([_longs(r[v]) for r in rows[1:]])[place] for v in "ab")
    b = np.where(more, b, np.abs(b))
    order = np.lexsort((to, at))
    at, to, w, b = at[order], to[order], w[order], b[order]
    one = _runs(at, to)
    return own, (at[one], to[one], np.add.reduceat(w, one), b[one])


def _stands(blocks: Blocks, state: DataFrame, whole: int, resolution: float, turn: int, part: int) -> DataFrame:
    """Rows of blocks after the moves of a turn: of nodes x, k, loop, c, inside (weight into its own community), held (its strength), to
    (the best other one), gain; and what modularity is summed from.  Of two nodes that are alone in their communities only the greater moves to the other."""

    def choose(key, arcs, rows):
        (x, k, loop, c, held), (at, to, w, b) = _arcs_told(arcs, rows)
        alone, held = held < 0, np.abs(held)
        mine = to == c[at]
        inside, goes, gain = np.zeros(len(x), "int64"), c.copy(), np.zeros(len(x))
        inside[at[mine]] = w[mine]
        may = ~mine & (~alone[at] | (b > 0))
        at, to, s = at[may], to[may], w[may] - resolution * k[at[may]] * np.abs(b[may]) / float(whole)
        if len(at):
            one = _runs(at)
            best = np.maximum.reduceat(s, one)
            hit = np.flatnonzero(s == np.repeat(best, np.diff(np.r_[one, len(at)])))
            hit = hit[_runs(at[hit])]  # of equal ones the least community
            goes[at[hit]] = to[hit]
            gain[at[hit]] = best - (inside - resolution * k * (held - k) / float(whole))[at[hit]]
        return _table(STATE, [(key[0].as_py(), x, k, loop, c, inside, held, goes, gain, int((inside + loop).sum()), float((k * (held / float(whole) ** 2)).sum()), int((gain > 1e-9).sum()))])

    return blocks.reads.groupBy("i").cogroup(_told(blocks, state, turn, part).repartition(blocks.parts, "i").groupBy("i")).applyInArrow(choose, STATE)


def local_moves(blocks: Blocks, state: DataFrame, whole: int, resolution: float, tolerance: float) -> tuple[DataFrame, float]:
    """A level's blocks, state(x, k, loop, c) -> rows of blocks after moves, and their modularity."""
    state, kept, before, part, turn, calm = _entered(blocks, state), None, None, 2, 0, 0
    while True:
        now = cut(_stands(blocks, state, whole, resolution, turn, part))
        inner, outer, movers = now.agg(F.sum("inner"), F.sum("outer"), F.sum("movers")).first()
        q, movers = (inner or 0) / float(whole) - resolution * (outer or 0.0), movers or 0
        if before is not None and q < before - 1e-12:
            part *= 4  # the round before lost: once more with fewer, from where it began
            if part > 512:
                return kept, before
        else:
            calm = calm + 1 if before is not None and q - before < tolerance else 0
            kept, before = now, q
            if not movers or calm > 1:
                return kept, q
            part = max(2, part // 2)
        turn += 1
        state = kept


def contracted(blocks: Blocks, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of communities of rows of blocks: its arcs and its state, each node alone.  A block's arcs are summed by communities before they are dealt."""

    def ends(key, arcs, rows):
        (_, _, _, c, _), (at, to, w, _) = _arcs_told(arcs, rows)
        mine = c[at]
        order = np.lexsort((to, mine))
        mine, to, w = mine[order], to[order], w[order]
        one = _runs(mine, to)
        return pa.table({"cx": mine[one].astype("int64"), "cy": to[one].astype("int64"), "w": np.add.reduceat(w, one).astype("int64") if len(one) else w.astype("int64")})

    still = _told(blocks, state.withColumn("to", F.col("c")), 0, 1)
    found = blocks.reads.groupBy("i").cogroup(still.repartition(blocks.parts, "i").groupBy("i")).applyInArrow(ends, "cx long, cy long, w long")
    found = cut(found.groupBy("cx", "cy").agg(F.sum("w").alias("w")))
    loops = found.where("cx = cy").select(F.col("cx").alias("c"), F.col("w").alias("more"))
    nodes = _nodes(state).groupBy("c").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop")).join(loops, "c", "left").na.fill(0, ["more"])
    nodes = cut(nodes.select(F.col("c").alias("x"), "k", (F.col("loop") + F.col("more")).alias("loop"), "c"))
    return found.where("cx <> cy").select(F.col("cx").alias("x"), F.col("cy").alias("y"), "w"), nodes


def communities(pairs: DataFrame, vertices: DataFrame | None = None, resolution: float = 1.0, tolerance: float = 1e-3) -> DataFrame:
    """pairs(src, dst), undirected, repeated ones and loops count once and not at all -> (id, community), community is its least
    member.  ``vertices``(id) without a pair are alone; without any pair all of them are one community.  Levels and rounds end when
    modularity gains less than ``tolerance``."""
    kind = pairs.schema["src"].dataType
    u = pairs.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    u, names = cut(u), None
    if not isinstance(kind, T.IntegralType):
        names = cut(u.select(F.col("a").alias("id")).union(u.select("b")).distinct().withColumn("num", F.monotonically_increasing_id()))
        u = u.join(names.withColumnRenamed("id", "a").withColumnRenamed("num", "na"), "a").join(names.withColumnRenamed("id", "b").withColumnRenamed("num", "nb"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
        u = cut(u)
    one = F.lit(1).cast("long").alias("w")
    x, y = F.col("a").cast("long"), F.col("b").cast("long")
    arcs = u.select(x.alias("x"), y.alias("y"), one).unionAll(u.select(y.alias("x"), x.alias("y"), one))
    base = cut(arcs.groupBy(F.col("y").alias("x")).agg(F.sum("w").alias("k")).select("x", "k", F.lit(0).cast("long").alias("loop"), F.col("x").alias("c")))
    whole = base.agg(F.sum("k")).first()[0] or 0
    if not whole:
        if vertices is None:
            return pairs.select(F.col("src").alias("id"), F.col("src").alias("community")).where("false")
        least = vertices.agg(F.min("id").alias("community"))
        return vertices.select("id").distinct().join(least)  # one row
    blocks = laid(arcs, base, whole)
    state, best = base, None
    while True:
        moved, q = local_moves(blocks, state, whole, resolution, tolerance)
        state = cut(_nodes(moved))
        if best is not None and q - best < tolerance:
            break
        level_blocks, level, found = blocks, moved, state.select("x", "c")
        while True:
            ends, nodes = contracted(level_blocks, level)
            if level_blocks is not blocks:
                level_blocks.drop()
            level_blocks = laid(ends, nodes, ends.count())
            level, higher = local_moves(level_blocks, nodes, whole, resolution, tolerance)
            if higher - q < tolerance:
                break
            q, found = higher, cut(found.join(_nodes(level).select(F.col("x").alias("c"), F.col("c").alias("up")), "c").select("x", F.col("up").alias("c")))
        level_blocks.drop()
        best, state = q, cut(state.drop("c").join(found, "x"))
    blocks.drop()
    member = state.select(F.col("x").cast(kind).alias("id"), "c") if names is None else state.join(names, F.col("x") == F.col("num")).select("id", "c")
    least = member.groupBy("c").agg(F.min("id").alias("community"))
    out = member.join(least, "c").select("id", "community")
    if vertices is not None:
        out = out.unionByName(vertices.select("id").distinct().join(out.select("id"), "id", "left_anti").select("id", F.col("id").alias("community")))
    return out
