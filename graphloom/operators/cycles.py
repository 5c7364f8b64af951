"""Strongly connected components in rounds that double their reach.

Every node takes the least label that reaches it and the least that it reaches, under labels that are dealt anew each turn.  Where
both are one label, that node's component is found; nodes of one component always agree in both, so arcs between nodes that
don't are cut, and the rest takes another turn: a turn splits what is left by a constant factor, whatever its shape.  In each
round of a turn labels go one arc on, and also along a shortcut that every node carries: first one of its neighbours,
then its shortcut's shortcut.  On a way of n nodes the reach doubles, so a ring or a chain takes log n rounds.

Rounds go over few arcs.  Where nodes have many, each keeps two that leave it and two that reach it; nodes of one component of these
are of one component of all, so it becomes one node, and only arcs between what is left count on (the rest of them is found the
same way).  Before each turn, arcs from nodes that nothing reaches and to nodes that lead nowhere are dropped, over and over while a
tenth of the arcs goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cut import Levels, cut

#: Arcs a node from which some of them are tried first, and the share of the arcs that one more trimming must drop.
DENSE, WORTH = 10, 0.1


def numbered(edges: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Edges as distinct (a, b) of longs, loops left out, and the table (id, num) that names them; none is needed for whole numbers."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    if isinstance(e.schema["src"].dataType, T.IntegralType):
        return None, e.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b"))
    ids = cut(e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("num", F.monotonically_increasing_id()))
    a, b = ids.select(F.col("id").alias("src"), F.col("num").alias("a")), ids.select(F.col("id").alias("dst"), F.col("num").alias("b"))
    return ids, e.join(a, "src").join(b, "dst").select("a", "b")


def dealt(x: Column, turn: int) -> Column:
    """A permutation of the longs, another one for each turn.  Its expression is large: evaluate it once."""
    for k in range(2):
        x = x.bitwiseXOR(F.lit((0x1E3779B97F4A7C15 * (2 * turn + k + 1)) % (1 << 62)))
        x = x.bitwiseXOR(F.shiftleft(x, 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        x = x.bitwiseXOR(F.shiftleft(x, 17))
    return x


def _ends(arcs: DataFrame, rounds: list[int]) -> DataFrame:
    """arcs(a, b, na, nb) -> num, low (least label that leads to the node), far (least that it leads to)."""
    null = F.lit(None).cast("long")
    met = arcs.select(F.col("b").alias("v"), F.col("nb").alias("num"), F.col("a").alias("i"), null.alias("o"))
    met = met.unionByName(arcs.select(F.col("a").alias("v"), F.col("na").alias("num"), null.alias("i"), F.col("b").alias("o")))
    s = met.groupBy("v").agg(F.max("num").alias("num"), F.min("i").alias("i"), F.min("o").alias("o"))
    s = s.select("v", "num", F.least("v", "i").alias("low"), F.least("v", "o").alias("far"), F.coalesce("i", "v").alias("back"), F.coalesce("o", "v").alias("on"), F.lit(True).alias("sends_low"), F.lit(True).alias("sends_far"))
    s = cut(s)
    # who asks whom: 0, 1 along the arcs, 2, 3 along the shortcuts; the arcs stay where they are, by whom they ask
    ways = arcs.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(0).alias("kind")).unionAll(arcs.select(F.col("b").alias("u"), F.col("a").alias("v"), F.lit(1).alias("kind")))
    ways = ways.repartition(int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "u").persist()
    kind = F.col("kind")
    while True:
        rounds.append(1)
        shortcuts = s.select(F.col("back").alias("u"), "v", F.lit(2).alias("kind")).unionAll(s.select("on", "v", F.lit(3)))
        x = s.select(F.col("v").alias("u"), F.col("low").alias("l"), F.col("far").alias("f"), F.col("back").alias("p"), F.col("on").alias("q"), "sends_low", "sends_far")
        along = ways.join(x.where("sends_low OR sends_far"), "u").where(((kind == 0) & F.col("sends_low")) | ((kind == 1) & F.col("sends_far")))
        heard = along.unionByName(shortcuts.join(x, "u"))
        heard = heard.select("v", null.alias("num"), F.when(kind.isin(0, 2), F.col("l")).alias("low"), F.when(kind.isin(1, 3), F.col("f")).alias("far"), F.when(kind == 2, F.col("p")).alias("back"), F.when(kind == 3, F.col("q")).alias("on"), null.alias("w"), null.alias("g"))
        own = s.select("v", "num", "low", "far", null.alias("back"), null.alias("on"), F.col("low").alias("w"), F.col("far").alias("g"))
        new = own.unionAll(heard).groupBy("v").agg(F.max("num").alias("num"), F.min("low").alias("low"), F.min("far").alias("far"), *[F.max(c).alias(c) for c in ("back", "on", "w", "g")])
        s = cut(new.select("v", "num", "low", "far", "back", "on", (F.col("low") < F.col("w")).alias("sends_low"), (F.col("far") < F.col("g")).alias("sends_far")))
        if s.where("sends_low OR sends_far").isEmpty():
            ways.unpersist()
            return s.select("num", "low", "far")


def _trimmed(arcs: DataFrame) -> tuple[DataFrame, int]:
    """Arcs (a, b) that may lie on a cycle, and their number."""
    n = arcs.count()
    while n:
        ways = arcs.select(F.col("a").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(arcs.select(F.col("b").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        through = ways.groupBy("v").agg(F.max("o").alias("o"), F.max("i").alias("i")).where("o = 1 AND i = 1").select("v")
        through = cut(through)
        arcs = cut(arcs.join(through.withColumnRenamed("v", "a"), "a", "left_semi").join(through.withColumnRenamed("v", "b"), "b", "left_semi").select("a", "b"))
        was, n = n, arcs.count()
        if was - n < WORTH * was:
            break
    return arcs, n


def _some(arcs: DataFrame) -> DataFrame:
    """Two arcs that leave each node and two that reach it (or one, where both draws are the same)."""
    draws = [F.xxhash64("a", "b", F.lit(k)) for k in range(2)]
    out = arcs.groupBy("a").agg(*[F.min_by("b", h).alias(f"x{k}") for k, h in enumerate(draws)]).select("a", F.explode(F.array("x0", "x1")).alias("b"))
    into = arcs.groupBy("b").agg(*[F.min_by("a", h).alias(f"x{k}") for k, h in enumerate(draws)]).select(F.explode(F.array("x0", "x1")).alias("a"), "b")
    return out.unionAll(into).distinct()


def _by_turns(arcs: DataFrame, rounds: list[int]) -> DataFrame | None:
    """arcs (a, b), distinct -> (num, root) of the nodes of components of more than one node, or None; root is the least node."""
    found, turn = None, 0
    while True:
        arcs, n = _trimmed(arcs)
        if not n:
            break
        arcs = cut(arcs.select(dealt(F.col("a"), turn).alias("a"), dealt(F.col("b"), turn).alias("b"), F.col("a").alias("na"), F.col("b").alias("nb")))
        ends = _ends(arcs, rounds)
        done = ends.where("low = far").select("num", F.lit(turn).alias("turn"), F.col("low").alias("root"))
        if found is None:
            found = Levels(done)
        else:
            found.add(done)
        open_ = ends.where("low <> far")
        a = open_.select(F.col("num").alias("na"), F.col("low").alias("la"), F.col("far").alias("fa"))
        b = open_.select(F.col("num").alias("nb"), F.col("low").alias("lb"), F.col("far").alias("fb"))
        arcs = cut(arcs.drop("a", "b").join(a, "na").join(b, "nb").where("la = lb AND fa = fb").select(F.col("na").alias("a"), F.col("nb").alias("b")))
        turn += 1
    if found is None:
        return None
    roots = found.all().groupBy("turn", "root").agg(F.min("num").alias("least"), F.count("*").alias("n")).where("n > 1")
    return cut(found.all().join(roots, ["turn", "root"]).select("num", F.col("least").alias("root")))


def _components(arcs: DataFrame, rounds: list[int]) -> DataFrame | None:
    """The same; arcs that aren't needed to connect a component take no part in its rounds."""
    n, a, b = arcs.agg(F.count("*"), F.approx_count_distinct("a"), F.approx_count_distinct("b")).first()
    if n < DENSE * max(a, b):
        return _by_turns(arcs, rounds)
    inner = _by_turns(cut(_some(arcs)), rounds)
    if inner is None:  # no cycle among the arcs drawn
        return _by_turns(arcs, rounds)
    to = lambda c: inner.select(F.col("num").alias(c), F.col("root").alias(f"r{c}"))
    rest = arcs.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    outer = _by_turns(cut(rest.where("a <> b").distinct()), rounds)
    if outer is None:
        return inner
    up = outer.select(F.col("num").alias("root"), F.col("root").alias("up"))
    return inner.join(up, "root", "left").select("num", F.coalesce("up", "root").alias("root")).unionByName(outer.join(inner.select("num"), "num", "left_anti"))


def strong_components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """edges(src, dst) -> (node, component) for nodes of strongly connected components of more than one node; component is the
    least node.  Loops and repeated edges count for nothing.  ``rounds`` gets an entry for each round."""
    rounds = [] if rounds is None else rounds
    ids, e = numbered(edges)
    kind = edges.schema["src"].dataType
    found = _components(cut(e), rounds)
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).where("false")
    if ids is None:
        return found.select(F.col("num").cast(kind).alias("node"), F.col("root").cast(kind).alias("component"))
    named = found.join(ids, "num").select(F.col("id").alias("node"), "root")
    return named.join(named.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component")
