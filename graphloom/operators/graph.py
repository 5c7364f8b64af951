"""Property graph as two DataFrames, and traversal over it.

nodes(id, label, name, file_path, language, is_exported, ...), edges(src, dst, type, confidence, edge_seq).
Traversals are frontier loops: each level is one equi-join of the frontier with the edges and one anti-join
with what was visited, written before the next, so lineage stays short and a level survives lost executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cut import Levels, cut
from ..functions.text import entry_score
from .cycles import strong_components
from .prefix import prefix_sums


def dedup(df: DataFrame, keys: Sequence[str], seq: str, keep: str = "first") -> DataFrame:
    """First or last write of each key by ``seq``."""
    order = F.col(seq).asc() if keep == "first" else F.col(seq).desc()
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")


def dedup_edges(edges: DataFrame, edge_key: str = "pair") -> DataFrame:
    """First edge of each (src, dst), or of each (src, dst, type) with ``pair_type``."""
    return dedup(edges, ["src", "dst"] if edge_key == "pair" else ["src", "dst", "type"], "edge_seq")


def select_edges(edges: DataFrame, types: Sequence[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    if types:
        edges = edges.where(F.col("type").isin(list(types)))
    return edges if min_confidence is None else edges.where(F.col("confidence") >= min_confidence)


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "out", loops_once: bool = False) -> DataFrame:
    """(node, other, type, confidence, direction) for edges whose other end exists; both directions are concatenated, so a
    self-loop shows twice unless ``loops_once``."""
    ids = nodes.select(F.col("id").alias("other"))
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type", "confidence", F.lit("out").alias("direction"))
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "type", "confidence", F.lit("in").alias("direction"))
    if loops_once and direction == "both":
        back = back.where("node <> other")
    e = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return e.join(ids, "other", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """id, callers, callees."""
    both = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id").agg(F.sum("i").alias("callers"), F.sum("o").alias("callees"))


def fixpoint(seed: DataFrame, step, max_rounds: int | None = None, key: str = "id") -> DataFrame:
    """Semi-naive iteration: ``step(frontier)`` gives candidates with the columns of ``seed``; those with a new ``key`` are
    the next frontier.  Ends when there are none, or after ``max_rounds``."""
    seen = Levels(seed)
    done = 0
    while max_rounds is None or done < max_rounds:
        frontier = seen.add(step(seen.last).join(seen.all().select(key), key, "left_anti").select(*seed.columns))
        if frontier.isEmpty():
            break
        done += 1
    return seen.all()


def bfs(edges: DataFrame, starts: DataFrame, direction: str = "out", types: Sequence[str] | None = None, max_depth: int | None = 3, min_confidence: float | None = None) -> DataFrame:
    """starts(id) -> id, depth, via (the node it was first reached from), ord (place in the order of discovery inside its
    depth: the start, then the edges of the way).  The first discoverer is the one met first: by its own place, then by the
    edge's.  The place goes with the row, so no level is ever ranked as a whole."""
    e = select_edges(edges, types, min_confidence)
    arcs = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("edge_seq").cast("bigint").alias("seq"))
    back = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("edge_seq").cast("bigint").alias("seq"))
    arcs = cut({"out": arcs, "in": back, "both": arcs.unionByName(back)}[direction])
    place = F.struct(F.col("id").alias("s"), F.array().cast("array<bigint>").alias("e"))
    seed = starts.select("id", F.lit(0).alias("depth"), F.lit(None).cast(starts.schema["id"].dataType).alias("via"), place.alias("o"))

    def step(f: DataFrame) -> DataFrame:
        on = F.struct(F.col("o.s").alias("s"), F.concat("o.e", F.array("seq")).alias("e"))
        met = f.join(arcs, F.col("id") == F.col("a")).select(F.col("b").alias("id"), (F.col("depth") + 1).alias("depth"), F.col("id").alias("via"), on.alias("o"))
        return met.groupBy("id", "depth").agg(F.min(F.struct("o", "via")).alias("m")).select("id", "depth", F.col("m.via").alias("via"), F.col("m.o").alias("o"))

    return fixpoint(seed, step, max_depth).select("id", "depth", "via", F.col("o").alias("ord"))


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """id of all nodes that the starts lead to, themselves included."""
    arcs = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct())
    return fixpoint(starts.select("id").distinct(), lambda f: f.join(arcs, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct())


def impact_risk(direct: Column, processes: Column, modules: Column, total: Column) -> Column:
    return (
        F.when((direct >= 30) | (processes >= 5) | (modules >= 5) | (total >= 200), "CRITICAL")
        .when((direct >= 15) | (processes >= 3) | (modules >= 3) | (total >= 100), "HIGH")
        .when((direct >= 5) | (total >= 30), "MEDIUM")
        .otherwise("LOW")
    )


def impact(reached: DataFrame, membership: DataFrame, steps: DataFrame, top: int = 20) -> DataFrame:
    """reached(id, depth), membership(id, community), steps(process_id, node_id, step): one row with counts and risk; processes
    and modules are counted after their top-``top`` cut, and the start itself doesn't count."""
    hit = reached.where("depth > 0")
    base = hit.agg(F.count("*").alias("total"), F.sum(F.when(F.col("depth") == 1, 1).otherwise(0)).alias("direct"))
    p = process_hits(hit, steps, top).agg(F.count("*").alias("processes"))
    m = module_hits(hit, membership, top).agg(F.count("*").alias("modules"))
    one = base.join(p).join(m)
    return one.withColumn("direct", F.coalesce("direct", F.lit(0))).withColumn("risk", impact_risk(F.col("direct"), F.col("processes"), F.col("modules"), F.col("total")))


def process_hits(hit: DataFrame, steps: DataFrame, top: int = 20) -> DataFrame:
    j = steps.join(hit.select(F.col("id").alias("node_id")), "node_id")
    return j.groupBy("process_id").agg(F.count("*").alias("hits"), F.min("step").alias("broken_at_step")).orderBy(F.desc("hits"), "process_id").limit(top)


def module_hits(hit: DataFrame, membership: DataFrame, top: int = 20) -> DataFrame:
    return hit.join(membership, "id").groupBy("community").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "community").limit(top)


# ---------------------------------------------------------------- dead code

#: Fixed values.
DYNAMIC_NAME = r"(?i)(Plugin|Handler|Adapter|Middleware|Factory|Provider|Registry|Hook|Listener|Callback|Decorator|Extension|Interceptor)$"
DYNAMIC_LANGUAGES = ("python", "javascript", "typescript", "ruby", "php")
ENTRY_LABELS = ("Function", "Method", "Class", "Constructor")


def entry_points(nodes: DataFrame, edges: DataFrame, is_test: Column, least: float = 1.5) -> DataFrame:
    """Symbols outside tests whose callees per caller, doubled when exported, reach ``least``: id, score."""
    d = nodes.where(F.col("label").isin(list(ENTRY_LABELS)) & ~is_test).join(degrees(edges), "id", "left").na.fill(0, ["callers", "callees"])
    score = F.col("callees") / (F.col("callers") + 1) * F.when(F.col("is_exported"), 2.0).otherwise(1.0)
    return d.select("id", F.round(score, 6).alias("score")).where(F.col("score") >= least)


#: Fixed values.
MIN_TRACE_CONFIDENCE = 0.5
MAX_PROCESSES = 75


def trusted_calls(edges: DataFrame, least: float = MIN_TRACE_CONFIDENCE) -> DataFrame:
    """The calls that tracing counts and follows."""
    return edges.where((F.col("type") == "CALLS") & (F.col("confidence") >= least))


def trace_entries(nodes: DataFrame, edges: DataFrame, is_test: Column, top: int = 200, multiplier: Column | None = None) -> DataFrame:
    """id, score of the ``top`` functions and methods outside tests that call something, by falling entry score, then id.  Calls under
    the trusted confidence count for nothing; a ``multiplier`` over 1 (a framework's, by a symbol's definition) raises the score."""
    d = nodes.where(F.col("label").isin("Function", "Method") & ~is_test).join(degrees(trusted_calls(edges)), "id").na.fill(0, ["callers", "callees"]).where("callees > 0")
    score = entry_score(F.col("name"), F.col("is_exported"), F.col("callers"), F.col("callees"), F.col("file_path"))
    if multiplier is not None:
        score = F.round(score * F.when(multiplier > 1, multiplier).otherwise(1.0), 6)
    return d.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(top)


def dead_code(nodes: DataFrame, edges: DataFrame, is_test: Column, min_confidence: float = 0.5, include_low: bool = False) -> DataFrame:
    """Unreachable symbols with confidence and reason; reachable ones may be of any label."""
    live = reach(edges, entry_points(nodes, edges, is_test).select("id"))
    name = F.col("name")
    dunder = name.startswith("__") & name.endswith("__")
    low = name.rlike(DYNAMIC_NAME)
    loose = F.lower("language").isin(list(DYNAMIC_LANGUAGES))
    conf = F.when(low, 0.3).when(loose, 0.6).when(F.col("is_exported"), 0.6).otherwise(0.9)
    why = F.when(low, "dynamic-pattern-name").when(loose, "dynamic-language").when(F.col("is_exported"), "exported-but-unreachable").otherwise("static-unreachable")
    dead = nodes.where(F.col("label").isin(list(ENTRY_LABELS)) & ~is_test & ~dunder).join(live, "id", "left_anti").select("id", "name", conf.alias("confidence"), why.alias("reason"))
    return dead if include_low else dead.where(F.col("confidence") >= min_confidence)


# ---------------------------------------------------------------- cycles and claim graphs


def claim_node_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id, node_type), edges(src, dst, type): 1 less 0.3 in a cycle, 0.25 in a contradiction, 0.1 as an orphan that is
    no requirement, plus 0.1 for a requirement; clipped; passes at 0.6."""
    cyc = strong_components(edges).select(F.col("node").alias("id")).withColumn("cycle", F.lit(1))
    c = edges.where("type = 'contradicts'")
    con = c.select(F.col("src").alias("id")).union(c.select("dst")).distinct().withColumn("conflict", F.lit(1))
    into = edges.select(F.col("dst").alias("id")).distinct().withColumn("into", F.lit(1))
    n = nodes.join(cyc, "id", "left").join(con, "id", "left").join(into, "id", "left").na.fill(0, ["cycle", "conflict", "into"])
    req = F.col("node_type") == "requirement"
    orphan = F.when((F.col("into") == 0) & ~req, 1).otherwise(0)
    raw = 1 - 0.3 * F.col("cycle") - 0.25 * F.col("conflict") - 0.1 * orphan + F.when(req, 0.1).otherwise(0.0)
    s = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)
    return n.select("id", "cycle", "conflict", orphan.alias("orphan"), s.alias("score"), (s >= 0.6).alias("passed"))


# ---------------------------------------------------------------- propagation, hierarchy, context


def propagation(edges: DataFrame, source, max_depth: int = 5) -> DataFrame:
    """target, depth, kind, path of the first way to each node that ``source`` reaches."""
    arcs = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_seq"))
    kind = edges.schema["src"].dataType
    seed = edges.sparkSession.range(1).select(F.lit(source).cast(kind).alias("id"), F.lit(0).alias("depth"), F.array().cast(f"array<{kind.simpleString()}>").alias("path"), F.array().cast("array<bigint>").alias("o"))

    def step(f: DataFrame) -> DataFrame:
        met = f.join(arcs, F.col("id") == F.col("a")).select(F.col("b").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("b")).alias("path"), F.concat("o", F.array(F.col("edge_seq").cast("bigint"))).alias("o"))
        return met.groupBy("id", "depth").agg(F.min(F.struct("o", "path")).alias("m")).select("id", "depth", F.col("m.path").alias("path"), F.col("m.o").alias("o"))

    out = fixpoint(seed, step, max_depth).where("depth > 0")
    return out.select(F.col("id").alias("target"), "depth", F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("kind"), "path")


def propagation_impact(paths: DataFrame) -> DataFrame:
    """Sum of path length over depth, against the harmonic number of the number of paths, at most 1."""
    g = paths.agg(F.count("*").alias("paths"), F.max("depth").alias("max_depth"), F.sum(F.size("path") / F.col("depth")).alias("s"))
    h = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("paths").cast("int"), F.lit(1))), F.lit(0.0), lambda a, k: a + 1.0 / k)
    value = F.when(F.col("paths") == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.col("s") / F.greatest(h, F.lit(1.0))), 6))
    return g.select("paths", F.coalesce("max_depth", F.lit(0)).alias("max_depth"), value.alias("impact"))


def folder_tree(paths: DataFrame, column: str = "path") -> DataFrame:
    """All prefixes of the paths as Folder and File nodes: id, label, name, parent."""
    parts = F.split(column, "/")
    pre = paths.select(parts.alias("p")).select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    return pre.select(
        F.array_join(F.slice("p", 1, F.col("k")), "/").alias("id"), F.when(F.col("k") == F.size("p"), "File").otherwise("Folder").alias("label"),
        F.element_at("p", F.col("k")).alias("name"), F.when(F.col("k") > 1, F.array_join(F.slice("p", 1, F.col("k") - 1), "/")).alias("parent"),
    ).distinct()


def context(nodes: DataFrame, edges: DataFrame, steps: DataFrame, ids: DataFrame) -> DataFrame:
    """References of symbols: id, direction, type, refs (ordered other ends), and the processes they stand in."""
    n = neighbours(edges, nodes, "both").join(ids.select(F.col("id").alias("node")), "node", "left_semi")
    refs = n.groupBy(F.col("node").alias("id"), "direction", "type").agg(F.sort_array(F.collect_list("other")).alias("refs"))
    p = steps.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_semi").groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("processes"))
    return refs.join(p, "id", "left").na.fill(0, ["processes"])


# ---------------------------------------------------------------- processes


def trace_processes(edges: DataFrame, entries: DataFrame, branching: int = 4, max_depth: int = 10, min_steps: int = 3, per_entry: int = 12, most: int = MAX_PROCESSES) -> DataFrame:
    """Paths of trusted calls from entries(id, score): entry, rank (inside it), path.  Entries come by falling score, then id, and none starts once
    those before it gave twice ``most`` paths.  They are traced in batches, the first as large as it must be."""
    arcs = _arcs(trusted_calls(edges), branching)
    order = cut(prefix_sums(entries.select(F.col("id").alias("entry"), "score"), {"place": "1L"}, [F.desc("score"), F.col("entry")]))
    first, size, done = 0, -(-2 * most // per_entry), None
    while True:
        batch = order.where((F.col("place") > first) & (F.col("place") <= first + size)).select("entry")
        if batch.isEmpty():
            break
        found = cut(_traces(arcs, batch, max_depth, min_steps, per_entry))
        done = found if done is None else done.unionByName(found)
        if done.count() >= 2 * most:
            break
        first, size = first + size, 2 * size
    if done is None:
        return _traces(arcs, order.select("entry"), max_depth, min_steps, per_entry)
    gave = prefix_sums(done.groupBy("entry").agg(F.count("*").alias("n")).join(order, "entry"), {"upto": "n"}, ["place"])
    return done.join(gave.where(F.col("upto") - F.col("n") < 2 * most).select("entry"), "entry", "left_semi")


def _arcs(edges: DataFrame, branching: int) -> DataFrame:
    """a, bs: the first ``branching`` callees of a node by edge_seq, cut before any test for cycles."""
    w = Window.partitionBy("src").orderBy("edge_seq", "dst")
    arcs = edges.withColumn("k", F.row_number().over(w)).where(F.col("k") <= branching)
    return cut(arcs.groupBy(F.col("src").alias("a")).agg(F.sort_array(F.collect_list(F.struct("k", F.col("dst").alias("b")))).alias("bs")))


def _traces(arcs: DataFrame, entries: DataFrame, max_depth: int, min_steps: int, per_entry: int) -> DataFrame:
    """Simple paths end where nothing is left or at ``max_depth`` nodes; the first ``per_entry`` of an entry in queue order stay.  No live path is
    dropped before its entry has that many ended ones: a later path may end sooner than an earlier one."""
    front = entries.select("entry", F.array("entry").alias("path"), F.array().cast("array<int>").alias("o"))
    first = F.row_number().over(Window.partitionBy("entry").orderBy("o"))
    done = None
    for depth in range(1, max_depth + 1):
        grown = front.join(arcs, F.element_at("path", -1) == F.col("a"), "left")
        grown = cut(grown.select("entry", "path", "o", F.filter("bs", lambda x: ~F.array_contains("path", x["b"])).alias("new")))
        live = F.coalesce(F.size("new"), F.lit(0)) > 0
        ended = grown.where(F.size("path") >= min_steps) if depth == max_depth else grown.where(~live & (F.size("path") >= min_steps))
        ended = ended.select("entry", "path", "o").withColumn("r", first).where(F.col("r") <= per_entry).drop("r")
        done = cut(ended if done is None else done.union(ended))
        if depth == max_depth:
            break
        full = done.groupBy("entry").count().where(F.col("count") >= per_entry)
        nxt = grown.where(live).join(full, "entry", "left_anti").select("entry", "path", "o", F.explode("new").alias("n"))
        front = nxt.select("entry", F.concat("path", F.array("n.b")).alias("path"), F.concat("o", F.array("n.k")).alias("o"))
        if depth == max_depth - 1:  # all of the next level end there
            front = front.withColumn("r", first).where(F.col("r") <= per_entry).drop("r")
        if front.isEmpty():
            break
    q = Window.partitionBy("entry").orderBy(F.size("path"), "o")
    return done.withColumn("rank", F.row_number().over(q)).where(F.col("rank") <= per_entry).select("entry", "rank", "path")


def trace_members(edges: DataFrame, entries: DataFrame, branching: int = 4, max_depth: int = 10) -> DataFrame:
    """entries(id) -> entry, id, depth: breadth-first members, each node taking at most ``branching`` callees that no node
    before it in the queue took.  Inside a level that is a matching: a callee asks the first node that hasn't
    refused it, and a node keeps its first ``branching`` by edge_seq, until none is refused."""
    arcs = cut(edges.where("src <> dst").groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.min("edge_seq").cast("bigint").alias("e")))
    seen = cut(entries.select(F.col("id").alias("entry"), "id", F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("o")))
    front = seen
    for depth in range(1, max_depth + 1):
        old = seen.select("entry", F.col("id").alias("b"))
        cand = cut(front.join(arcs, F.col("id") == F.col("a")).select("entry", F.col("o").alias("p"), "e", "b").join(old, ["entry", "b"], "left_anti"))
        if cand.isEmpty():
            break
        while True:
            ask = cand.groupBy("entry", "b").agg(F.min(F.struct("p", "e")).alias("m")).select("entry", "b", "m.p", "m.e")
            w = Window.partitionBy("entry", "p").orderBy("e", "b")
            ask = cut(ask.withColumn("k", F.row_number().over(w)))
            refused = ask.where(F.col("k") > branching).select("entry", "p", "b")
            if refused.isEmpty():
                break
            cand = cut(cand.join(refused, ["entry", "p", "b"], "left_anti"))
        front = cut(ask.select("entry", F.col("b").alias("id"), F.lit(depth).alias("depth"), F.concat("p", F.array("e")).alias("o")))
        seen = cut(seen.unionByName(front))
    return seen.select("entry", "id", "depth")


def drop_subsets(members: DataFrame, scores: DataFrame) -> DataFrame:
    """members(entry, id), scores(id, score): entries of at least two members whose set is in no set of a better entry (by falling
    score, then id).  Of equal sets only the best entry goes on; a set can only be inside one that holds its rarest member, so
    no pair meets on a member that most sets have."""
    g = members.groupBy("entry").agg(F.sort_array(F.collect_set("id")).alias("m")).where(F.size("m") >= 2)
    g = g.join(scores.select(F.col("id").alias("entry"), "score"), "entry")
    best = F.struct("score", (-F.col("place")).alias("p"))
    g = prefix_sums(g, {"place": "1L"}, [F.desc("score"), F.col("entry")])
    sets = cut(g.groupBy("m").agg(F.max_by(F.struct("entry", "score", "place"), best).alias("b")).select("m", "b.entry", "b.score", "b.place"))
    each = sets.select("place", F.explode("m").alias("id"))
    often = each.groupBy("id").agg(F.count("*").alias("n"))
    rare = each.join(often, "id").groupBy("place").agg(F.min_by("id", F.struct("n", "id")).alias("id"))
    pairs = rare.join(each.select("id", F.col("place").alias("better")), "id").where("better < place").select("place", "better")
    j = pairs.join(sets.select("place", "m"), "place").join(sets.select(F.col("place").alias("better"), F.col("m").alias("m2")), "better")
    gone = j.where((F.size("m") < F.size("m2")) & (F.size(F.array_except("m", "m2")) == 0)).select("place").distinct()
    return sets.join(gone, "place", "left_anti").select("entry", F.col("m").alias("members"), "score")


def drop_contained(traces: DataFrame) -> DataFrame:
    """Without traces whose joined key stands inside another's; of equal ones the least (entry, rank) stays."""
    t = traces.withColumns({"key": F.concat(F.lit(">"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">"), F.lit(">")), "len": F.size("path")})
    # a contained trace shares its first edge with the one around it
    first = t.withColumn("head", F.concat_ws(">", F.col("path")[0].cast("string"), F.col("path")[1].cast("string")))
    every = t.select(F.col("entry").alias("e2"), F.col("rank").alias("r2"), F.col("key").alias("k2"), F.col("len").alias("l2"), F.explode(F.transform(F.sequence(F.lit(1), F.col("len") - 1), lambda i: F.concat_ws(">", F.element_at("path", i).cast("string"), F.element_at("path", i + 1).cast("string")))).alias("head"))
    over = F.col("k2").contains(F.col("key")) & ((F.col("l2") > F.col("len")) | ((F.col("l2") == F.col("len")) & (F.struct("e2", "r2") < F.struct("entry", "rank"))))
    return first.join(every, (first["head"] == every["head"]) & over, "left_anti").select("entry", "rank", "path")


def longest_per_ends(traces: DataFrame, limit: int | None = None) -> DataFrame:
    w = Window.partitionBy("first", "last").orderBy(F.desc(F.size("path")), "entry", "rank")
    t = traces.withColumns({"first": F.col("path")[0], "last": F.element_at("path", -1)}).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
    return t if limit is None else t.orderBy(F.desc(F.size("path")), "entry", "rank").limit(limit)


# ---------------------------------------------------------------- communities


def undirected(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Of a given partition (id, community): sum over communities of L/m - r (d/2m)^2."""
    u = undirected(edges)
    a, b = membership.select(F.col("id").alias("a"), F.col("community").alias("ca")), membership.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    j = u.join(a, "a").join(b, "b")
    ends = j.select(F.col("ca").alias("c")).unionAll(j.select("cb")).groupBy("c").agg(F.count("*").alias("d"))
    inner = j.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("l"))
    m = j.agg(F.count("*").alias("m"))
    per = ends.join(inner, "c", "left").na.fill(0, ["l"]).join(m)
    return per.agg(F.round(F.sum(F.col("l") / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), 2)), 6).alias("modularity"), F.count("*").alias("communities"))


#: Fixed values.
GENERIC_FOLDERS = ("src", "lib", "core", "utils", "common", "shared", "helpers")


def community_labels(membership: DataFrame, nodes: DataFrame) -> DataFrame:
    """Most frequent parent folder that isn't generic, capitalised, else Cluster_<community>."""
    j = membership.join(nodes.select("id", "file_path"), "id")
    parts = F.split("file_path", "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    c = j.select("community", folder.alias("f")).where(F.col("f").isNotNull() & ~F.lower("f").isin(list(GENERIC_FOLDERS)) & (F.col("f") != "")).groupBy("community", "f").agg(F.count("*").alias("n"))
    best = c.groupBy("community").agg(F.min_by("f", F.struct((-F.col("n")).alias("n"), "f")).alias("f"))
    label = F.coalesce(F.concat(F.upper(F.substring("f", 1, 1)), F.expr("substring(f, 2)")), F.concat(F.lit("Cluster_"), F.col("community").cast("string")))
    return membership.select("community").distinct().join(best, "community", "left").select("community", label.alias("label"))


def cohesion(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """cohesion is 1 by definition (members over members); internal_share is the share of a community's edge ends that stay inside."""
    u = undirected(edges)
    a, b = membership.select(F.col("id").alias("a"), F.col("community").alias("ca")), membership.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    j = u.join(a, "a").join(b, "b")
    ends = j.select(F.col("ca").alias("community"), (F.col("ca") == F.col("cb")).cast("int").alias("i")).unionAll(j.select("cb", (F.col("ca") == F.col("cb")).cast("int")))
    g = ends.groupBy("community").agg(F.round(F.avg("i") + 1e-9, 4).alias("internal_share"))
    size = membership.groupBy("community").agg(F.count("*").alias("members"))
    return size.join(g, "community", "left").select("community", "members", F.lit(1.0).alias("cohesion"), F.coalesce("internal_share", F.lit(0.0)).alias("internal_share"))
