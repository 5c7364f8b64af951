"""Module-level views of a graph: calls between and inside groups, exports, changes, renames and diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cut import Levels, cut
from .prefix import prefix_sums


def _ends(edges: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    a, b = nodes.select(F.col("id").alias("src"), F.col(by).alias("from")), nodes.select(F.col("id").alias("dst"), F.col(by).alias("to"))
    return edges.join(a, "src").join(b, "dst")


def inter_file_calls(edges: DataFrame, nodes: DataFrame, by: str = "file_path") -> DataFrame:
    return _ends(edges, nodes, by).where("`from` <> `to`").select("from", "to").distinct()


def module_edge_counts(edges: DataFrame, nodes: DataFrame, by: str = "community") -> DataFrame:
    return _ends(edges, nodes, by).where("`from` <> `to`").groupBy("from", "to").agg(F.count("*").alias("count"))


def intra_calls(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among members(id)."""
    return edges.join(members.select(F.col("id").alias("src")), "src", "left_semi").join(members.select(F.col("id").alias("dst")), "dst", "left_semi")


def crossing_calls(edges: DataFrame, members: DataFrame, limit: int = 30) -> DataFrame:
    """Edges with exactly one end among the members, the first ``limit`` each way by edge_seq."""
    s, d = members.select(F.col("id").alias("src")), members.select(F.col("id").alias("dst"))
    out = edges.join(s, "src", "left_semi").join(d, "dst", "left_anti").withColumn("way", F.lit("out")).orderBy("edge_seq").limit(limit)
    into = edges.join(s, "src", "left_anti").join(d, "dst", "left_semi").withColumn("way", F.lit("in")).orderBy("edge_seq").limit(limit)
    return out.unionByName(into)


def dependency_counts(edges: DataFrame) -> DataFrame:
    return edges.where("type <> 'DEFINES'").groupBy("src", "dst", "type").agg(F.count("*").alias("count"))


def files_with_exports(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_exported").groupBy("file_path").agg(F.sort_array(F.collect_set("name")).alias("exports"), F.count("*").alias("n_exports"))


def primary_community(nodes: DataFrame, least: int = 2, limit: int = 30) -> DataFrame:
    """Files per primary community (that of most of a file's symbols, the least name on ties); communities with fewer than
    ``least`` files are one group, __other__."""
    c = nodes.groupBy("file_path", "community").agg(F.count("*").alias("n"))
    w = Window.partitionBy("file_path").orderBy(F.desc("n"), "community")
    first = c.withColumn("k", F.row_number().over(w)).where("k = 1")
    size = first.groupBy("community").agg(F.count("*").alias("files"))
    named = size.withColumn("grp", F.when(F.col("files") < least, "__other__").otherwise(F.col("community")))
    return named.groupBy("grp").agg(F.sum("files").alias("files")).orderBy(F.desc("files"), "grp").limit(limit)


def language_breakdown(files: DataFrame) -> DataFrame:
    """files(language, bytes)."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("relationships")))


def process_stats(steps: DataFrame, membership: DataFrame) -> DataFrame:
    """Number of processes, of those in more than one community, and mean steps to one place."""
    p = steps.join(membership.select(F.col("id").alias("node_id"), "community"), "node_id", "left").groupBy("process_id").agg(F.count("*").alias("n"), F.count_distinct("community").alias("c"))
    return p.agg(F.count("*").alias("processes"), F.sum(F.when(F.col("c") > 1, 1).otherwise(0)).alias("cross_community"), F.round(F.avg("n") + 1e-9, 1).alias("avg_steps"))


def process_names(steps: DataFrame) -> DataFrame:
    """process_id, n_steps, label: first step -> last step."""
    g = steps.groupBy("process_id").agg(F.count("*").alias("n_steps"), F.min_by("label", "step").alias("a"), F.max_by("label", "step").alias("b"))
    return g.select("process_id", "n_steps", F.concat("a", F.lit(" -> "), "b").alias("label"))


def change_risk(processes: Column) -> Column:
    return F.when(processes == 0, "low").when(processes <= 5, "medium").when(processes <= 15, "high").otherwise("critical")


def detect_changes(changed: DataFrame, nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """changed(file_path): symbols in the files and processes that hold them, with the risk."""
    s = nodes.join(changed.select("file_path").distinct(), "file_path", "left_semi")
    p = steps.join(s.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("process_id").distinct()
    one = s.agg(F.count("*").alias("symbols")).join(p.agg(F.count("*").alias("processes")))
    return one.withColumn("risk", F.when(F.col("symbols") == 0, "none").otherwise(change_risk(F.col("processes"))))


def rename_plan(texts: DataFrame, old: str, new: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 1), before, after of every line that holds ``old`` as a whole word."""
    import re

    p = rf"\b{re.escape(old)}\b"
    lines = texts.where(F.col(text).contains(old)).select(key, F.posexplode(F.split(text, "\n")).alias("i", "before"))
    return lines.where(F.col("before").rlike(p)).select(key, (F.col("i") + 1).alias("line"), "before", F.regexp_replace("before", p, new).alias("after"))


def grep_enrichment(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """hits(hit_id, match_text) with the first symbol of that name, blanks without one."""
    first = nodes.groupBy("name").agg(F.min_by(F.struct("id", "label", "file_path"), "def_seq").alias("s"))
    j = hits.join(first, hits["match_text"] == first["name"], "left")
    return j.select("hit_id", F.coalesce(F.col("s.id").cast("string"), F.lit("")).alias("symbol"), F.coalesce("s.label", F.lit("")).alias("label"), F.coalesce("s.file_path", F.lit("")).alias("file_path"))


def glob_enrichment(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """files(file_path) with the number of symbols and the languages in them."""
    g = nodes.groupBy("file_path").agg(F.count("*").alias("symbols"), F.sort_array(F.collect_set("language")).alias("languages"))
    return files.join(g, "file_path", "left").select("file_path", F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("languages", F.array().cast("array<string>")).alias("languages"))


def _mermaid(s: Column) -> Column:
    return F.regexp_replace(s, "[^a-zA-Z0-9]", "_")


def module_diagram(counts: DataFrame, top: int = 10) -> DataFrame:
    """counts(from, to, count) -> one row with the diagram's text: the ``top`` modules by the calls they take part in."""
    ends = counts.select(F.col("from").alias("m"), "count").unionAll(counts.select("to", "count"))
    best = ends.groupBy("m").agg(F.sum("count").alias("w")).orderBy(F.desc("w"), "m").limit(top).select("m")
    inner = counts.join(best.withColumnRenamed("m", "from"), "from", "left_semi").join(best.withColumnRenamed("m", "to"), "to", "left_semi")
    node = best.select(F.lit(0).alias("o"), F.col("m").alias("k"), F.concat(F.lit("  "), _mermaid(F.col("m")), F.lit('["'), "m", F.lit('"]')).alias("t"))
    arc = inner.select(F.lit(1).alias("o"), F.concat_ws(" ", "from", "to").alias("k"), F.concat(F.lit("  "), _mermaid(F.col("from")), F.lit(" -->|"), F.col("count").cast("string"), F.lit(" calls| "), _mermaid(F.col("to"))).alias("t"))
    rows = node.unionAll(arc).agg(F.sort_array(F.collect_list(F.struct("o", "k", "t"))).alias("r"))
    return rows.select(F.array_join(F.concat(F.array(F.lit("graph LR")), F.transform("r", lambda x: x["t"])), "\n").alias("diagram"))


def prefix_within_budget(files: DataFrame, budget: int, order: str = "seq", size: str = "tokens", by: str = "module") -> DataFrame:
    """Files of each module in order, up to the first that would overflow the budget."""
    return prefix_sums(files, {"used": size}, [order], by=[by]).where(F.col("used") <= budget)


def pack_chunks(files: DataFrame, budget: int, by: str, order: str, size: str) -> DataFrame:
    """Greedy packing in order into chunks of at most ``budget`` (a larger file alone, or after files of size 0, is a chunk): adds chunk, from 0.
    Each file points to where the next chunk would begin if one began with it, found by sorting its limit among the running
    sums; from each group's first file, pointers that double mark the chunks that do begin.  No group is ever in one task."""
    f = files.select(by, order, F.col(size).cast("long").alias(size))
    f = cut(prefix_sums(f, {"_end": size, "_place": "1L"}, [order], by=[by]))
    own = F.lit(None).cast("long")
    ends = f.select(by, F.col("_end").alias("v"), F.lit(1).cast("long").alias("point"), F.col(size).alias("w"), own.alias("at"), own.alias("begin"))
    limits = f.select(by, (F.col("_end") - F.col(size) + budget).alias("v"), F.lit(0).cast("long").alias("point"), F.lit(0).cast("long").alias("w"), F.col("_place").alias("at"), (F.col("_end") - F.col(size)).alias("begin"))
    held = prefix_sums(ends.unionAll(limits), {"fit": "point", "sum": "w"}, ["v", F.desc("point")], by=[by]).where("at IS NOT NULL")
    # of files that fit none may have a size: then the next one, whatever its size, belongs to them
    step = held.select(by, "at", (F.col("fit") + F.when(F.col("sum") > F.col("begin"), 1).otherwise(2)).alias("to"))
    ends_at = f.groupBy(by).agg(F.max("_place").alias("last"))
    step = cut(step.join(ends_at, step[by].eqNullSafe(ends_at[by])).where("to <= last").select(step[by], "at", "to"))
    begun = Levels(f.select(by, F.lit(1).cast("long").alias("at")).distinct())
    while True:
        known = begun.all()
        new = begun.add(known.join(step, known[by].eqNullSafe(step[by]) & (known["at"] == step["at"])).select(known[by], F.col("to").alias("at")))
        if new.isEmpty():
            break
        far = step.select(F.col(by).alias("_g"), F.col("at").alias("mid"), F.col("to").alias("end"))
        step = cut(step.join(far, F.col(by).eqNullSafe(F.col("_g")) & (F.col("to") == F.col("mid"))).select(by, "at", F.col("end").alias("to")))
    starts = begun.all().distinct().select(F.col(by).alias("_g"), F.col("at").alias("_at"))
    marked = f.join(starts, F.col(by).eqNullSafe(F.col("_g")) & (F.col("_place") == F.col("_at")), "left").withColumn("_starts", F.col("_at").isNotNull().cast("int")).drop("_g", "_at")
    out = prefix_sums(marked, {"chunk": "_starts"}, ["_place"], by=[by])
    return out.select(by, order, size, (F.col("chunk") - 1).cast("int").alias("chunk"))


def rank_strategies(strategies: DataFrame, problems: DataFrame, alternatives: int = 3) -> DataFrame:
    """strategies(strategy_id, tier, weight, traits), problems(problem_id, traits): weight times the share of the problem's traits
    that the strategy serves (a tenth of the weight where either has none); best and alternatives.  Every problem has a score
    for every strategy, so each row meets the whole registry; the planner sends it by its own size check."""
    s = strategies.withColumnRenamed("traits", "has")
    j = problems.crossJoin(s)
    none = (F.size("traits") == 0) | (F.size("has") == 0)
    score = F.when(none, F.col("weight") * 0.1).otherwise(F.col("weight") * F.size(F.filter("traits", lambda t: F.array_contains("has", t))) / F.nullif(F.size("traits"), F.lit(0)))
    w = Window.partitionBy("problem_id").orderBy(F.desc(F.round(score, 9)), "tier", "strategy_id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 1 + alternatives).select("problem_id", "rank", "strategy_id", F.round(score + 1e-9, 4).alias("score"))
