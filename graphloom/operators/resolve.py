"""Name, import and scope resolution as ranked equi-joins: candidates of every tier are joined at once and the best
is taken by an ordered minimum, so no tier costs a pass of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Suffixes tried in this order.  Fixed values.
EXTENSIONS = (
    "", ".tsx", ".ts", ".jsx", ".js", "/index.tsx", "/index.ts", "/index.jsx", "/index.js", ".py", "/__init__.py", ".java", ".kt", ".kts",
    ".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".hxx", ".hh", ".cs", ".go", ".rs", "/mod.rs", ".php", ".phtml", ".swift",
)


def resolve_calls(calls: DataFrame, defs: DataFrame, imports: DataFrame, exact: str = "last") -> DataFrame:
    """calls(call_id, file, name), defs(file, name, node_id, def_seq), imports(file, imported): the definition in the same
    file (0.85), else the first in an imported file (0.9), else the first anywhere (0.5 if it is the only one, 0.3
    otherwise).  Calls that find none are left out.  A call meets each tier's minimum only, never all definitions of a
    common name."""
    d = defs.select("file", "name", "node_id", "def_seq")
    order = F.max_by if exact == "last" else F.min_by
    own = d.groupBy("file", "name").agg(order("node_id", "def_seq").alias("own"))
    by_file = d.groupBy("file", "name").agg(F.min(F.struct("def_seq", "node_id")).alias("first"))
    keys = calls.select("file", "name").distinct()
    via = (
        keys.join(imports.select("file", "imported").distinct(), "file")
        .join(by_file.select(F.col("file").alias("imported"), "name", "first"), ["imported", "name"])
        .groupBy("file", "name").agg(F.min("first").alias("via"))
    )
    world = d.groupBy("name").agg(F.min(F.struct("def_seq", "node_id")).alias("any"), F.count("*").alias("n"))
    j = keys.join(own, ["file", "name"], "left").join(via, ["file", "name"], "left").join(world, "name", "left")
    target = F.coalesce("own", "via.node_id", "any.node_id")
    conf = F.when(F.col("own").isNotNull(), 0.85).when(F.col("via").isNotNull(), 0.9).when(F.col("n") == 1, 0.5).otherwise(0.3)
    tier = F.when(F.col("own").isNotNull(), "same_file").when(F.col("via").isNotNull(), "imported").otherwise("global")
    best = j.where(target.isNotNull()).select("file", "name", target.alias("target"), conf.alias("confidence"), tier.alias("tier"))
    return calls.join(best, ["file", "name"]).select("call_id", "target", "confidence", "tier")


def resolve_tiered(calls: DataFrame, defs: DataFrame, imports: DataFrame, named: DataFrame) -> DataFrame:
    """Second form: same file 1.0, named import 0.9 (named(file, name, imported)), any imported file 0.7 in the order of
    imports(file, imported, import_seq), anywhere 0.3."""
    d = defs.groupBy("file", "name").agg(F.min(F.struct("def_seq", "node_id")).alias("first"))
    keys = calls.select("file", "name").distinct()
    pick = lambda rank, seq, conf: F.struct(F.lit(rank).alias("rank"), seq.alias("seq"), F.col("first.def_seq").alias("def"), F.col("first.node_id").alias("node_id"), F.lit(conf).alias("confidence"))
    zero = F.lit(0).cast("bigint")
    a = keys.join(d, ["file", "name"]).select("file", "name", pick(1, zero, 1.0).alias("c"))
    b = keys.join(named, ["file", "name"]).join(d.withColumnRenamed("file", "imported"), ["imported", "name"]).select("file", "name", pick(2, zero, 0.9).alias("c"))
    c = keys.join(imports, "file").join(d.withColumnRenamed("file", "imported"), ["imported", "name"]).select("file", "name", pick(3, F.col("import_seq").cast("bigint"), 0.7).alias("c"))
    w = defs.groupBy("name").agg(F.min(F.struct("def_seq", "node_id")).alias("first"))
    e = keys.join(w, "name").select("file", "name", pick(4, zero, 0.3).alias("c"))
    best = a.unionByName(b).unionByName(c).unionByName(e).groupBy("file", "name").agg(F.min("c").alias("c"))
    return calls.join(best, ["file", "name"]).select("call_id", F.col("c.node_id").alias("target"), F.col("c.confidence").alias("confidence"), F.col("c.rank").alias("tier"))


def resolve_heritage(rows: DataFrame, defs: DataFrame) -> DataFrame:
    """rows(file, child, parent, kind) -> src, dst, type: the child by file, then by name, the parent by name, each else a made-up
    Class id; what would extend itself is dropped."""
    exact = defs.groupBy("file", "name").agg(F.max_by("node_id", "def_seq").alias("exact")).withColumnRenamed("name", "child")
    fuzzy = defs.groupBy("name").agg(F.min_by("node_id", "def_seq").alias("id"))
    j = (
        rows.join(exact, ["file", "child"], "left")
        .join(fuzzy.select(F.col("name").alias("child"), F.col("id").alias("fuzzy")), "child", "left")
        .join(fuzzy.select(F.col("name").alias("parent"), F.col("id").alias("up")), "parent", "left")
    )
    made = lambda c: F.concat(F.lit("Class:"), F.col(c))
    return j.select(F.coalesce(F.col("exact").cast("string"), F.col("fuzzy").cast("string"), made("child")).alias("src"), F.coalesce(F.col("up").cast("string"), made("parent")).alias("dst"), F.col("kind").alias("type")).where("src <> dst")


def suffix_index(files: DataFrame) -> DataFrame:
    """files(path, seq) -> suffix, path, seq of every path suffix at a slash, the first file of each, and the same in
    lower case (ci)."""
    p = F.split("path", "/")
    e = files.select("path", "seq", p.alias("p")).select("path", "seq", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))).alias("suffix"))
    both = e.select(F.lit(0).alias("ci"), "suffix", "path", "seq").unionByName(e.select(F.lit(1).alias("ci"), F.lower("suffix").alias("suffix"), "path", "seq"))
    return both.groupBy("ci", "suffix").agg(F.min_by("path", "seq").alias("path"))


def resolve_imports(imports: DataFrame, files: DataFrame, extensions=EXTENSIONS) -> DataFrame:
    """imports(import_id, module) with dots or slashes -> import_id, path: the longest suffix of the module first, then the
    extensions in order, exact before case-blind."""
    m = imports.select("import_id", F.split(F.translate("module", ".", "/"), "/").alias("p"))
    cand = m.select("import_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", i, F.size("p")), "/"))).alias("i", "s"))
    cand = cand.select("import_id", "i", "s", F.posexplode(F.array(*[F.lit(x) for x in extensions])).alias("x", "ext"))
    cand = cand.select("import_id", "i", "x", F.concat("s", "ext").alias("key"))
    both = cand.select("import_id", "i", "x", F.lit(0).alias("ci"), F.col("key").alias("suffix")).unionByName(cand.select("import_id", "i", "x", F.lit(1).alias("ci"), F.lower("key").alias("suffix")))
    hit = both.join(suffix_index(files), ["ci", "suffix"])
    return hit.groupBy("import_id").agg(F.min(F.struct("i", "x", "ci", "path")).alias("b")).select("import_id", F.col("b.path").alias("path"))


def normalise_relative(base_dir: Column, module: Column) -> Column:
    """``./`` and ``../`` folded against a folder."""
    parts = F.concat(F.filter(F.split(base_dir, "/"), lambda x: x != ""), F.split(module, "/"))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.array_join(folded, "/")


def resolve_relative(imports: DataFrame, files: DataFrame, extensions=EXTENSIONS) -> DataFrame:
    """imports(import_id, file, module) -> the first existing file by extension."""
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    c = imports.select("import_id", normalise_relative(folder, F.col("module")).alias("t")).select("import_id", "t", F.posexplode(F.array(*[F.lit(x) for x in extensions])).alias("x", "ext"))
    hit = c.select("import_id", "x", F.concat("t", "ext").alias("path")).join(files.select("path"), "path")
    return hit.groupBy("import_id").agg(F.min_by("path", "x").alias("path"))


def rewrite_alias(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """imports(import_id, module), aliases(prefix, target, alias_seq) -> module with the first fitting prefix replaced.  The
    alias table is a project's configuration; it is broadcast when small, by the planner's own size check."""
    j = imports.join(aliases, F.col("module").startswith(F.col("prefix")), "left")
    best = j.groupBy("import_id", "module").agg(F.min_by(F.struct("prefix", "target"), "alias_seq").alias("a"))
    new = F.concat(F.col("a.target"), F.expr("substring(module, length(a.prefix) + 1)"))
    return best.select("import_id", F.when(F.col("a").isNotNull(), new).otherwise(F.col("module")).alias("module"))


def rust_candidates(module: Column, crate_root: Column, here: Column) -> Column:
    """Files that a Rust path may stand for, in order."""
    body = F.when(module.startswith("crate::"), F.concat(crate_root, F.lit("/"), F.replace(module.substr(F.lit(8), F.length(module)), F.lit("::"), F.lit("/"))))
    body = body.when(module.startswith("super::"), F.concat(F.regexp_replace(here, "/[^/]*$", ""), F.lit("/"), F.replace(module.substr(F.lit(8), F.length(module)), F.lit("::"), F.lit("/"))))
    body = body.when(module.startswith("self::"), F.concat(here, F.lit("/"), F.replace(module.substr(F.lit(7), F.length(module)), F.lit("::"), F.lit("/")))).otherwise(F.replace(module, F.lit("::"), F.lit("/")))
    parent = F.regexp_replace(body, "/[^/]*$", "")
    return F.array(F.concat(body, F.lit(".rs")), F.concat(body, F.lit("/mod.rs")), body, F.concat(parent, F.lit(".rs")), F.concat(parent, F.lit("/mod.rs")))


def innermost_scope(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """points(point_id, file, line), scopes(file, scope_id, start_line, end_line) -> point_id, scope_id: the narrowest range
    around the line, the first by id on ties.  A range is cut into the blocks of 2^k lines that it covers (two for each k at most),
    of a block's ranges only the best is kept, and a distinct (file, line) looks up its own block of every size that the file has:
    the rows grow with ranges and points, never with their pairs."""
    a, end = F.col("start_line").cast("long"), F.col("end_line").cast("long") + 1  # end: the first line behind

    def blocks(k):
        low, high = -F.call_function("shiftright", -a, k), F.call_function("shiftright", end, k)
        odd = lambda c: c.bitwiseAND(F.lit(1)) == 1
        return F.array(
            F.struct(k.alias("size"), F.when((low < high) & odd(low), low).alias("block")),
            F.struct(k.alias("size"), F.when((low < high) & odd(high), high - 1).alias("block")),
        )

    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("width"), "scope_id"))
    distinct = scopes.groupBy("file", "start_line", "end_line").agg(F.min("scope_id").alias("scope_id"))
    cover = distinct.select("*", F.inline(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), blocks)))).where("block IS NOT NULL")
    cover = cover.groupBy("file", "size", "block").agg(best.alias("best"))
    sizes = cover.groupBy("file").agg(F.collect_set("size").alias("sizes"))  # 63 at most
    asked = points.select("file", "line").distinct().join(sizes, "file").select("file", "line", F.explode("sizes").alias("size"))
    hit = asked.withColumn("block", F.call_function("shiftright", F.col("line").cast("long"), F.col("size"))).join(cover, ["file", "size", "block"])
    hit = hit.groupBy("file", "line").agg(F.min("best").alias("best"))
    return points.join(hit, ["file", "line"]).groupBy("point_id").agg(F.min("best").alias("best")).select("point_id", F.col("best.scope_id").alias("scope_id"))


def scoped_type(lookups: DataFrame, bindings: DataFrame) -> DataFrame:
    """lookups(lookup_id, file, name, scope), bindings(file, name, scope, type): the type in the nearest scope that isn't inside
    the asked one."""
    rank = lambda c: F.when(F.col(c) == "function", 1).when(F.col(c) == "class", 2).otherwise(3)
    j = lookups.withColumn("asked", rank("scope")).drop("scope").join(bindings.withColumn("rank", rank("scope")).drop("scope"), ["file", "name"]).where("rank >= asked")
    return j.groupBy("lookup_id").agg(F.min_by("type", "rank").alias("type"))


def longest_prefix(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """paths(id, path), repos(repo, root): the repository with the longest root around the path.  Each path's own prefixes are
    joined, so no pair is tried that doesn't fit."""
    p = F.split("path", "/")
    e = paths.select("id", p.alias("p")).select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", 1, i), "/"))).alias("root"))
    return e.join(repos, "root").groupBy("id").agg(F.max_by("repo", F.struct(F.length("root"), "repo")).alias("repo"))


def drop_builtins(calls: DataFrame, builtins: DataFrame) -> DataFrame:
    return calls.join(builtins.select("name").distinct(), "name", "left_anti")


def named_import_map(rows: DataFrame) -> DataFrame:
    """rows(file, names, path, seq) -> (file, name) -> path, the last import wins."""
    e = rows.select("file", "path", "seq", F.explode("names").alias("name"))
    w = Window.partitionBy("file", "name").orderBy(F.desc("seq"))
    return e.withColumn("k", F.row_number().over(w)).where("k = 1").select("file", "name", F.col("path").alias("imported"))
