"""Views over a stored graph: clusters and processes in detail, module trees, a registry of repositories, tables as text, and
read-only SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cluster_members(nodes: DataFrame, membership: DataFrame, top: int = 30) -> DataFrame:
    """community, rank, id, name, label, file_path: the first ``top`` members of each community by name and id."""
    j = membership.select("id", "community").join(nodes.select("id", "name", "label", "file_path"), "id")
    w = Window.partitionBy("community").orderBy("name", "id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("community", "rank", "id", "name", "label", "file_path")


def processes_with_steps(steps: DataFrame, nodes: DataFrame, top: int = 20) -> DataFrame:
    """process_id, n_steps, steps (struct of step, name, in order): the ``top`` processes of most steps, then least id."""
    best = steps.groupBy("process_id").agg(F.count("*").alias("n_steps")).orderBy(F.desc("n_steps"), "process_id").limit(top)
    j = steps.join(best, "process_id").join(nodes.select(F.col("id").alias("node_id"), "name"), "node_id")
    return j.groupBy("process_id", "n_steps").agg(F.sort_array(F.collect_list(F.struct("step", "name"))).alias("steps"))


def cross_community_processes(steps: DataFrame, membership: DataFrame, top: int = 10) -> DataFrame:
    """process_id, n_steps, communities of the ``top`` longest processes whose nodes are in more than one community."""
    j = steps.join(membership.select(F.col("id").alias("node_id"), "community"), "node_id", "left")
    g = j.groupBy("process_id").agg(F.count("*").alias("n_steps"), F.count_distinct("community").alias("communities"))
    return g.where("communities > 1").orderBy(F.desc("n_steps"), "process_id").limit(top)


def tool_symbols(nodes: DataFrame) -> DataFrame:
    """Nodes in the shape that tools show: uid, name, kind, filePath, line."""
    return nodes.select(F.col("id").alias("uid"), "name", F.col("label").alias("kind"), F.col("file_path").alias("filePath"), F.col("start_line").alias("line"))


def markdown_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """section (0 header, 1 rule, 2 rows, 3 count) and line of a table as Markdown; rows are to be read in the order of (section, the
    columns named by ``order``), which stay in ``key``.  Nulls are empty, bars are escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    key = F.struct(*[F.col(c) for c in order])
    rows = df.select(F.lit(2).alias("section"), key.alias("key"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))
    count = df.agg(F.count("*").alias("n")).select(F.lit(3).alias("section"), F.lit(None).alias("key"), F.concat(F.lit("row_count: "), F.col("n").cast("string")).alias("line"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + " --- |" * len(df.columns))], "section int, line string")
    return head.select("section", F.lit(None).alias("key"), "line").unionByName(rows).unionByName(count)


def registry(entries: DataFrame) -> DataFrame:
    """entries(path, name, seq): the latest entry of each absolute path; others aren't paths of a repository and go."""
    good = entries.where(F.col("path").startswith("/") & ~F.col("path").rlike(r"(^|/)[.][.](/|$)"))
    return good.groupBy(F.regexp_replace("path", "(?<=.)/+$", "").alias("path")).agg(F.max_by("name", "seq").alias("name"), F.max("seq").alias("seq"))


def module_tree(nodes: DataFrame) -> DataFrame:
    """module (folder), files, symbols, names (the first 50 by name): File rows hold no symbol of their own."""
    folder = F.regexp_replace("file_path", "/?[^/]*$", "")
    own = nodes.select(folder.alias("module"), "file_path", F.when(F.col("label") != "File", F.col("name")).alias("name"))
    w = Window.partitionBy("module").orderBy("name")
    first = own.where("name IS NOT NULL").select("module", "name").distinct().withColumn("k", F.row_number().over(w)).where("k <= 50")
    names = first.groupBy("module").agg(F.sort_array(F.collect_list("name")).alias("names"))
    g = own.groupBy("module").agg(F.count_distinct("file_path").alias("files"), F.count("name").alias("symbols"))
    return g.join(names, "module", "left").select("module", "files", "symbols", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def call_diagram(edges: DataFrame, nodes: DataFrame, top: int = 12) -> DataFrame:
    """One row with the text of a call graph: the ``top`` symbols by calls in and out, and the calls among them."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select("dst"))
    best = ends.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(top).join(nodes.select("id", "name"), "id").select("id", "name")
    name = lambda c: F.concat(F.lit("n"), F.regexp_replace(F.col(c).cast("string"), "[^a-zA-Z0-9]", "_"))
    box = best.select(F.lit(0).alias("o"), F.struct("id", F.col("id").alias("b")).alias("k"), F.concat(F.lit("  "), name("id"), F.lit('["'), "name", F.lit('"]')).alias("t"))
    inner = edges.join(best.select(F.col("id").alias("src")), "src", "left_semi").join(best.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    arc = inner.select(F.lit(1).alias("o"), F.struct(F.col("src").alias("id"), F.col("dst").alias("b")).alias("k"), F.concat(F.lit("  "), name("src"), F.lit(" --> "), name("dst")).alias("t"))
    rows = box.unionAll(arc).agg(F.sort_array(F.collect_list(F.struct("o", "k", "t"))).alias("r"))
    return rows.select(F.array_join(F.concat(F.array(F.lit("graph TD")), F.transform("r", lambda x: x["t"])), "\n").alias("diagram"))


#: Nodes of a parsed query that only reads; any other one is refused.
READING = {
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "CTE", "UnresolvedHaving",
    "WithWindowDefinition", "Window", "Pivot", "Unpivot", "UnresolvedUnpivot", "Generate", "OneRowRelation", "UnresolvedInlineTable", "LocalRelation", "UnresolvedSubqueryColumnAliases", "Sample", "Tail", "UnresolvedOrdinal", "UnresolvedStar",
}
#: Functions that call into the machine.
CALLING_OUT = r"(?i)\b(?:try_)?(?:reflect|java_method)\W*\("


def read_only_sql(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """The result of a query over ``views`` by name.  The text is parsed, not run: every node of its plan must be one that reads, every relation
    one of the views or of its own ``WITH``; functions that call into the machine are refused.  Words inside strings don't matter."""
    bare = re.sub(r"(?s)'(?:\\.|''|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|--[^\n]*|/\*.*?\*/", " ", sql)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).treeString()  # the parser has no other door in Python
    except Exception as error:
        raise PermissionError("only one statement that can be read as a query is allowed") from error
    own = {n.strip() for names in re.findall(r"CTE \[([^\]]*)\]", plan) for n in names.split(",")}
    for line in plan.splitlines():
        node = re.match(r"[\s:|+-]*'?(\w+)", line)
        if node and node[1] not in READING:
            raise PermissionError(f"only statements that read are allowed, not {node[1]}")
        relation = re.match(r"[\s:|+-]*'?UnresolvedRelation \[([^\]]*)\]", line)
        if relation and relation[1] not in views and relation[1] not in own:
            raise PermissionError(f"no such view: {relation[1]}")
    if re.search(CALLING_OUT, bare):
        raise PermissionError("functions that call into the machine are not allowed")
    given = ", ".join(f"`{n}` AS (SELECT * FROM {{{n}}})" for n in views if n not in own)
    text = sql.replace("{", "{{").replace("}", "}}")
    if given:
        begun = re.match(r"(?i)\s*WITH\b(\s+RECURSIVE\b)?", text)
        text = f"WITH{begun[1] or ''} {given}, {text[begun.end() :]}" if begun else f"WITH {given} {text}"
    return spark.sql(text, **views)
