"""Sources and sinks: source trees, git text, stores and event logs, all through Spark's readers and writers."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

MAX_BYTES = 512 * 1024


def walk(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, **ignored: list[str]) -> DataFrame:
    """path (below root), length, content of the files under ``root``, without large files and those that
    ``functions.text.ignored`` leaves out (by its own lists or ``folders``, ``extensions`` and ``names``); bytes that aren't UTF-8 are
    replaced."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_bytes)
    path = F.regexp_replace("path", r"^.*?" + _quoted(root.rstrip("/")) + "/", "")
    return b.where(~X.ignored(path, **ignored)).select(path.alias("path"), "length", F.expr("make_valid_utf8(cast(content AS STRING))").alias("content"))


def _quoted(s: str) -> str:
    import re

    return re.escape(s.split("://")[-1])


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", X.language(F.col("path")))


def snippet(content: Column, start: Column, end: Column, before: int = 2, after: int = 2, most: int | None = 5000) -> Column:
    """Lines start - before .. end + after (from 0) of a text, cut at ``most`` characters (None: whole)."""
    first = F.greatest(start - before, F.lit(0)) + 1
    lines = F.array_join(F.slice(F.split(content, "\n"), first, F.greatest(end + after + 2 - first, F.lit(0))), "\n")
    return lines if most is None else F.left(lines, F.lit(most))


def is_binary(content: Column) -> Column:
    """More than a tenth of the first thousand characters are control characters."""
    head = F.left(content, F.lit(1000))
    return F.regexp_count(head, F.lit(r"[\x00-\x08\x0E-\x1F]")) > F.length(head) * 0.1


# ---------------------------------------------------------------- git text


def parse_commit_log(text: DataFrame, column: str = "value") -> DataFrame:
    """Rows (log_id, value): one ``git log --name-only`` text each, a header line ``sha TAB author TAB email TAB date`` for
    each commit -> sha, author, email, ts, file, commit_seq."""
    lines = text.select("log_id", F.posexplode(F.split(column, "\n")).alias("n", "line")).where("line <> ''")
    head = F.size(F.split("line", "\t")) >= 4
    w = Window.partitionBy("log_id").orderBy("n")
    c = lines.withColumn("commit_seq", F.sum(head.cast("int")).over(w)).withColumn("h", F.when(head, F.split("line", "\t")))
    heads = c.where("h IS NOT NULL").select("log_id", "commit_seq", F.col("h")[0].alias("sha"), F.col("h")[1].alias("author"), F.col("h")[2].alias("email"), F.try_to_timestamp(F.col("h")[3]).alias("ts"))
    files = c.where("h IS NULL AND commit_seq > 0").select("log_id", "commit_seq", F.col("line").alias("file"))
    return files.join(heads, ["log_id", "commit_seq"])


def parse_numstat(text: DataFrame, column: str = "value") -> DataFrame:
    """``added TAB deleted TAB file`` lines -> file, added, deleted; binary changes (-) are left out."""
    lines = text.select(F.explode(F.split(column, "\n")).alias("line"))
    p = F.split("line", "\t")
    return lines.where((F.size(p) >= 3) & p[0].rlike(r"^\d+$") & p[1].rlike(r"^\d+$")).select(p[2].alias("file"), p[0].cast("bigint").alias("added"), p[1].cast("bigint").alias("deleted"))


def parse_blame(text: DataFrame, column: str = "value") -> DataFrame:
    """Rows (file, value) of ``git blame --line-porcelain`` -> file, author, email, line_count, keyed by email or author."""
    lines = text.select("file", F.posexplode(F.split(column, "\n")).alias("n", "line"))
    kind = F.when(F.col("line").startswith("author "), "author").when(F.col("line").startswith("author-mail "), "email")
    m = lines.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("v", F.regexp_replace("line", r"^author(-mail)? <?|>$", ""))
    w = Window.partitionBy("file").orderBy("n")
    m = m.withColumn("k", F.sum(F.when(F.col("kind") == "author", 1).otherwise(0)).over(w))
    one = m.groupBy("file", "k").agg(F.max(F.when(F.col("kind") == "author", F.col("v"))).alias("author"), F.max(F.when(F.col("kind") == "email", F.col("v"))).alias("email"))
    key = F.coalesce(F.nullif("email", F.lit("")), F.col("author"))
    return one.groupBy("file", key.alias("who")).agg(F.min_by("author", "k").alias("author"), F.min_by("email", "k").alias("email"), F.count("*").alias("line_count")).drop("who")


# ---------------------------------------------------------------- symbols


SYMBOL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("kind", "name", "parent")] + [T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line")] + [T.StructField("detail", T.StringType())]
)


@F.udtf(returnType=SYMBOL)
class PythonSymbols:
    """Functions, methods, classes, imports, heritage and calls of a Python source text."""

    def eval(self, content: str):
        try:
            tree = ast.parse(content or "")
        except (SyntaxError, ValueError, RecursionError):
            return
        todo = [(n, "", False) for n in reversed(tree.body)]
        while todo:
            node, parent, in_class = todo.pop()
            inner, is_class = parent, in_class
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield "Method" if in_class else "Function", node.name, parent, node.lineno, node.end_lineno, ast.get_docstring(node) or ""
                inner, is_class = node.name, False
            elif isinstance(node, ast.ClassDef):
                yield "Class", node.name, parent, node.lineno, node.end_lineno, ast.get_docstring(node) or ""
                for b in node.bases:
                    name = ast.unparse(b).split(".")[-1].split("[")[0]
                    if name != "object":
                        yield "EXTENDS", node.name, name, node.lineno, node.lineno, ""
                inner, is_class = node.name, True
            elif isinstance(node, ast.Import):
                for a in node.names:
                    yield "IMPORT", a.name, parent, node.lineno, node.lineno, a.asname or ""
            elif isinstance(node, ast.ImportFrom):
                for a in node.names:
                    yield "IMPORT", "." * node.level + (node.module or ""), parent, node.lineno, node.lineno, a.name
            elif isinstance(node, ast.Call):
                f = node.func
                if isinstance(f, ast.Name):
                    yield "CALL", f.id, parent, node.lineno, node.lineno, ""
                elif isinstance(f, ast.Attribute):
                    yield "CALL", f.attr, parent, node.lineno, node.lineno, ast.unparse(f.value)[:200]
            todo += [(n, inner, is_class) for n in reversed(list(ast.iter_child_nodes(node)))]


def python_symbols(files: DataFrame) -> DataFrame:
    """files(path, content) -> path with a row for each symbol, import, heritage and call."""
    spark = files.sparkSession
    spark.udtf.register("python_symbols", PythonSymbols)
    return spark.sql("SELECT path, s.* FROM {files}, LATERAL python_symbols(content) s", files=files)


#: language -> pattern of a definition with the name as its first group.  Fixed values.
DEFINITIONS = {
    "go": r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)",
    "rust": r"(?m)^\s*(?:pub\s+)?fn\s+(\w+)",
    "typescript": r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)",
    "javascript": r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)",
    "java": r"(?m)^\s*(?:public|private|protected)\s+[\w<>\[\], ]+\s+(\w+)\s*\(",
    "swift": r"(?m)^\s*(?:public\s+)?func\s+(\w+)",
}


def definitions(files: DataFrame) -> DataFrame:
    """files(path, language, content) -> path, name of function definitions, by pattern, without Python code."""
    found = F.array().cast("array<string>")
    for lang, p in DEFINITIONS.items():
        found = F.when(F.col("language") == lang, F.regexp_extract_all("content", F.lit(p), F.lit(1))).otherwise(found)
    return files.select("path", "language", F.explode(found).alias("name"))


#: language -> pattern of an import statement, and of the modules in it as its first group.  Fixed values.
_QUOTED = r"""['"]([^'"]+)['"]"""
_SCRIPT = (r"""(?m)^\s*(?:import|export)\s+(?:[^'";()]*?\sfrom\s*)?['"][^'"]+['"]""", _QUOTED)
IMPORTS = {
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "go": (r"""(?m)^import\s*(?:\([^)]*\)|[\w.]*\s*"[^"]+")""", _QUOTED),
    "java": (r"(?m)^\s*import\s+(?:static\s+)?[\w.]+\*?", r"([\w.*]+)$"),
    "kotlin": (r"(?m)^\s*import\s+[\w.]+\*?", r"([\w.*]+)$"),
    "csharp": (r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?[\w.]+\s*;", r"([\w.]+)\s*;"),
    "rust": (r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+[^;]+;", r"use\s+([^;]+);"),
    "c": (r"""(?m)^\s*#\s*include\s*[<"][^>"]+[>"]""", r"""[<"]([^>"]+)[>"]"""),
    "cpp": (r"""(?m)^\s*#\s*include\s*[<"][^>"]+[>"]""", r"""[<"]([^>"]+)[>"]"""),
    "php": (r"(?m)^\s*use\s+(?:function\s+|const\s+)?[\w\\\\]+[^;]*;", r"use\s+(?:function\s+|const\s+)?([\w\\\\]+)"),
    "swift": (r"(?m)^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|enum|protocol|func|var)\s+)?[\w.]+", r"([\w.]+)$"),
    "ruby": (r"""(?m)^\s*require(?:_relative)?\s*\(?\s*['"][^'"]+['"]""", _QUOTED),
}
_CLASS = r"(?:class|interface|struct|protocol|object|enum)\s+\w+"
#: language -> pattern of a class with its heritage.  Fixed values.
HERITAGE = {
    **dict.fromkeys(("typescript", "javascript", "java", "php"), _CLASS + r"(?:<[^{]*?>)?\s+(?:extends|implements)\b[^{]*"),
    **dict.fromkeys(("kotlin", "csharp", "swift", "cpp"), _CLASS + r"(?:<[^:{]*>)?(?:\([^)]*\))?\s*:[^:{][^{\n]*"),
    "ruby": r"class\s+\w+\s*<\s*[\w:]+",
}


def _by_language(patterns: dict[str, str]) -> Column:
    found = F.array().cast("array<string>")
    for lang, p in patterns.items():
        found = F.when(F.col("language") == lang, F.regexp_extract_all("content", F.lit(p), F.lit(0))).otherwise(found)
    return found


def imports(files: DataFrame) -> DataFrame:
    """files(path, language, content) -> path, language, module, names (of the import clause of a script; else empty), by
    pattern: a statement inside a comment counts too."""
    each = files.select("path", "language", F.explode(_by_language({k: s for k, (s, _) in IMPORTS.items()})).alias("statement"))
    modules = F.array().cast("array<string>")
    for lang, (_, module) in IMPORTS.items():
        modules = F.when(F.col("language") == lang, F.regexp_extract_all("statement", F.lit(module), F.lit(1))).otherwise(modules)
    clause = F.regexp_extract("statement", r"(?s)^\s*(?:import|export)\s+(?:type\s+)?(.*?)\s+from\s*['\"]", 1)
    words = F.split(F.translate(clause, "{}", ",,"), ",")
    name = lambda x: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^(?:type |\* as )", ""), " as .*", "")
    names = F.when(F.col("language").isin("typescript", "javascript"), F.filter(F.transform(words, name), lambda x: ~x.isin("", "*"))).otherwise(F.array().cast("array<string>"))
    return each.select("path", "language", F.explode(modules).alias("module"), names.alias("names")).withColumn("module", F.trim("module"))


def heritage(files: DataFrame) -> DataFrame:
    """files(path, language, content) -> path, language, child, parent, kind (EXTENDS or IMPLEMENTS), by pattern.  Where a language doesn't
    tell them apart, all are EXTENDS."""
    each = files.select("path", "language", F.explode(_by_language(HERITAGE)).alias("s"))
    plain = F.regexp_replace(F.regexp_replace("s", r"<[^<>]*>", ""), r"\([^()]*\)", "")
    each = each.select("path", "language", F.when(F.col("language") == "ruby", F.col("s")).otherwise(plain).alias("s"))
    child = F.regexp_extract("s", r"^\w+\s+(\w+)", 1)
    listed = lambda p: F.split(F.regexp_extract("s", p, 1), ",")
    word = F.col("language").isin("typescript", "javascript", "java", "php")
    first = F.when(word, listed(r"(?s)\bextends\s+(.*?)(?:\bimplements\b.*)?$")).when(F.col("language") == "ruby", listed(r"<\s*(.*)$")).otherwise(listed(r"(?s):\s*(.*)$"))
    second = F.when(word, listed(r"(?s)\bimplements\s+(.*?)$")).otherwise(F.array().cast("array<string>"))
    row = lambda kind: lambda x: F.struct(F.trim(F.regexp_replace(F.regexp_replace(x, r"\b(?:public|private|protected|virtual)\s+", ""), r"\s+(?:where|by)\s.*", "")).alias("parent"), F.lit(kind).alias("kind"))
    both = F.concat(F.transform(first, row("EXTENDS")), F.transform(second, row("IMPLEMENTS")))
    return each.select("path", "language", child.alias("child"), F.explode(both).alias("x")).select("path", "language", "child", "x.parent", "x.kind").where("parent <> ''")


# ---------------------------------------------------------------- stores


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Full overwrite of both tables, parted by label and type so that filters on them prune."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str, labels: list[str] | None = None, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables; labels and types outside the given lists become CodeElement and CALLS."""
    n, e = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if labels:
        n = n.withColumn("label", F.when(F.col("label").isin(labels), F.col("label")).otherwise("CodeElement"))
    if types:
        e = e.withColumn("type", F.when(F.col("type").isin(types), F.col("type")).otherwise("CALLS"))
    return n, e


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def save_csv(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").option("quoteAll", "true").option("escape", '"').option("header", "true").partitionBy("label").csv(path)


def label_of_id(column: Column) -> Column:
    return F.when(column.startswith("comm_"), "Community").when(column.startswith("proc_"), "Process").otherwise(F.substring_index(column, ":", 1))


def split_by_labels(edges: DataFrame) -> DataFrame:
    """Adds from_label and to_label, read from the ids."""
    return edges.withColumns({"from_label": label_of_id(F.col("src").cast("string")), "to_label": label_of_id(F.col("dst").cast("string"))})


EVENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("event_id", "event_type")]
    + [T.StructField("stage_id", T.IntegerType()), T.StructField("session_id", T.StringType()), T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(n, T.StringType()) for n in ("tool_name", "outcome", "message")]
    + [T.StructField("duration_ms", T.DoubleType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))]
)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """An append-only JSON-lines log; lines that don't parse keep their text in _bad and are never dropped silently."""
    schema = T.StructType([*EVENT.fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)


def query_audit(events: DataFrame, session: str | None = None, stage: int | None = None, outcome: str | None = None, since: str | None = None, limit: int = 100) -> DataFrame:
    for c, v in (("session_id", session), ("stage_id", stage), ("outcome", outcome)):
        if v is not None:
            events = events.where(F.col(c) == v)
    if since is not None:
        events = events.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    return events.orderBy(F.desc("timestamp"), "event_id").limit(limit)


def parse_handoff(text: Column, section: str) -> Column:
    """Items of one list of a handoff document."""
    body = F.regexp_extract(text, rf"(?ms)^## {section}\s*\n(.*?)(?:^## |\z)", 1)
    return F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^\s*[-*]\s+(.+)$"), F.lit(1)), lambda x: F.trim(x))


def render_handoff(sections: dict[str, Column]) -> Column:
    parts = [F.concat(F.lit(f"## {k}\n"), F.array_join(F.transform(v, lambda x: F.concat(F.lit("- "), x)), "\n")) for k, v in sections.items()]
    return F.concat_ws("\n\n", *parts)
