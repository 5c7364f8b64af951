"""Questions about a project as a whole: its framework, caps, staleness, output schemas, and search results with their surroundings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import search as S

#: In this order; the first that is found decides.  (framework, confidence, condition over the counted path patterns.)
#: Patterns are on lower-cased paths with forward slashes.  Fixed values.
PATTERNS = {
    "manage": r"manage\.py$", "views_urls": r"(?:views|urls)\.py$", "server": r"server\.js|server\.ts|app\.js", "routes": r"/routes/.*\.(?:js|ts)$", "flask": "flask",
    "fastapi": r"fastapi|/(?:routers|endpoints)/.*\.py$", "controllers": "/app/controllers/", "spring": r"pom\.xml|build\.gradle|/controller/.*\.java$",
}
PROJECT_FRAMEWORKS = (
    ("django", 0.9, "manage >= 1"), ("django", 0.7, "views_urls >= 2"), ("express", 0.8, "server >= 1 AND routes >= 1"), ("express", 0.5, "server >= 1"),
    ("flask", 0.8, "flask >= 1"), ("fastapi", 0.7, "fastapi >= 1"), ("rails", 0.8, "controllers >= 1"), ("spring", 0.7, "spring >= 1"),
)


def project_framework(files: DataFrame, by: str | None = None) -> DataFrame:
    """files(path) -> framework, confidence: one aggregation over all paths (of each project, with ``by``)."""
    p = F.replace(F.lower("path"), F.lit("\\"), F.lit("/"))
    counts = [F.sum(F.when(p.rlike(r), 1).otherwise(0)).alias(k) for k, r in PATTERNS.items()]
    g = files.groupBy(*([by] if by else [])).agg(*counts)
    name = conf = None
    for f, c, when in PROJECT_FRAMEWORKS:
        e = F.expr(when)
        name = F.when(e, f) if name is None else name.when(e, f)
        conf = F.when(e, c) if conf is None else conf.when(e, c)
    return g.select(*([by] if by else []), name.otherwise("unknown").alias("framework"), conf.otherwise(0.0).alias("confidence"))


def process_cap(nodes: DataFrame) -> DataFrame:
    """At most so many processes: a tenth of the nodes that aren't files, between 20 and 300."""
    n = F.sum(F.when(F.col("label") == "File", 0).otherwise(1))
    return nodes.agg(F.greatest(F.lit(20), F.least(F.lit(300), F.round(F.coalesce(n, F.lit(0)) / 10))).cast("int").alias("cap"))


def commits_behind(commits: DataFrame, indexed, seq: str = "commit_seq") -> DataFrame:
    return commits.where(F.col(seq) > F.lit(indexed)).agg(F.count("*").alias("behind")).withColumn("stale", F.col("behind") > 0)


def missing_keys(output: Column, required: list[str]) -> Column:
    """Required keys that a JSON object lacks; all of them where it isn't an object."""
    return F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(F.json_object_keys(output), F.array().cast("array<string>")))


#: language -> ordered (framework, multiplier, words) looked for in a definition's lower-cased text.  Fixed values.
DECORATORS = {
    "javascript": (("nestjs", 3.2, ("@controller", "@get", "@post", "@put", "@delete", "@patch")),),
    "typescript": (("nestjs", 3.2, ("@controller", "@get", "@post", "@put", "@delete", "@patch")),),
    "python": (("fastapi", 3.0, ("@app.get", "@app.post", "@app.put", "@app.delete", "@router.get")), ("flask", 2.8, ("@app.route", "@blueprint.route"))),
    "java": (("spring", 3.2, ("@restcontroller", "@controller", "@getmapping", "@postmapping", "@requestmapping")), ("jaxrs", 3.0, ("@path", "@get", "@post", "@put", "@delete"))),
    "kotlin": (
        ("spring-kotlin", 3.2, ("@restcontroller", "@controller", "@getmapping", "@postmapping", "@requestmapping")), ("ktor", 2.8, ("routing", "embeddedserver", "application.module")),
        ("android-kotlin", 2.5, ("@androidentrypoint", "appcompatactivity", "fragment(")),
    ),
    "csharp": (("aspnet", 3.2, ("[apicontroller]", "[httpget]", "[httppost]", "[route]")),),
    "php": (("laravel", 3.0, ("route::get", "route::post", "route::put", "route::delete", "route::resource", "route::apiresource", "#[route(")),),
}


def framework_of_text(language: Column, definition: Column) -> Column:
    """struct(framework, multiplier) by the words in the first 300 characters of a definition; null without one."""
    low = F.lower(F.left(definition, F.lit(300)))
    out = None
    for lang, rules in DECORATORS.items():
        for name, k, words in rules:
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(low, F.lit(w))
            e = (F.lower(language) == lang) & hit
            v = F.struct(F.lit(name).alias("framework"), F.lit(k).alias("multiplier"))
            out = F.when(e, v) if out is None else out.when(e, v)
    return out


def augment(nodes: DataFrame, edges: DataFrame, steps: DataFrame, query: str, hits: int = 10, files: int = 5, per_file: int = 3, most: int = 5, around: int = 3) -> DataFrame:
    """Search results with their surroundings: the best files, up to ``per_file`` symbols of each that hold the query's first
    word, ``most`` in all, each with ``around`` callers and callees and the number of processes it is in."""
    found = S.ranked(S.any_term(nodes, query, "id", "name"), "id", hits).join(nodes.select("id", "file_path"), "id")
    best = found.groupBy("file_path").agg(F.min("rank").alias("rank")).orderBy("rank", "file_path").limit(files)
    first = query.lower().split()[0]
    w = Window.partitionBy("file_path").orderBy("id")
    s = nodes.where(F.contains(F.lower("name"), F.lit(first))).join(best, "file_path").withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_file).orderBy("rank", "file_path", "id").limit(most).select("id", "name", "file_path")

    def near(a: str, b: str, name: str) -> DataFrame:
        e = edges.join(s.select(F.col("id").alias(a)), a, "left_semi").withColumn("k", F.row_number().over(Window.partitionBy(a).orderBy("edge_seq"))).where(F.col("k") <= around)
        return e.groupBy(F.col(a).alias("id")).agg(F.sort_array(F.collect_list(b)).alias(name))

    p = steps.join(s.select(F.col("id").alias("node_id")), "node_id", "left_semi").groupBy(F.col("node_id").alias("id")).agg(F.count_distinct("process_id").alias("processes"))
    return s.join(near("dst", "src", "callers"), "id", "left").join(near("src", "dst", "callees"), "id", "left").join(p, "id", "left").na.fill(0, ["processes"])
