"""History mining: ownership, bus factor, churn and co-change rules, each one aggregation pipeline.

Ties are broken by the ascending key, so every result is a function of its rows.  Ratios are rounded
half-up to four places where that is said; thresholds compare the unrounded value unless said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import prefix_sums


def four(c: Column) -> Column:
    """Rounded half-up to four places, whichever side of the tie the binary value falls."""
    return F.round(c + F.lit(1e-9), 4)


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b, F.lit(0)).cast("double")


def ownership(blame: DataFrame, minor: float = 0.05) -> DataFrame:
    """blame(file, author, line_count) -> file, ownership_ratio, top_contributor, author_count, minor_count.
    A contributor is minor when the unrounded share is under ``minor``."""
    total = Window.partitionBy("file")
    shares = blame.withColumn("total", F.sum("line_count").over(total)).withColumn("share", _ratio(F.col("line_count"), F.col("total")))
    return shares.groupBy("file").agg(
        four(F.max("share")).alias("ownership_ratio"),
        F.min_by("author", F.struct((-F.col("line_count")).alias("l"), "author")).alias("top_contributor"),
        F.count("*").alias("author_count"),
        F.sum(F.when(F.col("share") < minor, 1).otherwise(0)).alias("minor_count"),
    )


def ownership_stats(blame: DataFrame, low: float = 0.5) -> DataFrame:
    """files_analyzed, contributors, low_ownership (rounded ratio under ``low``)."""
    per = ownership(blame)
    a = per.agg(F.count("*").alias("files_analyzed"), F.sum(F.when(F.col("ownership_ratio") < low, 1).otherwise(0)).alias("low_ownership"))
    b = blame.agg(F.count_distinct("author").alias("contributors"))
    return a.join(b)  # one row each


def authored_by(blame: DataFrame) -> DataFrame:
    """file, author, confidence: share of the file's lines to four places."""
    w = Window.partitionBy("file")
    return blame.select("file", "author", four(_ratio(F.col("line_count"), F.sum("line_count").over(w))).alias("confidence"))


def ownership_report(edges: DataFrame, authors: int = 10, files: int = 100) -> DataFrame:
    """From rounded edge confidences: the ``files`` least owned files with their first ``authors`` authors, rank by rank."""
    w = Window.partitionBy("file").orderBy(F.desc("confidence"), "author")
    ranked = edges.withColumn("rank", F.row_number().over(w))
    top = ranked.where("rank = 1").select("file", F.col("confidence").alias("ratio")).orderBy("ratio", "file").limit(files)
    return top.join(ranked.where(F.col("rank") <= authors), "file").select("file", "ratio", "rank", "author", "confidence")


def bus_factor_steps(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The developers that are taken away, greatest coverage first, until the orphaned share reaches
    ``threshold``: rank, author, covered, orphaned (share after the step, four places)."""
    primary = edges.groupBy("file").agg(F.min_by("author", F.struct((-F.col("confidence")).alias("c"), "author")).alias("author"))
    cover = primary.groupBy("author").agg(F.count("*").alias("covered"))
    run = prefix_sums(cover, {"rank": "1", "sum": "covered"}, [F.desc("covered"), F.col("author")])
    total = run.agg(F.max("sum").alias("total"))
    return (
        run.join(F.broadcast(total))  # one row
        .where((F.col("sum") - F.col("covered")) / F.col("total") < threshold)
        .select(F.col("rank").cast("int").alias("rank"), "author", "covered", four(_ratio(F.col("sum"), F.col("total"))).alias("orphaned"))
    )


def bus_factor_risk(n: Column, files: Column) -> Column:
    return F.when(files == 0, "UNKNOWN").when(n <= 1, "CRITICAL").when(n <= 3, "HIGH").when(n <= 6, "MEDIUM").otherwise("LOW")


def bus_factor(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    n = bus_factor_steps(edges, threshold).agg(F.count("*").alias("bus_factor"))
    f = edges.agg(F.count_distinct("file").alias("total_files"))
    return n.join(f).withColumn("risk", bus_factor_risk(F.col("bus_factor"), F.col("total_files")))


def churn(numstat: DataFrame, loc: DataFrame) -> DataFrame:
    """numstat(file, added, deleted), loc(file, total_loc) -> one row per file of ``loc``; relative values are 0 where
    the file has no lines."""
    s = numstat.groupBy("file").agg(F.count("*").alias("churn_count"), F.sum("added").alias("lines_added"), F.sum("deleted").alias("lines_deleted"))
    out = loc.join(s, "file", "left").na.fill(0, ["churn_count", "lines_added", "lines_deleted"])
    rel = lambda c: four(F.coalesce(_ratio(F.col(c), F.col("total_loc")), F.lit(0.0)))
    return out.withColumns({"relative_added": rel("lines_added"), "relative_deleted": rel("lines_deleted")})


def churn_summary(per_file: DataFrame) -> DataFrame:
    n = F.sum(F.when(F.col("churn_count") > 0, 1).otherwise(0))
    return per_file.agg(F.count("*").alias("total_files"), n.alias("with_churn"), four(F.coalesce(_ratio(n, F.count("*")), F.lit(0.0))).alias("churn_ratio"))


BLOCK = 512  # files of a commit that meet in one group
PAIRS = 2_000_000  # pairs that one task counts, about


def cochange_support(commit_files: DataFrame, min_support: int = 1, block: int = BLOCK) -> DataFrame:
    """file_a < file_b with the number of commits that hold both.  Files in fewer than ``min_support`` commits can't
    reach it and are left out before the join.  A commit of more than ``block`` files is cut into blocks of about that many, and each two of
    its blocks are a group of their own, so that one commit's pairs spread over all cores.  The number of tasks goes by the number of
    pairs, which the commits' sizes tell, so that no task's table of pairs grows with the history."""
    if min_support > 1:
        often = commit_files.groupBy("file").agg(F.count("*").alias("c")).where(F.col("c") >= min_support).select("file")
        commit_files = commit_files.join(often, "file")
    n = F.count("*")
    size = commit_files.groupBy("commit_id").agg(F.ceil(n / block).cast("int").alias("blocks"), (n * (n - 1) / 2).alias("pairs"))
    total = size.agg(F.sum("pairs")).first()[0] or 0
    parts = max(int(commit_files.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // PAIRS) + 1)
    cut_ = commit_files.join(size.drop("pairs"), "commit_id").withColumn("own", F.pmod(F.xxhash64("file"), F.col("blocks")).cast("int"))
    a = cut_.select("commit_id", F.col("file").alias("x"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    b = cut_.select("commit_id", F.col("file").alias("y"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"))
    at = ["commit_id", "i", "j"]
    pairs = a.repartition(parts, *at).join(b.repartition(parts, *at), at).where("i < j OR x < y")
    pairs = pairs.select(F.least("x", "y").alias("file_a"), F.greatest("x", "y").alias("file_b")).repartition(parts, "file_a", "file_b")
    out = pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("support"))
    return out.where(F.col("support") >= min_support) if min_support > 1 else out


def cochange(commit_files: DataFrame, min_support: int = 3, min_confidence: float = 0.5) -> DataFrame:
    """Association rules: support, confidence both ways (four places); kept by support and the greater
    unrounded confidence."""
    n = commit_files.groupBy("file").agg(F.count("*").alias("n"))
    out = (
        cochange_support(commit_files, min_support)
        .join(n.select(F.col("file").alias("file_a"), F.col("n").alias("na")), "file_a")
        .join(n.select(F.col("file").alias("file_b"), F.col("n").alias("nb")), "file_b")
    )
    ab, ba = _ratio(F.col("support"), F.col("na")), _ratio(F.col("support"), F.col("nb"))
    return out.where(F.greatest(ab, ba) >= min_confidence).select(
        "file_a", "file_b", "support", four(ab).alias("confidence_ab"), four(ba).alias("confidence_ba")
    )


def cochange_of(pairs: DataFrame, target, limit: int = 50) -> DataFrame:
    """Partners of one file: outgoing pairs only, most frequent first."""
    return pairs.where(F.col("file_a") == F.lit(target)).orderBy(F.desc("support"), "file_b").limit(limit)


def cochange_top(pairs: DataFrame, limit: int = 100) -> DataFrame:
    return pairs.orderBy(F.desc("support"), "file_a", "file_b").limit(limit)


def line_count(content: Column) -> Column:
    """Lines as an iterator over the text counts them: a last one without an end counts, an empty rest doesn't."""
    return (F.regexp_count(content, F.lit("\n")) + F.when(F.length(content) == 0, 0).when(content.endswith("\n"), 0).otherwise(1)).cast("bigint")
