"""Full text as a postings table, ranking, reciprocal-rank fusion and vector top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75  # of BM25 (Robertson), the published defaults


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, key, tf, positions.  The index is a table: partition it by term to answer many queries."""
    e = docs.select(key, F.posexplode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("pos", "term"))
    return e.groupBy("term", key).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def doc_lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.size(tokens(F.coalesce(F.col(text), F.lit("")))).alias("dl"))


def _matched(docs: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """Per document its length and tf of each query term, without exploding the words that no query asks for."""
    words = tokens(F.coalesce(F.col(text), F.lit("")))
    t = docs.select(key, words.alias("w"))

    def tf(q: str) -> Column:
        return F.size(F.filter("w", lambda x: x == F.lit(q)))

    return t.select(key, "w", F.size("w").alias("dl"), *[tf(q).alias(f"tf{i}") for i, q in enumerate(terms)])


def _bm25(m: DataFrame, terms: list[str], key: str, hit: Column, tfs: list[Column]) -> DataFrame:
    n = m.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum(F.when(t > 0, 1).otherwise(0)).alias(f"df{i}") for i, t in enumerate(tfs)])
    j = m.where(hit).join(F.broadcast(n))  # one row of statistics
    s = F.lit(0.0)
    for i, t in enumerate(tfs):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        s = s + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return j.select(key, F.round(s, 6).alias("score"))


def any_term(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """BM25 over documents with any of the query's distinct terms."""
    terms = list(dict.fromkeys(plain_terms(query)))
    m = _matched(docs, terms, key, text)
    tfs = [F.col(f"tf{i}") for i in range(len(terms))]
    return _bm25(m, terms, key, F.greatest(*tfs, F.lit(0)) > 0, tfs)


def phrase_count(words: Column, terms: list[str]) -> Column:
    """Places where the terms stand one after another."""
    ahead = "".join(f" {t}" for t in terms[1:])
    return F.regexp_count(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {terms[0]}(?={ahead} )"))


def phrase(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """BM25 with the whole query as one term: only documents that hold its words in a row."""
    terms = plain_terms(query)
    words = tokens(F.coalesce(F.col(text), F.lit("")))
    # the cheap test first: places are looked at only where the first word stands
    count = F.when(F.array_contains("w", F.lit(terms[0])), phrase_count(F.col("w"), terms)).otherwise(0)
    m = docs.select(key, words.alias("w")).select(key, F.size("w").alias("dl"), count.alias("tf0"))
    return _bm25(m, [query], key, F.col("tf0") > 0, [F.col("tf0")])


def plain_terms(query: str) -> list[str]:
    """The words of a query, as ``tokens`` cuts them."""
    import re

    return [w for w in re.split(r"[\W_]+", query.lower()) if w]


def like(docs: DataFrame, query: str, name: str, content: str) -> DataFrame:
    """Substring fallback whatever the case, name matches first: column place 0 or 1.  The query is plain text; % and _ in it
    stand for themselves."""
    by_name = F.lower(name).contains(query.lower())
    return docs.where(by_name | F.lower(content).contains(query.lower())).withColumn("place", F.when(by_name, 0).otherwise(1))


def weighted_fields(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """name 3 (and 5 more when equal), signature 2, docstring 1; the first field that matched is named."""
    q = query.lower()
    has = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q))
    s = F.when(has("name"), 3.0).otherwise(0.0) + F.when(F.lower("name") == q, 5.0).otherwise(0.0) + F.when(has("signature"), 2.0).otherwise(0.0) + F.when(has("docstring"), 1.0).otherwise(0.0)
    f = F.when(has("name"), "name").when(has("signature"), "signature").otherwise("docstring")
    return nodes.select("id", s.alias("score"), f.alias("matched_field")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def ranked(scored: DataFrame, key: str = "doc_id", limit: int = 100) -> DataFrame:
    """Adds rank from 0 by falling score; the top only, so the window sees ``limit`` rows."""
    top = scored.orderBy(F.desc("score"), key).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1)


def rrf_single(ranking: DataFrame, k: int = 60) -> DataFrame:
    """1 / (k + rank): one list, ranks from 0."""
    return ranking.withColumn("rrf", F.round(1.0 / (k + F.col("rank")), 9))


def rrf(rankings: list[DataFrame], key: str = "doc_id", k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank + 1) over the lists."""
    u = None
    for r in rankings:
        x = r.select(key, (1.0 / (k + F.col("rank") + 1)).alias("s"))
        u = x if u is None else u.unionByName(x)
    return u.groupBy(key).agg(F.round(F.sum("s"), 9).alias("rrf"), F.count("*").alias("lists"))


def hybrid(fused: DataFrame, steps: DataFrame, key: str = "doc_id", limit: int = 20) -> DataFrame:
    """rrf + 0.1 for each process that holds the result."""
    p = steps.select(F.col("node_id").alias(key), "process_id").distinct().groupBy(key).agg(F.count("*").alias("processes"))
    j = fused.join(p, key, "left").na.fill(0, ["processes"])
    return j.withColumn("score", F.round(F.col("rrf") + 0.1 * F.col("processes"), 9)).orderBy(F.desc("score"), key).limit(limit)


def process_rollup(ranking: DataFrame, steps: DataFrame, key: str = "doc_id", limit: int = 20) -> DataFrame:
    """Processes by the sum of their results' single-list score."""
    r = rrf_single(ranking).select(F.col(key).alias("node_id"), "rrf")
    j = steps.select("process_id", "node_id").distinct().join(r, "node_id")
    g = j.groupBy("process_id").agg(F.round(F.sum("rrf") + 1e-9, 3).alias("score"), F.count("*").alias("symbols"))
    return g.orderBy(F.desc("score"), "process_id").limit(limit)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def vector_top_k(vectors: DataFrame, query: list[float], k: int = 10, within: float | None = 0.5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k nearest first, then those nearer than ``within``."""
    q = F.array(*[F.lit(float(x)) for x in query])
    top = vectors.select(key, F.round(cosine_distance(F.col(column), q), 6).alias("distance")).orderBy("distance", key).limit(k)
    return top if within is None else top.where(F.col("distance") < within)


def hashed_encoding(text: Column, dims: int = 64) -> Column:
    """A stand-in encoder without a model: hashed term counts, unit length."""
    slot = F.transform(tokens(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int"))
    count = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slot, lambda s: s == i)).cast("double"))
    norm = F.sqrt(F.aggregate(count, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(count, lambda v: F.coalesce(v / F.nullif(norm, F.lit(0.0)), F.lit(0.0)).cast("float"))
