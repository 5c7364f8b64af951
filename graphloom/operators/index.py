"""A stored inverted index: postings in blocks of documents, with a bound of each block's impact.

``build`` cuts the documents of each scan task into blocks of a bounded number of words and inverts each block where it was read, so no
word is shuffled.  A row is one term in one block (how many documents, the greatest count and the least length among them, documents, counts,
places), so no row grows with the corpus, however frequent the term; one more row of a block lists its documents' keys and lengths.  Rows are
partitioned by a bucket of the term, spread over tasks by block as well, and sorted by term and block, so a query reads its terms' pages
and no text.

``top_k`` bounds every block by its greatest counts and least lengths, scores the k best-bounded blocks for a threshold, and then reads only blocks whose
bound reaches it: the rows are those of a full ranking.  ``any_term`` and ``phrase`` give all matches.

Defined cases: a null or empty text is a document of no words, counted in the statistics; rows with equal or null keys are
documents of their own; the documents must be rows of stored tables (a task that is repeated must read the same rows in the same order); a query without words has no matches, nor has an empty index; columns other than key and text are
ignored; ties in score go by key (nulls first).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cut import new_path
from .search import K1, B, plain_terms, tokens

DOCUMENTS = -1  # the bucket of the rows that list a block's documents
PAGE_ROWS = 256  # terms and blocks in a page of postings: what a rare term makes its query read


@dataclass(frozen=True)
class Index:
    """Where an index is, and the numbers that every score needs."""

    path: str
    n: int
    avgdl: float
    buckets: int
    key_type: str


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _factor(tf: Column, dl: Column, avgdl: float) -> Column:
    """The part of BM25 that doesn't depend on how many documents hold the term."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def _schema(key_type: str) -> str:
    return (
        f"term string, block long, n int, most int, least int, docs array<int>, tfs array<int>, places array<array<int>>, keys array<{key_type}>, dls array<int>"
    )


def _inverted(keys: pa.Array, words: pa.ListArray, block: int, schema: pa.Schema):
    """Rows of one block: its documents, then its terms with their documents and places."""
    n = len(keys)
    dl = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)

    def lists(offsets, values):
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    def rows(k: int, **columns):
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(k, f.type)).cast(f.type) for f in schema], schema=schema)

    yield rows(1, block=pa.array([block]), keys=lists([0, n], keys), dls=lists([0, n], pa.array(dl)))
    flat = words.flatten().dictionary_encode()
    if not len(flat):
        return
    code = flat.indices.to_numpy()
    doc = np.repeat(np.arange(n, dtype=np.int32), dl)
    pos = (np.arange(len(code)) - np.repeat(np.cumsum(dl) - dl, dl)).astype(np.int32)
    order = np.argsort(code, kind="stable")
    code, doc, pos = code[order], doc[order], pos[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])  # of each posting
    tf = np.diff(np.r_[first, len(code)]).astype(np.int32)
    of, held = code[first], doc[first]
    term = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])  # first posting of each term
    ends = np.r_[term, len(of)]
    yield rows(
        len(term), term=flat.dictionary.take(pa.array(of[term])), block=pa.array(np.full(len(term), block)), n=pa.array(np.diff(ends)),
        most=pa.array(np.maximum.reduceat(tf, term)), least=pa.array(np.minimum.reduceat(dl[held], term)),
        docs=lists(ends, pa.array(held)), tfs=lists(ends, pa.array(tf)), places=lists(ends, lists(np.r_[first, len(code)], pa.array(pos))),
    )


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, buckets: int = 64, block_words: int = 65_536, spread: int = 8) -> Index:
    """Write the index of ``docs`` to ``path`` (a new place in the shared folder if none is given)."""
    spark = docs.sparkSession
    path = path or new_path(spark)
    key_type = docs.schema[key].dataType.simpleString()

    def invert(batches):
        block = TaskContext.get().partitionId() << 32
        ints = pa.list_(pa.int32())
        for batch in batches:
            keys, words = batch.column(0), batch.column(1)
            schema = pa.schema([("term", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("most", pa.int32()), ("least", pa.int32()), ("docs", ints), ("tfs", ints), ("places", pa.list_(ints)), ("keys", pa.list_(keys.type)), ("dls", ints)])
            upto = np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(keys):
                before = upto[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(upto, before + block_words, side="right")))
                yield from _inverted(keys.slice(lo, hi - lo), words.slice(lo, hi - lo), block, schema)
                block, lo = block + 1, hi

    words = docs.select(F.col(key).alias("key"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    rows = words.mapInArrow(invert, _schema(key_type)).withColumn("bucket", F.when(F.col("term").isNull(), DOCUMENTS).otherwise(_bucket(F.col("term"), buckets)))
    stored = rows.repartition("bucket", F.col("block") % spread).sortWithinPartitions("bucket", "term", "block")
    stored.write.option("parquet.page.row.count.limit", PAGE_ROWS).option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    lengths = _documents(_read(spark, path, key_type)).select(F.explode("dls").alias("dl"))
    lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.lit(buckets).alias("buckets"), F.lit(key_type).alias("key_type")).write.parquet(f"{path}/statistics")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Index:
    """The index that was written to ``path``."""
    x = spark.read.parquet(f"{path}/statistics").first()
    return Index(path, x["n"], x["avgdl"] or 1.0, x["buckets"], x["key_type"])


def _read(spark: SparkSession, path: str, key_type: str) -> DataFrame:
    """The index's table; its schema is given, for a table of no rows has no files to tell one."""
    return spark.read.schema(f"{_schema(key_type)}, bucket int").parquet(f"{path}/postings")


def _documents(table: DataFrame) -> DataFrame:
    return table.where(F.col("bucket") == DOCUMENTS).select("block", "keys", "dls")


def _of_terms(table: DataFrame, index: Index, terms: list[str]) -> DataFrame:
    """Rows of the terms, by literal filters on the partition and the sorted columns, which reach the scan."""
    found = table.sparkSession.range(1).select(*[_bucket(F.lit(t), index.buckets) for t in terms]).first()
    return table.where(F.col("bucket").isin(sorted(set(found))) & F.col("term").isin(terms))


def _idf(n: int, df: int) -> Column:
    return F.log(1 + (F.lit(n) - F.lit(df) + 0.5) / (F.lit(df) + 0.5))


def _frequencies(heads: DataFrame, terms: list[str]) -> list[int]:
    """Documents of each term: a row for each term of the query comes to the driver."""
    got = dict(heads.groupBy("term").agg(F.sum("n")).collect())
    return [got.get(t, 0) for t in terms]


def _rows(postings: DataFrame, table: DataFrame, *more: str) -> DataFrame:
    """A row for each posting, with its document's key and length: block and place in it name the document."""
    zipped = F.arrays_zip("docs", "tfs", *more)
    doc = F.transform(zipped, lambda x: F.struct(x["docs"].alias("doc"), F.get("keys", x["docs"]).alias("key"), F.get("dls", x["docs"]).alias("dl"), x["tfs"].alias("tf"), *[x[m].alias(m) for m in more]))
    return postings.select("term", "block", "docs", "tfs", *more).join(_documents(table), "block").select("term", "block", F.explode(doc).alias("d")).select("term", "block", "d.*")


def _scored(postings: DataFrame, table: DataFrame, index: Index, terms: list[str], df: list[int], key: str) -> DataFrame:
    rows = _rows(postings, table)
    tf = [F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
    score = F.lit(0.0)
    for i, d in enumerate(df):
        score = score + _idf(index.n, d) * _factor(F.col(f"tf{i}"), F.col("dl"), index.avgdl)
    return rows.groupBy("block", "doc", "key", "dl").agg(*tf).select(F.col("key").alias(key), F.round(score, 6).alias("score"))


def _none(table: DataFrame, key: str) -> DataFrame:
    return table.where("false").select(F.explode("keys").alias(key), F.lit(0.0).alias("score"))


def any_term(spark: SparkSession, index: Index, query: str, key: str = "doc_id") -> DataFrame:
    """BM25 of every document with any of the query's distinct words."""
    table, terms = _read(spark, index.path, index.key_type), list(dict.fromkeys(plain_terms(query)))
    if not terms:
        return _none(table, key)
    postings = _of_terms(table, index, terms)
    return _scored(postings, table, index, terms, _frequencies(postings, terms), key)


def top_k(spark: SparkSession, index: Index, query: str, k: int = 20, key: str = "doc_id") -> DataFrame:
    """The k best of ``any_term``, from those blocks only that can hold one of them."""
    table, terms = _read(spark, index.path, index.key_type), list(dict.fromkeys(plain_terms(query)))
    if not terms:
        return _none(table, key)
    postings = _of_terms(table, index, terms)
    df, blocks = _bounds(postings, index, terms)
    first = [b for b, _ in blocks.orderBy(F.desc("bound"), "block").limit(k).collect()]
    best = _scored(postings.where(F.col("block").isin(first)), table, index, terms, df, key)
    last = best.orderBy(F.desc("score")).limit(k).agg(F.count("*"), F.min("score")).first()
    if last[0] == k:  # scores are rounded to six places, bounds aren't
        blocks = blocks.where(F.col("bound") >= last[1] - 2e-6)
    return _scored(postings.join(blocks.select("block"), "block", "left_semi"), table, index, terms, df, key).orderBy(F.desc("score"), key).limit(k)


def _bounds(heads: DataFrame, index: Index, terms: list[str]) -> tuple[list[int], DataFrame]:
    """Documents of each term, and for each block the greatest score that one of its documents may have."""
    df = _frequencies(heads, terms)
    weight = F.lit(0.0)
    for t, d in zip(terms, df):
        weight = F.when(F.col("term") == t, _idf(index.n, d)).otherwise(weight)
    return df, heads.groupBy("block").agg(F.sum(weight * _factor(F.col("most"), F.col("least"), index.avgdl)).alias("bound"))


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def phrase(spark: SparkSession, index: Index, query: str, key: str = "doc_id") -> DataFrame:
    """BM25 with the whole query as one term: documents that hold its words in a row, told by their places."""
    table, terms = _read(spark, index.path, index.key_type), plain_terms(query)
    if not terms:
        return _none(table, key)
    distinct = list(dict.fromkeys(terms))
    postings = _of_terms(table, index, distinct)
    whole = postings.groupBy("block").count().where(F.col("count") == len(distinct)).select("block")
    rows = _rows(postings.join(whole, "block", "left_semi"), table, "places")
    # one row of a document and term, so ``max`` only picks it
    held = rows.groupBy("block", "doc", "key", "dl").agg(*[F.max(F.when(F.col("term") == t, F.col("places"))).alias(f"p{i}") for i, t in enumerate(distinct)])
    common = F.col(f"p{distinct.index(terms[0])}")
    for i, t in enumerate(terms[1:], 1):
        common = F.array_intersect(common, _shifted(F.col(f"p{distinct.index(t)}"), i))
    hits = held.select("key", "dl", F.size(common).alias("tf")).where("tf > 0")
    n = hits.agg(F.count("*").alias("df"))  # one row
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return hits.join(F.broadcast(n)).select(F.col("key").alias(key), F.round(idf * _factor(F.col("tf"), F.col("dl"), index.avgdl), 6).alias("score"))
