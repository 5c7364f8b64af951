import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import index as I
from graphloom.operators import search as S

WORDS = ["the", "the", "the", "a", "a", "cat", "dog", "sat", "on", "mat", "blue", "rare"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.choice([1, 3, 20, 60])))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " ... "), (303, "needle in the Cat"), (7, rows[7][1]), (None, "the cat sat needle"), (None, "the cat sat needle")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x")).withColumn("dl", F.lit(0)).repartition(5)


@pytest.fixture(scope="module")
def index(docs):
    return I.build(docs, buckets=4, block_words=100)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("query", ["cat dog", "needle", "the", "absent", "rare absent the the"])
def test_same_as_reading_the_texts(spark, docs, index, query):
    want = S.any_term(docs, query)
    assert rows(I.any_term(spark, index, query)) == rows(want)
    for k in (1, 10, 1000):
        best = [tuple(r) for r in want.orderBy(F.desc("score"), "doc_id").limit(k).collect()]
        assert [tuple(r) for r in I.top_k(spark, index, query, k).collect()] == best


@pytest.mark.parametrize("query", ["the cat", "the the", "the cat sat", "cat the cat the", "needle in the cat", "needle", "mat needle"])
def test_phrases(spark, docs, index, query):
    assert rows(I.phrase(spark, index, query)) == rows(S.phrase(docs, query))


def test_no_words_and_no_documents(spark, docs, index):
    for f in (I.any_term, I.top_k, I.phrase):
        assert f(spark, index, " !? ").collect() == []
    for empty in (docs.where("false"), docs.where("doc_id = 300"), docs.where("false").select(F.lit("s").alias("doc_id"), "text")):
        none = I.build(empty)
        for f in (I.any_term, I.top_k, I.phrase):
            got = f(spark, none, "the cat")
            assert got.collect() == [] and got.schema["doc_id"].dataType == empty.schema["doc_id"].dataType


def test_string_keys_and_reopening(spark, docs):
    named = docs.select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("body"))
    at = I.build(named, "name", "body")
    assert I.opened(spark, at.path) == at
    assert rows(I.top_k(spark, at, "needle cat", 5, "name")) == rows(S.any_term(named, "needle cat", "name", "body").orderBy(F.desc("score"), "name").limit(5))


def test_blocks_are_skipped(spark):
    """One block's documents are about the word, and the others only name it: their bound is under the threshold."""
    d = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id").between(500, 509), F.repeat(F.lit("needle "), 50)).otherwise(F.concat(F.lit("needle "), F.repeat(F.lit("hay "), 49))).alias("text"))
    at = I.build(d, block_words=1000)
    df, blocks = I._bounds(I._of_terms(I._read(spark, at.path, at.key_type), at, ["needle"]), at, ["needle"])
    best = I.top_k(spark, at, "needle", 5)
    assert [r[0] for r in best.collect()] == [500, 501, 502, 503, 504] and df == [2000]
    assert blocks.count() > 90 and blocks.where(F.col("bound") >= best.agg(F.min("score")).first()[0] - 2e-6).count() <= 2


def test_scans_read_their_terms_only(spark):
    """What the scan of the postings gives, by its own figures: bytes of files that are opened, and rows of pages that are read."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.concat_ws(" ", "text", F.when(F.col("doc_id") == 77, "zyzzyva")).alias("text"))
    at = I.build(d)

    def scanned(df):
        df = df.select("block", "docs")
        found, plan = len(df.collect()), df._jdf.queryExecution().executedPlan()
        while "numFiles" not in (figures := {k: v for k, v in _pairs(plan.metrics())}):
            plan = plan.children().head()
        return found, figures["filesSize"].value(), figures["numOutputRows"].value()

    def _pairs(m):
        it = m.iterator()
        while it.hasNext():
            x = it.next()
            yield x._1(), x._2()

    whole = scanned(I._read(spark, at.path, at.key_type))
    rare = scanned(I._of_terms(I._read(spark, at.path, at.key_type), at, ["zyzzyva"]))
    frequent = scanned(I._of_terms(I._read(spark, at.path, at.key_type), at, ["the"]))
    print(whole, rare, frequent)
    assert rare[0] == 1 and frequent[0] > 1 and whole[0] == whole[2]
    assert rare[1] < whole[1] / 20 and rare[2] < whole[2] / 50
    assert [r[0] for r in I.top_k(spark, at, "zyzzyva").collect()] == [77]
