"""Corpus pipeline: language ID, near-duplicate removal, repeated passages, benchmark decontamination, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of
``documents``; the last returns doc_id, lang, source, n_chars, n_tokens and token_ids.  Between stages the rows are
written to the shared folder, so that a lost executor costs one stage's tasks and no more.

Defined cases, in all stages: an empty table gives no rows; columns beyond those of ``documents`` are kept under their names,
whatever they are, up to the last stage, which drops them; a null in a column that a stage doesn't name
changes nothing.  What a stage does with null texts, ties and repeated rows stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontam, jaccard, langid, suffixes
from graphloom.llm.common import rest, small_batches, table, written


def _prepared(spark: SparkSession) -> None:
    small_batches(spark)
    rest(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a language (null or empty text, no letter) go.  Null languages and held-out rows are never learned
    from, but judged like all others; with no language to learn, rows with a letter stay; repeated rows are judged alike."""
    _prepared(spark)
    return langid.accepted(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at 0.8 or more stays: the one of least doc_id that isn't null (of
    rows with equal id, the one of least hash of text; of repeated rows, any one).  Null and wordless texts all stay."""
    _prepared(spark)
    return jaccard.representatives(docs, n=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that also start elsewhere are cut out of the texts, in all places alike; n_chars follows.
    Null texts and texts under 200 bytes stay as they are; repeated rows are each other's copies; no row goes."""
    _prepared(spark)
    return suffixes.dedup_text(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a copy of a benchmark item, edited or not, go.  Null and empty texts stay; null or empty items, and those
    of under three words, match nothing; repeated items count once."""
    _prepared(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row that is left; a null or empty text has none, repeated rows are coded each by itself."""
    _prepared(spark)
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "n_chars", "text")).drop("text")
    return coded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("bpe_encode", bpe_encode),
]

#: SQL has no form for the language model and the suffix order; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
