"""Source divergence audit: how far each source of a language is from each other one, and by which terms.

An inverted index holds, for each kept term of a language, the sources that have it.  A pair of sources starts at V times the
value that two zero counts give; what the index emits are corrections to that start, none where a correction is zero: one for each
term that both have, and, as a term that only one has depends on its count alone, one for each count of a source, times its terms.
A term in more than ``BLOCK`` sources is cut into blocks of sources, and each two blocks are a row of their own.

All arithmetic is on whole numbers.  Counting is the only Python: words of each text by bytes, summed up in the task
before the first shuffle, in pieces of a text and with a bound on what is held.

Defined cases: null text, lang and source count as ''; rows are documents, whatever their doc_id, and repeated rows count each; a language
without kept terms has V = 0, pairs of value 0 and no terms; a language of one source has no pairs; ties rank by the item's
UTF-8; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, written

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
NO_TERM = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
PIECE = 1 << 20  # bytes of a text that are taken apart at a time
HELD = 200_000  # entries that a task sums up before it sends them
BLOCK = 512  # sources of a term in one row
SALT = 64  # parts of a language's sources and counts
BILLION = 1_000_000_000


def _pieces(text: bytes):
    at = 0
    while at < len(text):
        end = NO_TERM.search(text, at + PIECE)
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a source's texts and how many of them have it."""

    def counted(batches):
        groups: dict[tuple, tuple[Counter, Counter]] = {}

        def sent():
            for (lang, source), (n, d) in groups.items():
                words = list(n)
                for lo in range(0, len(words), 20_000):
                    some = words[lo : lo + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array([w.decode() for w in some], pa.string()), pa.array([n[w] for w in some], pa.int64()), pa.array([d[w] for w in some], pa.int64())],
                        names=["lang", "source", "term", "n", "docs"],
                    )
            groups.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
                n, d = groups.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                seen: set[bytes] = set()
                for piece in _pieces(text.as_py().encode()):
                    found = TERM.findall(piece.lower())
                    n.update(found)
                    seen.update(found)
                d.update(seen)
                held += len(n)
                if held > HELD:
                    yield from sent()
                    held = 0
        yield from sent()
        give_back()

    some = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    raw = some.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, v: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + V)); the product is a decimal of 38 digits."""
    return F.expr(f"1 + CAST({count} + 1 AS DECIMAL(28, 0)) * {BILLION} div CAST({total} + {v} AS DECIMAL(28, 0))").cast("long")


def apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _index(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Postings (lang, source, term, n, total, nth, of) of kept terms, and the groups (lang, source, id, p0, p of the language's...)."""
    term = Window.partitionBy("lang", "term")
    all_of = term_counts(docs).withColumns({"total": F.sum("n").over(term), "seen": F.sum("docs").over(term)})
    kept = all_of.where(F.col("seen") >= least).withColumns({"nth": F.row_number().over(term.orderBy("source")), "of": F.count("*").over(term)})
    kept = written(kept.select("lang", "source", "term", "n", "total", "nth", "of"), "divergence-kept")
    per_lang = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum((F.col("nth") == 1).cast("long")).alias("v"))
    per_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = groups.join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0, ["n_source", "n_lang", "v"])
    groups = groups.withColumn("id", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
    zero = F.when(F.col("v") > 0, share("0", "n_source", "v")).otherwise(0)
    return kept, written(groups.withColumn("p0", zero), "divergence-groups")


def _pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language."""
    # every pair at its start
    a = groups.select("lang", F.col("source").alias("source"), F.col("id").alias("a"), F.col("p0").alias("pa"), "v", F.pmod(F.col("id"), F.lit(SALT)).alias("salt"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    every = groups.select("lang", F.col("source").alias("item"), F.col("id").alias("b"), F.col("p0").alias("pb"), salts)
    start = a.join(every, ["lang", "salt"]).where("a <> b").select("lang", "a", "b", F.expr(f"CASE WHEN v > 0 THEN v * {apart('pa', 'pb')} ELSE 0L END").alias("value"), "source", "item")
    # a count of one source against none of the other, times its terms
    counts = postings.groupBy("lang", "id", "p", "p0").agg(F.count("*").alias("h")).withColumn("salt", F.pmod(F.xxhash64("id", "p"), F.lit(SALT)).cast("int"))
    other = counts.join(every.select("lang", "salt", "b", "pb"), ["lang", "salt"]).where("id <> b")
    fixes = F.array(
        F.struct(F.col("id").alias("a"), F.col("b").alias("b"), F.expr(f"h * ({apart('p', 'pb')} - {apart('p0', 'pb')})").alias("value")),
        F.struct(F.col("b").alias("a"), F.col("id").alias("b"), F.expr(f"h * ({apart('pb', 'p')} - {apart('pb', 'p0')})").alias("value")),
    )
    single = other.select("lang", F.explode(fixes).alias("f")).select("lang", "f.a", "f.b", "f.value").where("value <> 0")
    # a term that both have: what the two corrections above got wrong
    blocks = postings.withColumn("block", F.expr(f"(nth - 1) div {BLOCK}")).groupBy("lang", "term", "block").agg(F.max("of").alias("of"), F.collect_list(F.struct("id", "p", "p0")).alias("xs"))
    blocks = written(blocks, "divergence-blocks")
    wide = blocks.where(F.col("of") > BLOCK).select("lang", "term", "block", "xs")
    far = wide.join(wide.select("lang", "term", F.col("block").alias("other"), F.col("xs").alias("ys")), ["lang", "term"]).where("block <> other")
    met = blocks.select("lang", "xs", F.col("xs").alias("ys")).unionByName(far.select("lang", "xs", "ys").hint("rebalance"))
    met = met.select("lang", F.explode("xs").alias("x"), "ys").select("lang", "x", F.explode("ys").alias("y")).where("x.id <> y.id")
    fix = f"{apart('x.p', 'y.p')} - {apart('x.p', 'y.p0')} - {apart('x.p0', 'y.p')} + {apart('x.p0', 'y.p0')}"
    both = met.select("lang", F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.expr(fix).alias("value")).where("value <> 0")
    both = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    single = single.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    none = [F.lit(None).cast("string").alias(c) for c in ("source", "item")]
    parts = start.unionByName(single.select("*", *none)).unionByName(both.select("*", *none))
    out = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.max("source").alias("source"), F.max("item").alias("item"))
    return out.select("lang", "source", "item", "value")


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has all other sources of the language, part ``term`` the ``top`` terms that a source has
    more of than its language."""
    kept, groups = _index(docs, least)
    near = groups.select("lang", "source", "id", "n_source", "n_lang", "v", "p0")
    postings = kept.join(near, ["lang", "source"]).withColumn("p", share("n", "n_source", "v"))
    terms = postings.withColumn("q", share("total", "n_lang", "v")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value"))
    pairs = _pairs(postings, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
