"""Mixing sources to target weights by weighted fair queueing.

Each source has a target of words: sources share the budget by weight, none beyond ``most`` times its own words, and
what one can't use is shared again by weight.  Inside a source the documents are shuffled by a hash; a document's virtual
finish time is the sum of its source's words up to its end over the source's target, so all sources reach 1 at their targets.
All copies that start before 1 are sorted by finish time over the whole table, and the queue is cut where its words pass the budget.
A source with a target above its own words starts again in the same order, so a document's copies lie a whole round
apart.  Sums run over range partitions (``operators.prefix``): a source that holds most rows is no task of its own.

Defined cases: a null or wordless text has size 0 and is taken 0 times; null is a source, the last; rows are documents, whatever their
doc_id, and repeated rows count each; ties in the order can only be rows alike, which may swap; an empty table gives no rows;
columns that ``keep`` doesn't name aren't read, those that it names come back under their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import prefix_sums
from .common import written

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2) -> tuple[DataFrame, int]:
    """sized(source, size) -> (source, nth, weight, source_size, target), and the number of all words.  Sources take the weights by turns, by code
    point, null last.  With caps c in the order of c / weight, the common rate is the greatest of (budget - caps before) / (weights
    from here on): sources before it are full, those from it on get weight times rate."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = prefix_sums(s, {"nth": "1L"}, [F.asc_nulls_last("source")])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    s = written(prefix_sums(s, {"caps": "cap", "weights": "weight"}, [F.col("cap") / F.col("weight"), F.col("nth")]), "mix-sources")
    one = s.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("w")).first()
    words, w = one["words"] or 0, one["w"] or 0
    budget = min(percent * words, 100 * most * words) / 100
    rate = s.agg(F.max((F.lit(budget) - (F.col("caps") - F.col("cap"))) / (F.lit(w) - (F.col("weights") - F.col("weight"))))).first()[0]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(rate or 0.0))
    return s.select("source", "nth", "weight", "source_size", target.alias("target")), words


def _laid(docs: DataFrame, keep: Sequence[str], weights: Sequence[int], percent: int, most: int, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """Documents with their place in their source and its target; the queue up to the budget, in (finish, nth, place, copy); all words."""
    shuffled = F.md5(F.concat_ws("\n", F.lit(seed).cast("string"), F.col("doc_id").cast("string"), "text"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    sized = written(docs.select(F.struct(*keep).alias("row"), "source", size.alias("size"), shuffled.alias("h")), "mix-sized")
    targets, words = source_targets(sized, weights, percent, most)
    placed = prefix_sums(sized, {"cum": "size", "place": "1L"}, ["h", "size"], by=["source"])
    laid = placed.join(targets, placed["source"].eqNullSafe(targets["source"])).select("row", "size", "cum", "place", "nth", "source_size", "target")
    laid = written(laid, "mix-laid")
    copies = laid.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    end = F.col("cum") + F.col("copy") * F.col("source_size")
    queue = copies.where((F.col("size") > 0) & (end - F.col("size") < F.col("target"))).withColumn("finish", end / F.col("target"))
    queue = prefix_sums(queue, {"passed": "size"}, ["finish", "nth", "place", "copy"])
    return laid, queue.where(F.col("passed") * 100 <= percent * words), words


def sequence(docs: DataFrame, keep: Sequence[str] | None = None, weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2, seed: int = 13) -> DataFrame:
    """The mix itself: a row for each copy that is taken, with the columns of ``keep`` (all of them unless given), ``finish``, and
    ``passed``, the words of the mix up to its end, by which the rows are ordered over the whole table."""
    keep = docs.columns if keep is None else keep
    _, queue, _ = _laid(docs, keep, weights, percent, most, seed)
    return queue.select(F.struct("row", "finish", "passed").alias("m")).select(*[F.col("m.row").getField(c).alias(c) for c in keep], F.col("m.finish").alias("mix_finish"), F.col("m.passed").alias("mix_passed")).orderBy("mix_passed")


def mix(docs: DataFrame, keep: Sequence[str] = ("doc_id",), weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2, seed: int = 13) -> DataFrame:
    """All documents: the columns of ``keep``, size, source_size, target (its source's), taken (size times the copies in the mix)."""
    laid, queue, _ = _laid(docs, keep, weights, percent, most, seed)
    last = queue.agg(F.max(F.struct("finish", "nth", "place", "copy")).alias("k")).first()["k"]  # where the queue is cut

    def copy(k: int) -> Column:
        end = F.col("cum") + k * F.col("source_size")
        key = F.struct((end / F.col("target")).alias("finish"), F.col("nth").alias("nth"), F.col("place").alias("place"), F.lit(k).alias("copy"))
        cut = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["nth"]).cast("long").alias("nth"), F.lit(last["place"]).cast("long").alias("place"), F.lit(last["copy"]).alias("copy"))
        return F.when((F.col("size") > 0) & (end - F.col("size") < F.col("target")) & (key <= cut), 1).otherwise(0)

    copies = F.lit(0)
    for k in range(most if last is not None else 0):
        copies = copies + copy(k)
    return laid.select(*[F.col("row").getField(c).alias(c) for c in keep], "size", "source_size", "target", (F.col("size") * copies).alias("taken"))
