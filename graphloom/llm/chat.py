"""Chat formatting: collapse cumulative snapshots of a conversation, then render what is left.

Logs often hold the same conversation several times, each snapshot longer than the one before.  A
snapshot whose turns are a proper prefix of another conversation's turns is dropped; of conversations
with the very same turns the one with the least id stays.  Only DataFrame functions are used.

A prefix is named by its length and a rolling 128-bit hash of its turns: two lanes of xxhash64 over
(place, role, text), folded by xor in a running window, so a longer prefix costs one more step and no
turn list is collected for it.

Defined cases: turns are ordered by (turn, role, text) with nulls first and numbered from 1, so ties,
gaps and repeated rows have one order; a null role counts as ``user`` and a null text as empty; rows
with a null conv_id are one conversation with a null id; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")


def turns_with_prefix(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, role, text, h1, h2: each turn with the hash of the prefix that ends in it."""
    t = conversations.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("user")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("pos", F.row_number().over(order))
    one = [F.xxhash64(F.lit(seed), "pos", F.length("role"), "role", "text") for seed in (17, 9973)]
    run = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumns({"g1": one[0], "g2": one[1]})
    return t.withColumns({"h1": F.bit_xor("g1").over(run), "h2": F.bit_xor("g2").over(run)}).drop("g1", "g2", "turn")


def maximal(conversations: DataFrame) -> DataFrame:
    """One row for each conversation that stays: conv_id, n_turns, n_same (conversations with exactly
    these turns, itself included), h1, h2."""
    t = turns_with_prefix(conversations)
    ends = t.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("e")).select("conv_id", "e.*")
    whole = ends.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    size = Window.partitionBy("conv_id")
    inner = t.withColumn("n", F.max("pos").over(size)).where("pos < n").select("pos", "h1", "h2").distinct()
    return whole.join(inner, ["pos", "h1", "h2"], "left_anti").select(
        "conv_id", F.col("pos").alias("n_turns"), "n_same", "h1", "h2"
    )


def collapse_and_render(conversations: DataFrame, header: str = "<|{role}|>\n", end: str = "\n<|end|>\n") -> DataFrame:
    """conv_id, n_turns, n_same (conversations with exactly these turns), n_chars, rendered: the kept
    conversations as text, each turn as ``header`` with its role, its text and ``end``."""
    keep = maximal(conversations).select("conv_id", "n_turns", "n_same")
    before, after = header.split("{role}")
    t = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    kept = t.join(keep, t.conv_id.eqNullSafe(keep.conv_id), "left_semi")
    lines = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    text = F.array_join(F.transform("ts", lambda x: F.concat(F.lit(before), x["role"], F.lit(after), x["text"], F.lit(end))), "")
    r = lines.select(F.col("conv_id").alias("c"), text.alias("rendered"))
    return (
        keep.join(r, keep.conv_id.eqNullSafe(r.c), "inner")
        .select("conv_id", "n_turns", "n_same", F.length("rendered").cast("long").alias("n_chars"), "rendered")
    )
