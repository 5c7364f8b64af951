"""Language identification by prediction by partial matching (PPM, escape method C).

Each language has a variable-order tree of byte contexts.  The probability of a byte is taken in the
longest context that the language's training text holds; a byte never seen there costs that context's
escape probability and is looked up in the context shorter by one byte, down to the uniform order -1.
Statistics are frozen after training, so the whole cost of (context, byte) is a constant; the trees of
all languages are flattened into one table from (context, byte) to one code length per language, and a
text is scored exactly (in 1/1024 bit, as integers) by array look-ups over all its bytes.

Training reads a bounded sample: about ``train_bytes`` of text over all languages together, shared
evenly among them.  Texts are drawn in pieces of at most ``PIECE`` bytes, by a hash of the row and the
piece's number, so a language's share doesn't hang on how long its texts are or how its bytes are dealt
over them; a language that the draw misses is learned from a piece of its first row by hash.  A piece is
counted in the context of the bytes before it.  Counting is distributed; only the table of contexts,
bounded by that number times the orders, goes to the driver.

Defined cases: null text, or text without a letter, gives ``und`` and score 0; with no training rows all
rows get ``und``; null languages are never learned; repeated rows are predicted each by itself; columns
other than doc_id, text and lang are ignored, and lang only ever trains.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, text_chunks

if TYPE_CHECKING:
    import pandas as pd

UND = "und"
ORDER = 4  # bytes of the longest context
PIECE = 1024  # bytes of text that are drawn for training together, at most
UNIT = 1024  # code lengths are integers in 1/1024 bit
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id):
    """Column: the row belongs to the part that is never trained on."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _grams(buf: np.ndarray, offs: np.ndarray, k: int) -> np.ndarray:
    """Key of the k bytes before each byte with the byte itself; a text starts after k zero bytes."""
    key = buf.astype(np.uint64)
    at = np.arange(len(buf)) - np.repeat(offs[:-1], np.diff(offs))
    for j in range(1, k + 1):
        prev = np.zeros(len(buf), dtype=np.uint64)
        prev[j:] = buf[:-j]
        prev[at < j] = 0
        key |= prev << np.uint64(8 * j)
    return key


def _count(lang: np.ndarray, skip: np.ndarray, column: pa.Array, order: int):
    """Batches of lang (a number), k, key, n over texts; the first ``skip`` bytes of each are context only."""
    for lo, hi, buf, offs in text_chunks(column):
        who = np.repeat(np.arange(hi - lo), np.diff(offs))
        told = np.arange(len(buf)) - np.repeat(offs[:-1], np.diff(offs)) >= skip[lo:hi][who]
        own = lang[lo:hi][who]
        for k in range(order + 1):
            g = _grams(buf, offs, k)
            for i in np.unique(lang[lo:hi]):
                u, n = np.unique(g[told & (own == i)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(u), i, np.int32)), pa.array(np.full(len(u), k, np.int32)), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "k", "key", "n"],
                )


def train_counts(docs: DataFrame, order: int = ORDER, train_bytes: int = 2_000_000) -> "pd.DataFrame":
    """lang (categorical), k, key, n: how often each (context of k bytes, byte) stands in the sampled training text."""
    import pandas as pd  # on the driver only: workers keep what they import

    part = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    part = part.where(F.octet_length("text") > 0).select("lang", "text", F.xxhash64(F.lit("ppm"), F.col("doc_id").cast("string"), "text").alias("row"))
    sizes = {r["lang"]: (r["b"], r["first"]) for r in part.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b"), F.min("row").alias("first")).collect()}
    langs = sorted(sizes)
    if not langs:
        return pd.DataFrame({"lang": pd.Categorical([]), "k": [], "key": [], "n": []})
    number = {lang: i for i, lang in enumerate(langs)}
    share = train_bytes / len(sizes)
    piece = max(1, min(PIECE, int(share / 16)))

    def of(values: dict, kind: str):
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")].cast(kind)

    # of a language's pieces that part whose hash is under its share
    cut = of({lang: min(1.0, share / b) for lang, (b, _) in sizes.items()}, "double")
    every = F.sequence(F.lit(0), ((F.octet_length("text") - 1) / piece).cast("int"))
    drawn = F.filter(every, lambda i: F.pmod(F.xxhash64("row", i), F.lit(1 << 52)) / float(1 << 52) < F.col("cut"))
    sample = part.withColumn("cut", cut).withColumn("drawn", drawn).where(F.size("drawn") > 0).select(of(number, "int").alias("lang"), "text", F.explode("drawn").alias("i"))
    skip = F.least(F.lit(order), F.col("i") * piece)
    sample = sample.select("lang", skip.alias("skip"), F.substring(F.col("text").cast("binary"), F.col("i") * piece - skip + 1, piece + skip).alias("text"))

    def count(batches):
        for batch in batches:
            yield from _count(batch.column("lang").to_numpy(), batch.column("skip").to_numpy(), batch.column("text"), order)

    rows = sample.mapInArrow(count, "lang int, k int, key long, n long").groupBy("lang", "k", "key").agg(F.sum("n").alias("n"))
    out = rows.select(F.col("lang").cast("smallint"), F.col("k").cast("tinyint"), "key", F.col("n").cast("int")).toArrow().combine_chunks()
    told = set(out.column("lang").unique().to_pylist())
    missed = {lang: first for lang, (_, first) in sizes.items() if number[lang] not in told}
    if missed:
        rows = part.where(F.col("row") == of(missed, "long")).select("lang", F.substring(F.col("text").cast("binary"), 1, piece).alias("text"))
        rows = rows.groupBy("lang").agg(F.min("text").alias("text")).collect()  # as many as there are such languages
        more = _count(np.array([number[r["lang"]] for r in rows]), np.zeros(len(rows), np.int32), pa.array([bytes(r["text"]) for r in rows], pa.large_binary()), order)
        more = pa.Table.from_batches(more).group_by(["lang", "k", "key"]).aggregate([("n", "sum")]).rename_columns(["lang", "k", "key", "n"])
        out = pa.concat_tables([out, more.cast(out.schema)])
    kept = {c: out.column(c).to_numpy() for c in ("lang", "k", "key", "n")}
    return pd.DataFrame(kept | {"lang": pd.Categorical.from_codes(kept["lang"], langs)})


class Ppm:
    """Frozen statistics of all languages as one hash table per order."""

    def __init__(self, counts: "pd.DataFrame", order: int = ORDER) -> None:
        self.order = order
        told = counts["lang"].astype("category").cat.remove_unused_categories().cat
        self.langs = sorted(told.categories)
        code = np.array([self.langs.index(x) for x in told.categories], dtype=np.int64)[told.codes] if len(counts) else np.zeros(0, np.int64)
        m = len(self.langs)
        self.levels: list[tuple] = []
        uniform = np.full((1, m), 8 * UNIT, dtype=np.int32)  # order -1: 256 bytes alike
        self.base = uniform
        for k in range(order + 1):
            at = (counts["k"] == k).to_numpy()
            c, lang = counts[at], code[at]
            key = c["key"].to_numpy(dtype=np.int64).view(np.uint64)
            n = c["n"].to_numpy(dtype=np.float64)
            ctx = key >> np.uint64(8)
            uc, ci = np.unique(ctx, return_inverse=True)
            ug, gi = np.unique(key, return_inverse=True)
            total, kinds = np.zeros((len(uc), m)), np.zeros((len(uc), m))
            np.add.at(total, (ci, lang), n)
            np.add.at(kinds, (ci, lang), 1)
            seen = total > 0
            esc = np.zeros((len(uc), m))
            esc[seen] = -np.log2((kinds / np.maximum(total + kinds, 1))[seen])  # an unknown context costs nothing
            esc = np.rint(esc * UNIT).astype(np.int32)
            # cost of (context, byte): own if seen in this language, else escape and the lower order
            gctx = np.searchsorted(uc, ug >> np.uint64(8))
            cost = esc[gctx] + self._cost(ug, k - 1)
            own = np.rint(-np.log2(n / (total + kinds)[ci, lang]) * UNIT).astype(np.int32)
            cost[gi, lang] = own
            self.levels.append((_Table(ug), cost, _Table(uc), esc))

    def _cost(self, key: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of (last k bytes, byte), k at most self's built order."""
        if k < 0:
            return np.repeat(self.base, len(key), axis=0)
        mask = np.uint64((1 << (8 * (k + 1))) - 1)
        grams, cost, contexts, esc = self.levels[k]
        key = key & mask
        at = grams.find(key)
        out = cost[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            low = key[miss]
            at = contexts.find(low >> np.uint64(8))
            e = esc[at]
            e[at < 0] = 0
            out[miss] = e + self._cost(low, k - 1)
        return out

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each text in each language, in 1/1024 bit."""
        out = np.zeros((len(offs) - 1, len(self.langs)), dtype=np.int64)
        full = np.flatnonzero(np.diff(offs))
        if len(full):
            cost = self._cost(_grams(buf, offs, self.order), self.order)
            out[full] = np.add.reduceat(cost, offs[full], axis=0, dtype=np.int64)
        return out


class _Table:
    """Open hash table of distinct uint64 keys; find gives the place of a key, or -1."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, dtype=np.int32)
        self.rounds = 0
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(keys)
        last = (1 << bits) - 1
        while len(left):
            self.rounds += 1
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of those that meet, one stays
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & last
        self.held = np.where(self.slot >= 0, keys[self.slot] if len(keys) else 0, 0).astype(np.uint64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        got = self.slot[at]
        out = np.where((self.held[at] == keys) & (got >= 0), got, -1)
        todo = np.flatnonzero((out < 0) & (got >= 0))
        for _ in range(1, self.rounds):
            if not len(todo):
                break
            at_t = (at[todo] + 1) & (len(self.slot) - 1)
            at[todo] = at_t
            got = self.slot[at_t]
            hit = (self.held[at_t] == keys[todo]) & (got >= 0)
            out[todo[hit]] = got[hit]
            todo = todo[~hit & (got >= 0)]
        return out


def fit(docs: DataFrame, order: int = ORDER, train_bytes: int = 2_000_000) -> Ppm:
    model = Ppm(train_counts(docs, order, train_bytes), order)
    give_back()  # the table of counts, on the driver
    return model


def _told(ppm: Ppm, column: pa.Array) -> tuple[list[str], list[float], list[float]]:
    """lang_pred, score and bits of each text."""
    pred, score, bits = [], [], []
    for lo, hi, buf, offs in text_chunks(column):
        if not ppm.langs:
            pred += [UND] * (hi - lo)
            score += [0.0] * (hi - lo)
            bits += [0.0] * (hi - lo)
            continue
        cost = ppm.score(buf, offs) / UNIT
        best = cost.argmin(axis=1)
        least = cost.min(axis=1)
        post = 1.0 / np.exp2(np.maximum(least[:, None] - cost, -1000)).sum(axis=1)
        raw = buf.tobytes()
        for i in range(hi - lo):
            ok = _has_letter(raw[offs[i] : offs[i + 1]])
            pred.append(ppm.langs[best[i]] if ok else UND)
            score.append(float(post[i]) if ok else 0.0)
            bits.append(float(least[i]) if ok else 0.0)
    return pred, score, bits


def predict(docs: DataFrame, model: Ppm, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (posterior of the prediction under equal priors) and bits (its
    code length) added at the end; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "bits")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spark_schema = T.StructType(
        list(docs.schema.fields)
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]
    )

    def run(batches):
        ppm = shared.value
        for batch in batches:
            pred, score, bits = _told(ppm, batch.column(text))
            yield pa.RecordBatch.from_arrays(
                list(batch.columns) + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                names=list(batch.schema.names) + ["lang_pred", "score", "bits"],
            )
        give_back()

    return docs.mapInArrow(run, spark_schema)


_ASCII_LETTER = regex.compile(rb"[A-Za-z]")


def _has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw) or _LETTER.search(raw.decode("utf-8", "replace")))


def identify(docs: DataFrame, order: int = ORDER, train_bytes: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits for every row."""
    model = fit(docs, order, train_bytes)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits"
    )


def accepted(docs: DataFrame, order: int = ORDER, train_bytes: int = 2_000_000) -> DataFrame:
    """The rows of ``docs``, with their columns whatever their names, that get a language; those with null text or without a
    letter go."""
    model = fit(docs, order, train_bytes)
    if not model.langs:  # nothing to learn from: only the letters decide
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    del model

    def run(batches):
        for batch in batches:
            pred, _, _ = _told(shared.value, batch.column("text"))
            yield batch.filter(pa.array([p != UND for p in pred]))
        give_back()

    return docs.mapInArrow(run, docs.schema)
