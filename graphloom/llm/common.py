"""Shared pieces of the training-data operators: vectorised word hashing over
Arrow string buffers, cluster-safe cutting of lineage, ordered buckets and
connected components.

Words are hashed with a polynomial over a random byte table modulo 2**64, so a
whole batch of texts is hashed by a few array operations; no Python object is
made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 18  # bytes of text that are hashed at a time: the work arrays are some twenty times as large


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- lineage


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Where none is named, one is made if driver and executors are one process
    (tests); on a cluster that is an error, for a folder of one machine would lose data silently."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost
    executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """At the end of a task: return freed memory to the system, for the worker process goes on to other work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def rest(spark: SparkSession) -> None:
    """Between stages: a collection on every core's executor, some tenths of a second each, for a JVM that is never asked
    keeps the heap of its largest stage, while Python workers beside it need memory in the next."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts are long: fewer rows at a time than the defaults (10,000 in an Arrow batch, 4,096 of a Parquet reader, whose
    arrays for texts are large), unless the session has fewer still.  For a session that works on texts."""
    for key, least in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"), ("spark.sql.parquet.columnarReaderBatchSize", "4096")):
        if not 0 < int(spark.conf.get(key, least)) <= rows:
            spark.conf.set(key, str(rows))


def partitions_for(df: DataFrame, least: int = 1) -> int:
    spark = df.sparkSession
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# ---------------------------------------------------------------- hashing


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix = _splitmix
_BYTE = _splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_M = 0x5851F42D4C957F2D
_MINV = pow(_M, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for m in (_M, _MINV):
        a = np.full(n, m, dtype=np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK * 2
    while size < n:
        size *= 2
    return _powers(size)


def class_table(pattern_ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for each byte inside one of the (first, last) ranges."""
    t = np.zeros(256, dtype=bool)
    for a, b in pattern_ranges:
        t[a : b + 1] = True
    return t


#: Bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~class_table([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = ~class_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def text_chunks(column: pa.Array, target: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``target`` bytes;
    a longer text comes alone.  Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + target, side="right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end of each word (maximal run of ``inside`` bytes in one text) and, per text,
    the number of words before it (n + 1 values)."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offs), np.int64)
    m = inside[buf]
    start = m.copy()
    start[1:] &= ~m[:-1]
    first = offs[:-1][offs[:-1] < offs[1:]]  # of texts that have bytes
    start[first] = m[first]
    end = np.zeros(len(buf) + 1, dtype=bool)
    end[1:] = m
    end[1:-1] &= ~m[1:]
    bound = first[first > 0]
    end[bound] = m[bound - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    p, inv = powers(len(buf) + 1)
    c = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * p[: len(buf)], out=c[1:])
    h = _splitmix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64))
    return h, s, e, np.searchsorted(s, offs)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], ..."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def shingles(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a text (a text with fewer words has one shingle, its
    whole sequence; one without words has none), in order of place, and the number before each text."""
    per = np.diff(counts)
    made = np.where(per >= n, per - n + 1, (per > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(out_at[-1], dtype=np.uint64)
    if len(h) >= n:
        roll = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            roll = roll * np.uint64(_M) + h[k : len(h) - n + 1 + k]
        roll = _splitmix(roll)
        full = np.flatnonzero(per >= n)
        if len(full):
            src = np.repeat(counts[full] - out_at[full], made[full])
            dst = np.repeat(out_at[full], made[full]) + (np.arange(made[full].sum()) - np.repeat(np.cumsum(made[full]) - made[full], made[full]))
            out[dst] = roll[dst + src]
    for d in np.flatnonzero((per > 0) & (per < n)):
        v = np.uint64(int(per[d]))
        for x in h[counts[d] : counts[d + 1]]:
            v = np.uint64((int(v) * _M + int(x)) & 0xFFFFFFFFFFFFFFFF)
        out[out_at[d]] = _splitmix(np.array([v], dtype=np.uint64))[0]
    return out, out_at


def hash_bytes(word: bytes) -> int:
    """The hash that ``words`` gives one word."""
    b = np.frombuffer(word, dtype=np.uint8)
    h, _, _, _ = words(b, np.array([0, len(b)]), np.ones(256, dtype=bool))
    return int(h[0])


def as_signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


# ---------------------------------------------------------------- order


def order_key(docs: DataFrame, key: str) -> Column:
    """A long that rises with the key (not strictly): the number itself, or of a string the seven bytes after what all
    values begin with."""
    kind = docs.schema[key].dataType
    if isinstance(kind, T.NumericType):
        return F.col(key).cast("long")
    ends = docs.agg(F.min(key), F.max(key)).first()
    same = len(os.path.commonprefix([str(x or "").encode() for x in ends]))
    return F.conv(F.rpad(F.hex(F.substring(F.col(key).cast("string").cast("binary"), same + 1, 7)), 14, "0"), 16, 10).cast("long")


def id_buckets(ids: DataFrame, key: Column, n: int) -> list[int]:
    """At most n - 1 cut values (n is the caller's number of partitions) that deal the rows out evenly
    by ``key``; reads that column only."""
    if n <= 1:
        return []
    probs = [i / n for i in range(1, n)]
    cuts = ids.select(F.percentile_approx(key, F.lit(probs), F.lit(max(10_000, 20 * n)))).first()[0]
    return sorted(set(cuts or []))


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """The number of cuts below or at the value, by the JVM; null goes to bucket 0."""

    def search(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= F.lit(cuts[mid]).cast("long"), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(cuts))


def _murmur3(x: int) -> int:
    """Spark's hash of one int (Murmur3, 32 bits, seed 42)."""
    word = 0xFFFFFFFF

    def turn(v: int, by: int) -> int:
        return (v << by | v >> 32 - by) & word

    h = 42 ^ turn(x * 0xCC9E2D51 & word, 15) * 0x1B873593 & word
    h = (turn(h, 13) * 5 + 0xE6546B64 & word) ^ 4
    h = (h ^ h >> 16) * 0x85EBCA6B & word
    h = (h ^ h >> 13) * 0xC2B2AE35 & word
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@functools.lru_cache(maxsize=8)
def dealers(n: int) -> tuple[int, ...]:
    """For each bucket below n an int that repartition(n, int) sends to a partition of its own."""
    found: dict[int, int] = {}
    x = 0
    while len(found) < n:
        found.setdefault(_murmur3(x) % n, x)
        x += 1
    return tuple(found[b] for b in range(n))


# ---------------------------------------------------------------- components


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an undirected edge table; root is the least node reachable.
    Alternates large-star and small-star steps, each an aggregation with map-side combine; what is
    collected per node is a minimum, never a neighbour list.  Ends when every node hangs on one root, however many rounds that takes.  Self loops and repeated edges are allowed."""
    e = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc"
    )
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        # large star: every larger neighbour of u is linked to the least of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct(), "cc")
        # settled when each node hangs on one root: then no node is linked twice and no root is linked itself
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("links")).union(e.select(F.col("v").alias("x"), F.lit(0).alias("links")).distinct())
        held = ends.groupBy("x").agg(F.sum("links").alias("links"), F.count("*").alias("rows"))
        if held.where("links > 1 OR links = 1 AND rows > 1").isEmpty():
            break
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
