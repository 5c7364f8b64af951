"""Packed exchange: map tasks send numpy records to reduce tasks as one binary value for each target, so that
millions of small rows cost neither row objects nor a row sort; and a Bloom filter of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

MOST = 1 << 16  # bytes of a value: larger ones are awkward for the JVM's heap
PACKED = "part int, kind int, blob binary"


def blobs(kind: int, target: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """A row for each target that has records, or several of about ``MOST`` bytes."""
    order = np.argsort(target, kind="stable")
    t, r = target[order], records[order]
    cut = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
    each = max(1, MOST // records.dtype.itemsize)
    more = -(-np.diff(np.append(cut, len(t))) // each)
    cut = spread(np.zeros(len(cut), np.int64), more) * each + np.repeat(cut, more)
    ends = np.append(cut[1:], len(t))[: len(cut)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(t[cut].astype(np.int32)),
            pa.array(np.full(len(cut), kind, dtype=np.int32)),
            pa.array([r[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
        ],
        names=["part", "kind", "blob"],
    )


def reduced(
    packed: DataFrame, parts: int, dtypes: dict[int, np.dtype], work: Callable[[dict[int, np.ndarray]], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``work`` on the records of each target, by kind; one target is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]):
        now, held = None, {}

        def done():
            return work({k: np.concatenate([np.frombuffer(b, dtype=dtypes[k]) for b in v]) for k, v in held.items()})

        for batch in batches:
            for part, kind, blob in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob"), strict=True):
                if part != now:
                    if held:
                        yield from done()
                    now, held = part, {}
                held.setdefault(kind, []).append(blob.as_py())
        if held:
            yield from done()

    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)


class Bloom:
    """A set of 128-bit keys (two longs) in 2**BITS bits; never denies a member.  Its size doesn't depend on the
    data: with too many keys it lets more through, and the join behind it is exact anyway."""

    BITS, PROBES = 24, 3

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @classmethod
    def places(cls, k1: np.ndarray, k2: np.ndarray) -> list[np.ndarray]:
        a, b = k1.view(np.uint64), k2.view(np.uint64) | np.uint64(1)
        return [((a + np.uint64(i) * b) >> np.uint64(64 - cls.BITS)).astype(np.int64) for i in range(cls.PROBES)]

    @classmethod
    def of(cls, keys: DataFrame, k1: str = "k1", k2: str = "k2") -> "Bloom":
        def bits(batches):
            words = np.zeros(1 << (cls.BITS - 6), dtype=np.uint64)
            for batch in batches:
                for p in cls.places(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)):
                    np.bitwise_or.at(words, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
            some = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(words[some].view(np.int64))], names=["i", "w"])

        rows = keys.select(k1, k2).mapInArrow(bits, "i int, w long").groupBy("i").agg(F.bit_or("w").alias("w")).toPandas()
        words = np.zeros(1 << (cls.BITS - 6), dtype=np.int64)
        words[rows["i"].to_numpy(dtype=np.int64)] = rows["w"].to_numpy(dtype=np.int64)
        return cls(words.view(np.uint64))

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        ok = np.ones(len(k1), dtype=bool)
        for p in self.places(k1, k2):
            ok &= (self.words[p >> 6] >> (p & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return ok

    def filtered(self, df: DataFrame, k1: str = "k1", k2: str = "k2", among: bool = True) -> DataFrame:
        """Rows whose key may be a member (or, with ``among`` false, surely is none).  Only the keys go to Python."""
        shared = df.sparkSession.sparkContext.broadcast(self.words)

        @F.arrow_udf("boolean")
        def member(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array(Bloom(shared.value).holds(a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)))

        ok = member(F.col(k1), F.col(k2))
        return df.where(ok if among else ~ok)


def text_key(column: str) -> tuple:
    """Two 64-bit hashes of a text as columns."""
    return F.xxhash64(column).alias("k1"), F.xxhash64(F.lit(0x5EED), column).alias("k2")
