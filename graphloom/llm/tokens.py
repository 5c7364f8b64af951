"""Token ids in binary files: a wavelet matrix for each shard.

A shard holds the ids of consecutive documents (ascending doc_id).  Its ids are stored as bit-planes from
the high bit down; after each plane the ids are parted stably, zeros before ones.  The file holds the planes in blocks
compressed one by one, and a rank directory: the ones before each ``STEP`` bits of each plane.  With it the file
answers ``access`` (the id at a place), ``rank`` (how often an id stands before a place), ``count`` and
``select`` (the place of its k-th occurrence) by unpacking the blocks that they touch and no more.  Spark writes the
files as rows of a Parquet table in the shared folder, so that a lost executor leaves no half-written file and any
store that Spark reaches will do.

A text that holds an added token of the vocabulary (``<|endoftext|>``) gets that token's id there, as the library does.

Defined cases: null text counts as empty, which is the end id alone; repeated rows are stored each by
itself (equal doc_ids in order of text); null doc_ids come first; extra columns are ignored; an empty
table has no shard and reads back as no row.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import bucket_of, dealers, id_buckets, order_key, partitions_for, written
from .pieces import PieceCoder, batches_of

MAGIC = b"GLWM2\0"
BLOCK = 1 << 15  # bytes of a plane that are compressed together
STEP = 4096  # bits between two entries of the rank directory; divides a block
CACHED = 64  # blocks of a file that are kept unpacked
SHARD_TOKENS = 1 << 20
END_ID = 2
TEXTS = 1 << 24  # characters that are coded at a time


class Wavelet:
    """Immutable wavelet matrix over unsigned ids below 2**bits.

    ``block(level, k)`` gives the k-th ``BLOCK`` bytes of a plane and ``ones[level]`` the ones before each ``STEP`` bits of it,
    so a rank reads one number and counts in at most ``STEP`` bits of one block."""

    def __init__(self, n: int, zeros: list[int], ones: np.ndarray, block: Callable[[int, int], np.ndarray]) -> None:
        self.n, self.bits, self.zeros, self.ones, self.block = n, len(zeros), zeros, ones, block

    @classmethod
    def of(cls, ids: np.ndarray, bits: int | None = None) -> "Wavelet":
        top = int(ids.max()) if len(ids) else 0
        bits = bits or max(1, top.bit_length())
        v = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (v & v.dtype.type(1 << b)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            low = np.compress(~one, v)
            zeros.append(len(low))
            v = np.concatenate((low, np.compress(one, v)))
        steps = -(-len(planes[0]) * 8 // STEP) + 1
        ones = np.zeros((bits, steps + 1), dtype=np.uint32)
        for level, p in enumerate(planes):
            pad = np.zeros(steps * STEP // 8, dtype=np.uint8)
            pad[: len(p)] = p
            np.cumsum(np.bitwise_count(pad.view(np.uint64)).reshape(steps, -1).sum(axis=1, dtype=np.uint32), out=ones[level, 1:])
        return cls(len(ids), zeros, ones, lambda level, k: planes[level][k * BLOCK : (k + 1) * BLOCK])

    def plane(self, level: int) -> np.ndarray:
        return np.concatenate([self.block(level, k) for k in range(-(-self.n // (8 * BLOCK)))] or [np.zeros(0, np.uint8)])

    def decode(self) -> np.ndarray:
        """All ids in order: the planes undone from the last up."""
        v = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.plane(level), count=self.n, bitorder="little").view(bool)
            z = self.zeros[level]
            up = np.empty_like(v)
            up[np.flatnonzero(~one)] = v[:z]
            up[np.flatnonzero(one)] = v[z:] | v.dtype.type(1 << (self.bits - 1 - level))
            v = up
        return v

    def _bit(self, level: int, i: int) -> int:
        k, at = divmod(i >> 3, BLOCK)
        return int(self.block(level, k)[at]) >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        step, rest = divmod(i, STEP)
        got = int(self.ones[level, step])
        if rest:
            k, at = divmod(step * STEP // 8, BLOCK)
            part = int.from_bytes(self.block(level, k)[at : at + STEP // 8].tobytes(), "little")
            got += (part & ((1 << rest) - 1)).bit_count()
        return got

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for level in range(self.bits):
            one = self._bit(level, i)
            r = self._ones(level, i)
            i = self.zeros[level] + r if one else i - r
            v = v << 1 | one
        return v

    def _range(self, symbol: int, i: int, j: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, i), self._ones(level, j)
            if symbol >> (self.bits - 1 - level) & 1:
                i, j = self.zeros[level] + a, self.zeros[level] + b
            else:
                i, j = i - a, j - b
        return i, j

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences before place i."""
        return self.count(symbol, 0, i)

    def count(self, symbol: int, i: int = 0, j: int | None = None) -> int:
        if symbol >> self.bits:
            return 0
        a, b = self._range(symbol, i, self.n if j is None else j)
        return b - a

    def _place(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th such bit of a plane, from 0: a search in the directory, then in one step's bits."""
        before = self.ones[level].astype(np.int64)
        before = before if bit else np.arange(len(before)) * STEP - before
        step = int(np.searchsorted(before, k, side="right")) - 1
        b, at = divmod(step * STEP // 8, BLOCK)
        own = np.unpackbits(self.block(level, b)[at : at + STEP // 8], bitorder="little")
        return step * STEP + int(np.flatnonzero(own == bit)[k - int(before[step])])

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th occurrence, from 0."""
        if k < 0 or k >= self.count(symbol):
            raise IndexError(k)
        at = self._range(symbol, 0, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = symbol >> (self.bits - 1 - level) & 1
            at = self._place(level, one, at - self.zeros[level] if one else at)
        return at

    def places(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]


def to_file(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> bytes:
    """The head (sizes, documents), the rank directory and each block of each plane, compressed one by one."""
    w = Wavelet.of(ids)
    press = zstandard.ZstdCompressor(level=1).compress
    blocks = [press(w.block(level, k).tobytes()) for level in range(w.bits) for k in range(-(-w.n // (8 * BLOCK)))]
    head = press(json.dumps({"n": w.n, "zeros": w.zeros, "docs": doc_ids, "lengths": lengths, "blocks": [len(x) for x in blocks]}).encode())
    ones = press(w.ones.astype("<u4").tobytes())
    return b"".join([MAGIC, struct.pack("<II", len(head), len(ones)), head, ones, *blocks])


def from_file(raw: bytes) -> tuple[Wavelet, list, list[int]]:
    """Only the head and the directory are read; a block is when it is asked for, and the last ``CACHED`` are kept."""
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token shard")
    a, b = struct.unpack_from("<II", raw, len(MAGIC))
    at = len(MAGIC) + 8
    unpress = zstandard.ZstdDecompressor().decompress
    head = json.loads(unpress(raw[at : at + a]))
    zeros = head["zeros"]
    ones = np.frombuffer(unpress(raw[at + a : at + a + b]), dtype="<u4").reshape(len(zeros), -1)
    ends = np.cumsum([0, *head["blocks"]]) + at + a + b
    each = len(head["blocks"]) // len(zeros)

    @functools.lru_cache(maxsize=CACHED)
    def block(level: int, k: int) -> np.ndarray:
        i = level * each + k
        return np.frombuffer(unpress(raw[ends[i] : ends[i + 1]]), dtype=np.uint8)

    return Wavelet(head["n"], zeros, ones, block), head["docs"], head["lengths"]


@functools.lru_cache(maxsize=2)
def _coder(path: str) -> PieceCoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    added = tok.get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in added.values()):
        raise ValueError("added tokens that take in white space or depend on it can't be told from pieces")
    # a byte-level token has a character for each of its bytes; an added one is its own text, and begins and ends pieces
    # of its own inside one of ours, as it does inside a text
    vocabulary = tok.get_vocab()
    size = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
    for t, i in vocabulary.items():
        size[i] = len(added[i].content.encode()) if i in added else len(t)

    def new(first: list[str], later: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces with a space before them are coded in rows of a thousand, for speed: such a piece begins a token wherever
        it stands, so lengths in bytes tell whose each token is."""
        out = [np.array(e.ids, dtype=np.int32) for e in tok.encode_batch_fast(first, add_special_tokens=False)] if first else []
        count = np.array([len(x) for x in out], dtype=np.int64)
        rows = ["".join(later[lo : lo + 1000]) for lo in range(0, len(later), 1000)]
        tail = [np.array(e.ids, dtype=np.int32) for lo in range(0, len(rows), 64) for e in tok.encode_batch_fast(rows[lo : lo + 64], add_special_tokens=False)]
        if not tail:
            return np.concatenate([*out, np.zeros(0, np.int32)]), count
        ids = np.concatenate(tail)
        ends = np.cumsum(pc.binary_length(pa.array(later, pa.large_string())).to_numpy())
        of = np.searchsorted(ends, np.cumsum(size[ids]), side="left")
        return np.concatenate([*out, ids]), np.concatenate((count, np.bincount(of, minlength=len(later))))

    return PieceCoder(new)


def shards(docs: DataFrame, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """bucket, shard, before (ids of the bucket in earlier shards), n_docs, n_tokens, payload: the files."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    n = partitions_for(docs)
    key = order_key(docs, "doc_id")
    cuts = id_buckets(docs, key, n)
    dealt = (
        docs.select(bucket_of(key, cuts).alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("to", F.element_at(F.array(*[F.lit(x) for x in dealers(len(cuts) + 1)]), F.col("bucket") + 1))
        .repartition(len(cuts) + 1, "to")
        .sortWithinPartitions("bucket", "doc_id", "text")
        .select("bucket", "doc_id", "text")
    )

    def run(batches):
        coder = _coder(tokenizer)
        bucket, shard, before, size = None, 0, 0, 0
        parts: list[np.ndarray] = []
        ids: list = []
        lengths: list[int] = []

        def flush():
            nonlocal shard, before, size, parts, ids, lengths
            if not ids:
                return None
            payload = to_file(np.concatenate(parts), ids, lengths)
            row = pa.RecordBatch.from_pylist(
                [{"bucket": bucket, "shard": shard, "before": before, "n_docs": len(ids), "n_tokens": size, "payload": payload}],
                schema=pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())]),
            )
            shard, before, size = shard + 1, before + size, 0
            parts, ids, lengths = [], [], []
            return row

        for batch in batches:
            bs, ds, texts = batch.column("bucket").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for lo, hi in batches_of(texts, TEXTS):
                flat, at = coder.encode(texts[lo:hi])
                for i in range(hi - lo):
                    if bs[lo + i] != bucket or size >= shard_tokens:
                        if (row := flush()) is not None:
                            yield row
                        if bs[lo + i] != bucket:
                            bucket, shard, before = bs[lo + i], 0, 0
                    own = flat[at[i] : at[i + 1]]
                    parts += [own, np.array([end_id], dtype=own.dtype)]
                    ids.append(ds[lo + i])
                    lengths.append(len(own) + 1)
                    size += len(own) + 1
        if (row := flush()) is not None:
            yield row

    return dealt.mapInArrow(run, "bucket int, shard int, before long, n_docs long, n_tokens long, payload binary")


def read_documents(files: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    spark = files.sparkSession
    kind = to_arrow_type(id_type or T.LongType())
    sizes = files.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).orderBy("bucket").collect()  # a row for each partition
    total, base = 0, []
    for r in sizes:
        base.append((r["bucket"], total))
        total += r["n"]
    starts = spark.createDataFrame(base, "bucket int, base long")

    def run(batches):
        for batch in batches:
            for at, raw in zip(batch.column("at").to_pylist(), batch.column("payload"), strict=True):
                wavelet, docs, lengths = from_file(raw.as_py())
                ids = wavelet.decode().astype("<u4")
                ends = np.cumsum(lengths)
                begins = ends - np.array(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, kind),
                        pa.array(begins + at, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(begins, ends, strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = files.join(F.broadcast(starts), "bucket").select((F.col("before") + F.col("base")).alias("at"), "payload")
    return placed.mapInArrow(run, f"doc_id {(id_type or T.LongType()).simpleString()}, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    return read_documents(written(shards(docs, tokenizer, shard_tokens), "tokens"), docs.schema["doc_id"].dataType)
