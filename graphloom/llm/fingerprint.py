"""Document fingerprints by one-permutation MinHash.

Every word shingle is hashed once.  The top bits of the hash deal it to one of ``BINS`` bins and the
least hash of a bin is its value.  An empty bin is filled by optimal densification: it tries bins in an
order drawn for that bin alone until one was filled by a shingle, and takes that value, so two sets
agree in a bin with probability equal to their resemblance.  The low ``BITS`` bits of each bin are
packed; two unequal bins still agree by chance once in 2**BITS, which ``likeness`` corrects for.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; shingles are five words (fewer
words: the whole sequence).  Defined cases: null text counts as empty; a text without words has the
all-zero fingerprint under a mark of its own, is like another such text (1) and unlike any other (0);
equal texts have equal fingerprints; repeated rows and equal doc_ids are ordered by the hash of their
text; a single document follows itself; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, bucket_of, dealers, id_buckets, order_key, partitions_for, shingles, text_chunks, words
from .pieces import batches_of

BINS, BITS, WORDS = 512, 4, 5


@functools.lru_cache(maxsize=4)
def _tries(bins: int, block: int) -> np.ndarray:
    """Rows 256 * block ... of the bins that each bin tries in turn."""
    rng = np.random.Generator(np.random.PCG64([bins, block]))
    return rng.integers(0, bins, size=(256, bins), dtype=np.int64)


def sketch(h: np.ndarray, bins: int = BINS, bits: int = BITS) -> bytes:
    """Packed fingerprint of a set of shingle hashes (repeats don't matter)."""
    if not len(h):
        return b""
    width = np.uint64(64 - (bins - 1).bit_length())
    s = np.sort(h)
    b = (s >> width).astype(np.int64)
    first = np.empty(len(s), dtype=bool)
    first[0] = True
    np.not_equal(b[1:], b[:-1], out=first[1:])
    value = np.zeros(bins, dtype=np.uint64)
    filled = np.zeros(bins, dtype=bool)
    value[b[first]] = s[first]
    filled[b[first]] = True
    empty = np.flatnonzero(~filled)
    block = 0
    step = 16
    while len(empty):
        t = _tries(bins, block)[:, empty]
        t = t[:step] if block == 0 and step < 256 and len(empty) < bins // 2 else t
        hit = filled[t]
        row = hit.argmax(axis=0)
        ok = hit[row, np.arange(len(empty))]
        value[empty[ok]] = value[t[row[ok], np.flatnonzero(ok)]]
        empty = empty[~ok]
        if len(t) < 256:
            step = 256
        else:
            block += 1
    low = (value & np.uint64((1 << bits) - 1)).astype(np.uint8)
    if bits == 8:
        return low.tobytes()
    if bits == 4:
        return (low[0::2] << 4 | low[1::2]).tobytes()
    return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - bits :]).tobytes()


def sketches(texts: list[str], n: int = WORDS, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    out: list[bytes] = []
    for _, _, buf, offs in text_chunks(pa.array(texts, pa.large_string())):
        h, _, _, counts = words(LOWER[buf], offs, NOT_SPACE)
        g, at = shingles(h, counts, n)
        out += [sketch(g[at[i] : at[i + 1]], bins, bits) for i in range(len(offs) - 1)]
    return out


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated resemblance of two fingerprints, 0 to 1, unbiased but for the clipping at 0."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    x = np.frombuffer(a, dtype=np.uint8) ^ np.frombuffer(b, dtype=np.uint8)
    if bits == 8:
        same = int((x == 0).sum())
    elif bits == 4:
        same = int((x & 15 == 0).sum() + (x & 240 == 0).sum())
    else:
        same = int((np.unpackbits(x)[: bins * bits].reshape(bins, bits).sum(axis=1) == 0).sum())
    chance = 1.0 / (1 << bits)
    return min(1.0, max(0.0, (same / bins - chance) / (1 - chance)))


def as_text(a: bytes, bins: int = BINS, bits: int = BITS) -> str:
    return a.hex() if a else "0" * (bins * bits // 4) + "-"


def edited(text: str, after: str) -> str:
    """``text`` with its last third replaced by as much of the head of ``after``."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows bucket, tail, doc_id, tie, text in partitions sorted so that each row's next document (by descending
    doc_id; after the last the first) is the next row.  A row with tail = 1 is only the successor of its
    bucket's last.  The text is shuffled once; what is collected is the cut values and, for each bucket, its
    greatest doc_id."""
    n = partitions_for(docs)
    key = order_key(docs, "doc_id")
    cuts = id_buckets(docs, key, n)
    at = docs.select((F.lit(len(cuts)) - bucket_of(key, cuts)).alias("bucket"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tops = at.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()
    heads = {r["top"]: tops[i - 1]["bucket"] for i, r in enumerate(tops)}
    target = F.lit(None).cast("int")
    if None in heads:  # a bucket of null ids only
        target = F.when(F.col("doc_id").isNull(), F.lit(heads.pop(None)))
    if heads:
        named = F.create_map(*[x for k, v in heads.items() for x in (F.lit(k).cast(docs.schema["doc_id"].dataType), F.lit(v))])
        target = F.when(F.col("doc_id").isin(list(heads)), F.try_element_at(named, F.col("doc_id"))).otherwise(target)
    both = at.withColumn("h", target)
    own_row = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("tail"))
    tail_row = F.struct(F.col("h").alias("b"), F.lit(1).alias("tail"))
    dealt = both.select(
        F.explode(F.when(F.col("h").isNull(), F.array(own_row)).otherwise(F.array(own_row, tail_row))).alias("x"), "doc_id", "text"
    ).select("x.b", "x.tail", "doc_id", "text")
    return (
        dealt.withColumn("tie", F.xxhash64("text"))
        .withColumn("to", F.element_at(F.array(*[F.lit(x) for x in dealers(len(cuts) + 1)]), F.col("b") + 1))
        .repartition(len(cuts) + 1, "to")
        .sortWithinPartitions("b", "tail", F.desc_nulls_last("doc_id"), "tie")
        .select("b", "tail", "doc_id", "text")
    )


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held: list[tuple] = []  # (bucket, doc_id, text, sketch) of the last row, which waits for its successor
        for batch in batches:
            bs, tails = batch.column("b").to_pylist(), batch.column("tail").to_pylist()
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for lo, hi in batches_of(texts):
                own = sketches(texts[lo:hi], n)
                rows = held + [(bs[lo + i], tails[lo + i], ids[lo + i], texts[lo + i], own[i]) for i in range(hi - lo)]
                pairs = [(a, z) for a, z in zip(rows[:-1], rows[1:], strict=True) if not a[1]]
                held = rows[-1:]
                if not pairs:
                    continue
                made = [edited(a[3], z[3]) for a, z in pairs]
                marks = sketches(made, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[2] for a, _ in pairs], batch.schema.field("doc_id").type),
                        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in made], pa.string()),
                        pa.array([as_text(a[4]) for a, _ in pairs], pa.string()),
                        pa.array([as_text(m) for m in marks], pa.string()),
                        pa.array([likeness(a[4], m) for (a, _), m in zip(pairs, marks, strict=True)], pa.float64()),
                        pa.array([likeness(a[4], z[4]) for a, z in pairs], pa.float64()),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return with_successors(docs).mapInArrow(
        run,
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
