"""Embedding whitening: one pass of mergeable statistics over the distinct vectors, an eigendecomposition of a matrix of
dimension by dimension on the driver, a second pass that checks the identity, and the projection of every row.

Statistics are Chan's: a task has a count, sums and the scatter of its vectors about their own mean; two of them merge by
adding scatters and the outer product of the difference of their means.  Vectors are integers (steps of 1 / ``scale``), so
sums and differences n * x - S are exact and no digit is lost to a large common offset.

Defined cases: a null vector and one with a null, NaN or infinite entry gives no row; equal vectors count once in the fit,
and every row has its own results; vectors of different lengths are fitted apart, each length by itself; an empty vector has no
components; a direction without variance has whitened null and explained 0 and no part in identity_error; deviation is null if
it doesn't fit a long; null and repeated keys, and an empty table, need no care; extra columns aren't read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, written

SCALE = 256
ROWS = 1 << 19  # entries of a matrix that is worked on at a time

State = dict[int, tuple[int, np.ndarray, np.ndarray]]  # dimension -> count, sums, scatter about the mean


def entries(vector: Column, scale: int = SCALE) -> Column:
    """The vector as longs floor(scale * c); null if it, or an entry of it, is null or not finite."""
    as_double = F.transform(vector, lambda c: c.cast("double"))
    odd = F.exists(as_double, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    return F.when(~odd, F.transform(as_double, lambda c: F.floor(c * float(scale))))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of longs) of lists of one length, some rows at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets, dtype=np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        step = max(1, ROWS // max(1, int(d)))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            yield some, flat[offsets[some][:, None] + np.arange(d)]


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: as longs, or as Python's integers where longs would overflow."""
    most = max([1, *(abs(int(v)) for v in (x.max(initial=0), x.min(initial=0)))])
    if n * most < 1 << 61 and max([0, *(abs(int(v)) for v in sums)]) < 1 << 61:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums.astype(object)


def local(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    n = len(x)
    small = max([0, *(abs(int(v)) for v in (x.max(initial=0), x.min(initial=0)))]) * max(n, 1) < 1 << 62
    sums = (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)
    centred = (deviations(x, n, sums) / n).astype(np.float64)
    return n, sums, centred.T @ centred


def merge_two(a: tuple, b: tuple) -> tuple:
    (na, sa, ma), (nb, sb, mb) = a, b
    apart = np.asarray((sb * na - sa * nb) / (na * nb), dtype=np.float64)  # difference of the means
    return na + nb, sa + sb, ma + mb + np.outer(apart, apart) * (na * nb / (na + nb))


def merge(a: State, b: State) -> State:
    return {d: merge_two(a[d], b[d]) if d in a and d in b else (a[d] if d in a else b[d]) for d in {*a, *b}}


def statistics(fit: DataFrame, of=lambda x: x) -> State:
    """By dimension: count, sums and scatter of fit(x); ``of`` turns a matrix of x into the one that is measured (or None)."""

    def states(batches):
        state: State = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                y = of(x)
                if y is None:
                    continue
                if y.dtype.kind == "f":
                    mean = y.mean(axis=0)
                    one = (len(y), mean * len(y), (y - mean).T @ (y - mean))
                else:
                    one = local(y)
                state = merge(state, {x.shape[1]: one})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])
        give_back()

    rdd = fit.select("x").mapInArrow(states, "state binary").rdd.map(lambda r: pickle.loads(r[0]))
    return rdd.treeReduce(merge) if rdd.getNumPartitions() else {}


def model(state: State, components: int) -> dict[int, dict]:
    """By dimension: n, sums, axes (unit eigenvectors of the covariance, by falling variance), variances, explained."""
    out = {}
    for d, (n, sums, scatter) in state.items():
        if not d:
            continue
        covariance = (scatter + scatter.T) / 2 / n
        values, vectors = np.linalg.eigh(covariance)
        k = min(components, d)
        e, axes = values[::-1][:k], vectors[:, ::-1][:, :k]
        trace = float(np.trace(covariance))
        live = e > trace * d * np.finfo(np.float64).eps
        out[d] = {"n": n, "sums": sums, "axes": axes, "e": np.where(live, e, 0.0), "explained": np.where(live, e / trace if trace > 0 else 0.0, 0.0), "live": live}
    return out


def project(x: np.ndarray, m: dict) -> np.ndarray:
    """Whitened components of the rows of x; NaN where a direction has no variance."""
    centred = (deviations(x, m["n"], m["sums"]) / m["n"]).astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(m["live"], centred @ m["axes"] / np.sqrt(m["e"]), np.nan)


def whiten(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 4, scale: int = SCALE) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error for each row with a finite vector and each of its
    first ``components`` components."""
    spark = rows.sparkSession
    kept = rows.select(F.col(key).alias("k"), entries(F.col(vector), scale).alias("x")).where("x IS NOT NULL")
    fit = written(kept.select("x").distinct(), "whitening-fit")
    models = model(statistics(fit), components)
    shared = spark.sparkContext.broadcast(models)  # a matrix of dimension by components for each length of vectors

    def live(x: np.ndarray) -> np.ndarray | None:
        m = shared.value.get(x.shape[1])
        return None if m is None or not m["live"].any() else project(x, m)[:, m["live"]]

    errors = {d: float(np.abs(scatter / n - np.eye(len(scatter))).max()) for d, (n, _, scatter) in statistics(fit, live).items()}

    def results(batches):
        for batch in batches:
            keys = batch.column(0)
            for at, x in matrices(batch.column(1)):
                m = shared.value.get(x.shape[1])
                if m is None:
                    continue
                k, off = len(m["e"]), deviations(x, m["n"], m["sums"])
                large = off.dtype == object or float(np.abs(off).max(initial=0)) ** 2 * off.shape[1] >= 1 << 62
                squares = [v if v < 1 << 63 else None for v in (off.astype(object) ** 2).sum(axis=1)] if large else (off * off).sum(axis=1)
                white = project(x, m).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(at) * k, m["n"], dtype=np.int64)),
                        pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                        pa.array(white, mask=np.isnan(white)),
                        pa.array(np.tile(m["explained"], len(at))),
                        pa.array(np.full(len(at) * k, errors.get(x.shape[1], 0.0))),
                    ],
                    names=["k", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
        give_back()

    kind = rows.schema[key].dataType.simpleString()
    out = kept.mapInArrow(results, f"k {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("k", key)
