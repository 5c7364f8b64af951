import math

import numpy as np

from graphloom.llm import whitening


def frame(spark, vectors, ids=None):
    rows = [(i, v, 0, 1.0) for i, v in zip(ids or range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, whitened double")


def brute(vectors, components=4):
    ok = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in ok})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], dtype=np.float64) / n
    cov = centred.T @ centred / n
    e, axes = np.linalg.eigh(cov)
    e, axes = e[::-1], axes[:, ::-1]
    out = {}
    for i, x in ok:
        off = [n * c - s for c, s in zip(x, sums, strict=True)]
        for k in range(min(components, len(x))):
            out[i, k + 1] = (n, sum(o * o for o in off), float(np.array(off, dtype=np.float64) / n @ axes[:, k] / math.sqrt(e[k])), e[k] / e.sum())
    return out


def checked(got, want):
    assert len(got) == len(want)
    signs = {}
    for r in got:
        n, deviation, white, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        if abs(white) > 1e-6:
            assert signs.setdefault(r["component"], np.sign(white * r["whitened"])) == np.sign(white * r["whitened"])
        assert abs(abs(r["whitened"]) - abs(white)) < 1e-8 and abs(r["explained"] - explained) < 1e-9
        assert 0 <= r["identity_error"] < 1e-6
    assert len({r["identity_error"] for r in got}) == 1


def some(n=200, d=6, offset=0.0):
    rng = np.random.default_rng(5)
    return [[float(np.float32(c)) for c in row] for row in rng.normal(size=(n, d)) * np.arange(1, d + 1) + offset]


def test_op11_equals_brute_force(spark):
    v = some()
    v += [v[0]] * 90 + [None, [None] * 6, [*v[1][:5], float("nan")], [*v[1][:5], float("inf")], [*v[1][:5], -float("inf")], [*v[2][:5], None]]
    checked(whitening.whiten(frame(spark, v).repartition(7)).collect(), brute(v))


def test_op11_large_offsets_lose_no_digits(spark):
    v = some(offset=4096.0)
    checked(whitening.whiten(frame(spark, v)).collect(), brute(v))


def test_op11_huge_entries(spark):
    v = [[1e12, 0.0, 1.0], [-1e12, 5.0, 0.0], [3e11, 2.0, 9.0], [1e11, 7.0, 1.0], [1e30, 0.0, 0.0]]
    got = whitening.whiten(frame(spark, v)).collect()
    assert len(got) == 15 and all(r["deviation"] is None for r in got) and all(r["n"] == 5 for r in got)


def test_op11_no_variance_short_vectors_and_lengths(spark):
    one = whitening.whiten(frame(spark, [[1.0, 2.0]] * 3)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, 0.0, 0.0)] * 6
    flat = whitening.whiten(frame(spark, [[1.0, 0.0], [2.0, 0.0], [4.0, 0.0]])).collect()
    assert {r["component"]: (r["whitened"] is None, round(r["explained"], 9)) for r in flat} == {1: (False, 1.0), 2: (True, 0.0)}
    mixed = whitening.whiten(frame(spark, [*some(20, 3), *some(30, 5), [], [7.0]], [*range(50), 50, 51])).collect()
    assert {(r["vec_id"] < 20, r["n"]) for r in mixed} == {(True, 20), (False, 30), (False, 1)}
    assert sum(r["vec_id"] == 50 for r in mixed) == 0 and len(mixed) == 20 * 3 + 30 * 4 + 1
    assert whitening.whiten(frame(spark, [None]).where("false")).collect() == [] and whitening.whiten(frame(spark, [None])).collect() == []


def test_op11_merge_is_the_statistics_of_both():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, size=(100, 4)) + 10**9
    whole = whitening.local(x)
    state = {}
    for part in np.array_split(x, [1, 5, 60]):
        state = whitening.merge(state, {4: whitening.local(part)})
    assert state[4][0] == 100 and list(state[4][1]) == list(whole[1])
    assert np.allclose(state[4][2], whole[2], rtol=1e-12)
