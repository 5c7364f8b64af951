import collections
import hashlib
import random

import numpy as np

from graphloom.llm import suffixes

from .data import awkward, documents


def _brute(texts, length):
    seen = collections.Counter()
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        seen.update(r[i : i + length] for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(r, dtype=np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_difference_cover():
    for v in (8, 16, 32):
        d, shift = suffixes.cover(v)
        for i in range(v):
            for j in range(v):
                s = shift[i, j]
                assert s < v and d[(i + s) % v] and d[(j + s) % v]


def test_sorting_is_exact():
    rng = np.random.default_rng(2)
    texts = [
        rng.integers(0, 3, 3000), np.tile(rng.integers(0, 250, 300), 12), np.zeros(1500, int), np.tile([1, 2, 3], 800),
        np.concatenate([rng.integers(0, 255, 900)] * 3 + [np.zeros(700, int)]),
    ]
    for t in texts:
        t = t.astype(np.uint8)
        raw = t.tobytes()
        starts = rng.permutation(len(t) - 200 + 1)[:900]
        order, same = suffixes.sort_suffixes(t, starts)
        got = [raw[s : s + 200] for s in starts[order]]
        assert got == sorted(raw[s : s + 200] for s in starts)
        assert same.tolist() == [i > 0 and got[i] == got[i - 1] for i in range(len(got))]


def _corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéß ") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(70) for _ in range(5)]
    texts = []
    for i in range(120):
        t = prose(rnd.randint(0, 200))
        if i % 3 == 0:
            t += shared[i % 5][rnd.randint(0, 30) :] + prose(rnd.randint(0, 40))
        if i % 10 == 0:
            t += t[: rnd.randint(0, 500)]
        texts.append(t)
    base = texts[4] + prose(300)
    for _ in range(15):
        w = base.split(" ")
        w[rnd.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    return texts + [texts[0], texts[0], "ab" * 400, "ab" * 90, "x" * 199, "y" * 200, "y" * 200] + awkward()


def test_whole_query_equals_brute_force(spark):
    texts = _corpus()
    docs = documents(spark, texts).repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.digest(docs).collect()}
    for i, want in enumerate(_brute(texts, 200)):
        assert got[i] == want, i
    assert len(got) == len(texts)


def test_hot_anchors_do_not_change_the_result(spark, monkeypatch):
    texts = _corpus(7)
    want = _brute(texts, 200)
    docs = documents(spark, texts).repartition(3)
    for share, block in ((0.0, 1 << 22), (2.0, 3000)):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        monkeypatch.setattr(suffixes.hot_anchors, "__defaults__", (suffixes.SAMPLE_DOCS, share))
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.digest(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_columns_ids_and_empty(spark):
    t = "é" * 150
    docs = documents(spark, [t + "a" + t, None, "short"], ids=[4, 4, None])
    out = sorted(suffixes.dedup_text(docs).collect(), key=lambda r: str(r["text"]))
    assert docs.columns == out[0].__fields__
    assert suffixes.digest(docs.where("false")).collect() == []
    kept = [r["text"] for r in out if r["text"] and r["text"] != "short"]
    want = _brute([t + "a" + t, None, "short"], 200)
    assert len(out) == 3 and all("�" not in k for k in kept) and want[0][1] > 0
