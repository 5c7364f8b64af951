import random
import re

import numpy as np

from graphloom.llm import jaccard

from .data import awkward, documents


def _sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def _brute(texts, n, percent, ids=None):
    ids = ids or list(range(len(texts)))
    sets = _sets(texts, n)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(texts)):
        r = find(i)
        if ids[i] is not None:
            low[r] = min(low.get(r, ids[i]), ids[i])
    return sorted(((ids[i], len(sets[i]), low.get(find(i)) if sets[i] else ids[i]) for i in range(len(texts))), key=str)


def corpus(seed, groups=12, members=14):
    rnd = random.Random(seed)
    voc = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(voc) for _ in range(n)]
    passage = text(40)
    out = []
    for _ in range(groups):
        base = text(rnd.choice((6, 30, 80, 160)))
        for _ in range(members):
            w = list(base)
            for _ in range(rnd.choice((0, 1, 1, 2, 3, 5, 8))):
                w[rnd.randrange(len(w))] = rnd.choice(voc)
            if rnd.random() < 0.2:
                w = w[: rnd.randint(1, len(w))]
            if rnd.random() < 0.3:
                w = passage + w
            base = w if rnd.random() < 0.3 else base  # chains drift away
            out.append(" ".join(w).replace("w1", "W1"))
    return out + [out[0], out[0], out[5]] + awkward()


def test_components_equal_brute_force(spark):
    for seed, n, percent in ((1, 4, 85), (2, 5, 80), (3, 3, 60)):
        texts = corpus(seed)
        got = jaccard.jaccard_components(documents(spark, texts).repartition(6), n, percent).collect()
        assert sorted((tuple(r) for r in got), key=str) == _brute(texts, n, percent), seed


def test_repeated_rows_null_ids_and_empty(spark):
    texts = ["a b c d e f g", "a b c d e f g", "a b c d e f g h", None, "", "solo"]
    ids = [9, 9, None, 3, 3, None]
    got = jaccard.jaccard_components(documents(spark, texts, ids=ids), 4, 80).collect()
    assert sorted((tuple(r) for r in got), key=str) == _brute(texts, 4, 80, ids)
    assert jaccard.jaccard_components(documents(spark, texts).where("false")).collect() == []


def test_filters_lose_nothing():
    rng = np.random.default_rng(0)
    for percent in (60, 85, 100):
        for _ in range(300):
            a = set(rng.integers(0, 60, rng.integers(1, 40)).tolist())
            b = set(list(a)[: rng.integers(1, len(a) + 1)]) | set(rng.integers(0, 60, rng.integers(0, 6)).tolist())
            x, y = (np.sort(np.array(sorted(s), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for s in (a, b))
            both = len(a & b)
            linked = 100 * both >= percent * (len(a) + len(b) - both)
            bits = [np.unpackbits(np.frombuffer(jaccard.parity(s), dtype=np.uint8)) for s in (x, y)]
            assert (bits[0] != bits[1]).sum() <= len(a ^ b)
            assert linked == (both >= jaccard.overlap_needed(len(a), len(b), percent))
            if linked:
                assert min(len(a), len(b)) >= jaccard.need(max(len(a), len(b)), percent)


def test_hot_lists_are_parted(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "PAIRS", 16)
    monkeypatch.setattr(jaccard, "HELD", 64)
    passage = " ".join(f"p{i}" for i in range(20))
    rnd = random.Random(5)
    texts = [f"{passage} " + " ".join(f"u{k}x{rnd.randrange(3)}" for k in range(j % 7)) for j in range(60)] + corpus(9, 4, 8)
    for n, percent in ((2, 80), (3, 60)):
        got = jaccard.jaccard_components(documents(spark, texts).repartition(5), n, percent).collect()
        assert sorted((tuple(r) for r in got), key=str) == _brute(texts, n, percent)
