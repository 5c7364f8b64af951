import random

import numpy as np

from graphloom.llm import decontam

from .data import awkward, documents


def _plain_score(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = rng.integers(2, 6, size=(4, rng.integers(1, 20))).astype(np.uint64)
        w = rng.integers(2, 6, size=(4, rng.integers(1, 30))).astype(np.uint64)
        got = decontam.align(a, w)[0]
        assert got.tolist() == [_plain_score(x, y) for x, y in zip(a.tolist(), w.tolist(), strict=True)]


def test_leaks_found_and_clean_left(spark):
    rnd = random.Random(4)
    voc = [f"v{i}" for i in range(900)]
    text = lambda n: " ".join(rnd.choice(voc) for _ in range(n))
    items = [text(40) for _ in range(30)] + [None, "", "two words"]
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    docs, want = [], set()
    for i in range(200):
        body = text(rnd.randint(0, 300)).split()
        if i % 4 == 0:
            k = rnd.randrange(30)
            w = items[k].split()
            if i % 8 == 0:  # one word in six changed, one dropped
                w = [rnd.choice(voc) if j % 6 == 5 else x for j, x in enumerate(w)]
                del w[17]
            at = rnd.randint(0, len(body))
            body[at:at] = [x.upper() + "," for x in w]
            want.add((i, k))
        elif i % 4 == 1:  # a phrase in common is no leak
            body[3:3] = items[5].split()[10:17]
        docs.append(" ".join(body))
    d = documents(spark, docs + awkward())
    rows = decontam.leaks(d.repartition(5), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    for r in rows:
        w = docs[r["doc_id"]].lower().replace(",", "").split()[r["first_word"] : r["last_word"] + 1]
        a = items[r["item_id"]].split()
        assert w[0] == a[0] and abs(_plain_score(a, w) / 80 - r["score"]) < 1e-9
    again = decontam.leaks(d, bench, block_words=300).collect()
    assert {(r["doc_id"], r["item_id"]) for r in again} == want
    assert decontam.leaks(d.where("false"), bench).collect() == [] == decontam.leaks(d, bench.where("false")).collect()


def test_repeated_rows_are_each_reported(spark):
    item = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    docs = documents(spark, [item, item, None], ids=[7, 7, None])
    got = decontam.leaks(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(7, 1), (7, 1), (7, 2), (7, 2)] and got[0]["score"] == 1.0


def _edited(rnd, words, share):
    """One in 1 / share words changed, at random places."""
    gone = set(rnd.sample(range(len(words)), round(share * len(words))))
    return [f"z{rnd.randrange(10**6)}" if i in gone else w for i, w in enumerate(words)]


def test_edited_copies_alone_and_in_mass(spark):
    rnd = random.Random(8)
    items = [[f"q{k}x{j}" for j in range(30)] for k in range(12)]
    docs, want = [], set()
    for k, own in enumerate(items):  # every other item stands in one document, the rest in 40
        for _ in range(1 if k % 2 else 40):
            body = [f"b{rnd.randrange(500)}" for _ in range(50)]
            body[20:20] = _edited(rnd, own, rnd.choice([0.2, 0.25, 0.3]))
            if _plain_score(own, body) >= 30 and any(body[i : i + 3] == own[j : j + 3] for i in range(len(body)) for j in range(28)):
                want.add((len(docs), k))
            docs.append(" ".join(body))
    assert len(want) > 200 and {k for _, k in want} == set(range(12))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    d = documents(spark, docs)
    got = decontam.leaks(d, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    left = {r["doc_id"] for r in decontam.clean(d, bench).select("doc_id").collect()}
    assert left == set(range(len(docs))) - {i for i, _ in want}


def test_words_put_in_on_one_side_of_the_seed(spark):
    own = [f"q{j}" for j in range(30)]
    far = own[:3] + [x for j, w in enumerate(own[3:]) for x in ([f"y{j}", w] if j else [w])]
    bench = spark.createDataFrame([(1, " ".join(own))], "item_id long, text string")
    (r,) = decontam.leaks(documents(spark, [" ".join(far)]), bench).collect()
    assert abs(r["score"] - _plain_score(own, far) / 60) < 1e-9
