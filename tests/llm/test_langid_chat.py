import math
import random
import zlib

import numpy as np
import pandas as pd

from graphloom.llm import chat, langid

from .data import awkward, documents


def _plain_bits(train, text, order):
    """Code length by the rule itself: longest known context, escape (method C), shorter contexts, then 8 bits."""
    seen = {}
    for t in train:
        raw = b"\0" * order + t
        for i in range(order, len(raw)):
            for k in range(order + 1):
                seen.setdefault(raw[i - k : i], {}).setdefault(raw[i], 0)
                seen[raw[i - k : i]][raw[i]] += 1
    raw, bits = b"\0" * order + text, 0.0
    for i in range(order, len(raw)):
        for k in range(order, -1, -1):
            c = seen.get(raw[i - k : i])
            if c is None:
                continue
            n, q = sum(c.values()), len(c)
            if raw[i] in c:
                bits -= math.log2(c[raw[i]] / (n + q))
                break
            bits -= math.log2(q / (n + q))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    rng = random.Random(0)
    text = lambda a, n: "".join(rng.choice(a) for _ in range(n)).encode()
    train = {"x": [text("aab ", 300), text("abc ", 100)], "y": [text("xyyz ", 400), "éé à".encode()]}
    order = 3
    rows = []
    for lang, ts in train.items():
        for t in ts:
            buf, offs = np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)])
            for k in range(order + 1):
                u, n = np.unique(langid._grams(buf, offs, k), return_counts=True)
                rows += [(lang, k, int(a), int(b)) for a, b in zip(u.view(np.int64), n, strict=True)]
    counts = pd.DataFrame(rows, columns=["lang", "k", "key", "n"]).groupby(["lang", "k", "key"], as_index=False)["n"].sum()
    model = langid.Ppm(counts, order)
    tests = [text("abcxyz é ", 50) for _ in range(8)] + [b"", b"a", "éà".encode(), b"\xff\x00\x01"]
    buf = np.frombuffer(b"".join(tests), dtype=np.uint8)
    offs = np.cumsum([0] + [len(t) for t in tests])
    got = model.score(buf, offs) / langid.UNIT
    for i, t in enumerate(tests):
        for j, lang in enumerate(model.langs):
            assert abs(got[i, j] - _plain_bits(train[lang], t, order)) < 0.005 * max(1, len(t)), (t, lang)


def test_held_out_accuracy_and_no_leak(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r for r in langid.identify(d).collect()}
    truth = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i]["held_out"] == (i in set(out)) for i in truth)
    assert sum(rows[i]["lang_pred"] == truth[i] for i in out) / len(out) > 0.99
    # what is held out doesn't train: its text and lang may be anything
    from pyspark.sql import functions as F

    h = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = d.withColumns({"lang": F.when(h, "zz").otherwise(F.col("lang")), "source": F.lit("s")})
    again = {r["doc_id"]: (r["lang_pred"], r["bits"]) for r in langid.identify(other).collect()}
    assert again == {i: (r["lang_pred"], r["bits"]) for i, r in rows.items()}


def test_langid_defined_cases(spark):
    texts = awkward()
    d = documents(spark, texts, langs=["en", None] * (len(texts) // 2) + ["en"] * (len(texts) % 2))
    got = {r["doc_id"]: r for r in langid.identify(d).collect()}
    for i, t in enumerate(texts):
        letter = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == (not letter) and 0 <= got[i]["score"] <= 1
    none = langid.identify(documents(spark, ["a", None])).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert langid.identify(d.where("false")).collect() == []


def test_no_language_is_lost_with_long_or_skewed_texts(spark):
    rng = random.Random(1)
    made = {x: ["".join(rng.choice(x * 3 + "etaoin") for _ in range(rng.randint(3, 9))) for _ in range(400)] for x in "bdfghjkl"}
    text = lambda x, n: " ".join(rng.choice(made[x]) for _ in range(n // 7))
    ids = [i for i in range(10**6, 10**6 + 400) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(x, text(x, 30_000)) for x in "bdfghjk" for _ in range(3)] + [("l", text("l", 300)) for _ in range(20)] + [("l", text("l", 600_000))]
    docs = documents(spark, [t for _, t in rows], langs=[x for x, _ in rows], ids=ids[: len(rows)])
    for train_bytes in (16_000, 400):  # the first is 2 KB a language, under a tenth of any text
        counts = langid.train_counts(docs, train_bytes=train_bytes)
        assert set(counts["lang"]) == set(made)
        told = counts[counts["k"] == 0].groupby("lang")["n"].sum()
        assert told.sum() < 2 * train_bytes and (train_bytes < 1000 or told.min() > 500)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, train_bytes=16_000).collect()}
    assert [got[i] for i in ids[: len(rows)]] == [x for x, _ in rows]
    one = langid.train_counts(docs, train_bytes=1)  # of each language no more than a byte, but that
    assert set(one["lang"]) == set(made) and one[one["k"] == 0]["n"].sum() <= 2 * len(made)


def test_pieces_are_counted_in_context(spark):
    t = "abcdé" * 1000
    docs = documents(spark, [t], langs=["x"], ids=[next(i for i in range(99) if zlib.crc32(str(i).encode()) % 4 != 2)])
    got = {(k, key): n for k, key, n in langid.train_counts(docs)[["k", "key", "n"]].itertuples(index=False)}  # all of it is drawn
    raw, want = t.encode(), {}
    for k in range(langid.ORDER + 1):
        u, n = np.unique(langid._grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), k), return_counts=True)
        want |= {(k, a): b for a, b in zip(u.view(np.int64).tolist(), n.tolist(), strict=True)}
    assert got == want


def _brute_chat(rows):
    conv = {}
    for c, turn, role, text in rows:
        conv.setdefault(c, []).append((turn is not None, turn or 0, role or "user", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    out = []
    for c, v in turns.items():
        if any(len(w) > len(v) and w[: len(v)] == v for w in turns.values()):
            continue
        same = [k for k, w in turns.items() if w == v]
        if c == min(same, key=lambda k: (k is None, k or 0)):
            out.append((c, len(v), len(same), "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in v)))
    return sorted(out, key=str)


def test_chat_against_brute_force(spark):
    rnd = random.Random(3)
    rows, c = [], 0
    for _ in range(30):
        full = [(rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "yes", "no", "", None, "é" * 50])) for _ in range(rnd.randint(1, 9))]
        for _ in range(rnd.randint(1, 3)):  # cumulative snapshots, some twice
            rows += [(c, i, r, t) for i, (r, t) in enumerate(full[: rnd.randint(1, len(full))])]
            c += 1
    rows += [(None, 0, "user", "null id"), (None, 1, "user", "more"), (900, None, "user", "no turn"), (901, 3, "b", "tie"), (901, 3, "a", "tie"), (902, 1, "user", "x"), (902, 1, "user", "x")]
    d = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, pos string, n int")
    got = sorted(((r["conv_id"], r["n_turns"], r["n_same"], r["rendered"]) for r in chat.collapse_and_render(d.repartition(5)).collect()), key=str)
    assert got == _brute_chat(rows)
    assert chat.collapse_and_render(d.where("false")).collect() == []
