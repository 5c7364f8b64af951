import collections

import pytest

from graphloom.llm import mixing
from graphloom.llm.queries import ORACLE_SQL

from ..compare import rows as normal
from .data import awkward


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string")


def targets(sizes, weights=(5, 2, 1)):
    """By sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in full]
        rate = (budget - sum(full.values())) / sum(weight[s] for s in left) if left else 0
        over = [s for s in left if weight[s] * rate > 2 * sizes[s]]
        if not over:
            return full | {s: weight[s] * rate for s in left}
        full |= {s: 2.0 * sizes[s] for s in over}


def checked(docs, got):
    assert len(got) == len(docs)
    words = lambda t: len((t or "").encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()) if not set(t or "") & set("\x1c\x1d\x1e\x1f\x85") else len([w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w])
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    source = {d[0]: d[2] for d in docs}
    for i, t, s in docs:
        sizes[s] += words(t)
        largest[s] = max(largest[s], words(t))
    want = targets({s: sizes[s] for s in source.values()})
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s], (s, taken[s], want[s])
    total = sum(sizes.values())
    assert sum(taken.values()) <= 1.5 * total <= sum(taken.values()) + max([0, *largest.values()])


def some(n=300):
    texts = awkward() + [f"w{i} " * ((i * 37) % 97) for i in range(n)]
    names = ["b", None, "a", "é", "", "hot", "hot", "hot", "hot", "hot"]
    return [(i, t, names[i % len(names)] if i % 50 else "rare") for i, t in enumerate(texts)]


def test_op13_targets_words_and_budget(spark):
    docs = some()
    got = mixing.mix(frame(spark, docs)).collect()
    checked(docs, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(frame(spark, docs[::-1]).repartition(6)).collect()))


def test_op13_equals_its_sql(spark, tmp_path):
    import duckdb

    docs = frame(spark, some(120) + [(7, "same row here", "a")] * 3 + [(None, "no id", "a"), (None, "no id", "b")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(ORACLE_SQL["op13_source_mixing"])
    want = normal([c[0] for c in cur.description], cur.fetchall())
    got = mixing.mix(docs)
    assert normal(got.columns, [tuple(r) for r in got.collect()]) == want


def test_op13_one_long_document_and_no_words(spark):
    docs = [(1, "a " * 5000, "x"), (2, "b c", "y"), (3, "d", "y"), (4, None, "z"), (5, " \t", "z")]
    checked(docs, mixing.mix(frame(spark, docs)).collect())
    none = mixing.mix(frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in none] == [(0, 0, 0.0, 0)] * 2
    assert mixing.mix(frame(spark, docs).where("false")).collect() == []


def test_op13_the_mix_itself(spark):
    docs = some(80)
    out = mixing.sequence(frame(spark, docs))
    assert out.columns == ["doc_id", "text", "source", "size", "mix_finish", "mix_passed"]
    rows = out.collect()
    assert [r["mix_passed"] for r in rows] == sorted(r["mix_passed"] for r in rows)
    assert [r["mix_finish"] for r in rows] == sorted(r["mix_finish"] for r in rows)
    copies = collections.Counter(r["doc_id"] for r in rows)
    text = {d[0]: d[1] for d in docs}
    assert all(r["text"] == text[r["doc_id"]] for r in rows) and max(copies.values()) == 2
    for r in mixing.mix(frame(spark, docs)).collect():
        assert r["taken"] == r["size"] * copies[r["doc_id"]]
