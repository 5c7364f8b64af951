import re
from collections import Counter, defaultdict

import pytest

from graphloom.llm import divergence


def brute(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower())) for lang, source, text in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        counts[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang in {x[0] for x in docs}:
        terms = [t for t, k in seen[lang].items() if k >= least]
        sources = sorted({s for l, s, _ in docs if l == lang}, key=str.encode)
        n = {s: sum(counts[lang, s][t] for t in terms) for s in sources}
        share = lambda c, total: 1 + 10**9 * (c + 1) // (total + len(terms))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            pairs = [(sum(f(share(counts[lang, s][t], n[s]), share(counts[lang, o][t], n[o])) for t in terms), o) for o in sources if o != s]
            both = [(share(counts[lang, s][t], n[s]), share(sum(counts[lang, o][t] for o in sources), sum(n.values())), t) for t in terms if counts[lang, s][t]]
            for part, items in (("pair", pairs), ("term", [(f(p, q), t.decode()) for p, q, t in both if p > q])):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int")


def result(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


ROWS = [
    ("en", "a", "The cat, the Cat and THE dog!"), ("en", "b", "the dog's cat's hat"), ("en", "c", "a cat; the café É é"), ("en", None, "cat the\x00dog the"),
    ("en", "d", None), ("en", "e", ""), ("en", "a", "The cat, the Cat and THE dog!"), ("en", "ß", "hat hat hat cat"),
    ("de", "a", "Füße über Füße"), ("de", "a", "Füße"), ("de", "b", "Füße und"), ("de", "b", "und und"), ("de", "c", "und 日本 日本"),
    (None, "x", "one two"), (None, None, "one two"), (None, "y", "one 12 34 --"), ("fr", "solo", "le le le"), ("fr", "solo", "le la"), ("fr", "solo", "le"),
    ("es", "p", "uno"), ("es", "q", "dos"),
]


def test_op12_equals_brute_force(spark):
    rows = ROWS + [("en", f"s{i % 7}", " ".join(f"w{(i * j) % 11} cat" for j in range(i % 13))) for i in range(60)]
    want = brute(rows)
    got = result(divergence.audit(frame(spark, rows).repartition(5)))
    assert got == want
    assert any(x[:3] == ("es", "p", "pair") and x[4] == 0 for x in got) and not any(x[0] == "es" and x[2] == "term" for x in got)
    assert result(divergence.audit(frame(spark, rows), top=2)) == brute(rows, top=2)


def test_op12_blocks_of_sources_pieces_of_texts_and_what_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "PIECE", 7)
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "SALT", 3)
    rows = ROWS + [("en", f"s{i}", " ".join(f"w{(i * j) % 5}" for j in range(i % 9))) for i in range(20)]
    assert result(divergence.audit(frame(spark, rows))) == brute(rows)


def test_op12_empty_and_wordless_tables(spark):
    assert result(divergence.audit(frame(spark, ROWS).where("false"))) == []
    assert result(divergence.audit(frame(spark, [(None, None, None)] * 2))) == []
    assert result(divergence.audit(frame(spark, [("en", "a", "1 2"), ("en", "b", None)]))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


@pytest.mark.parametrize("count", [0, 10**13])
def test_op12_shares_are_exact_beyond_longs(spark, count):
    row = spark.createDataFrame([(count, 3 * 10**13, 7)], "n long, t long, v long").select(divergence.share("n", "t", "v")).first()[0]
    assert row == 1 + 10**9 * (count + 1) // (3 * 10**13 + 7)
