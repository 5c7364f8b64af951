import re

import corpus_pipeline as cp
from graphloom.llm.bpe import default_vocabulary, load

from .data import awkward, documents
from .test_jaccard import _brute, corpus
from .test_suffixes import _brute as cut_brute


def test_stages_against_brute_force(spark, tmp_path):
    texts = corpus(9, groups=6, members=10)
    item = " ".join(f"bench{i}" for i in range(40))
    texts += ["before " + item + " after this", "clean words only, nothing else here at all", "123 456"]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, texts, langs=["en" if i % 2 else "de" for i in range(len(texts))])
    columns = docs.columns
    one = cp.STAGES[0][1](spark, docs, str(tmp_path)).cache()
    kept = {r["doc_id"]: r["text"] for r in one.collect()}
    letters = {i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    assert set(kept) == letters and one.columns == columns

    two = cp.STAGES[1][1](spark, one, str(tmp_path)).cache()
    order = sorted(kept)
    want = {i for i, _, c in _brute([kept[i] for i in order], 5, 80, order) if i == c}
    assert {r["doc_id"] for r in two.collect()} == want and two.columns == columns

    three = cp.STAGES[2][1](spark, two, str(tmp_path)).cache()
    order = sorted(want)
    gone = cut_brute([kept[i] for i in order], 200)
    rows = {r["doc_id"]: r for r in three.collect()}
    assert set(rows) == want and three.columns == columns
    for i, (size, removed, _, _) in zip(order, gone, strict=True):
        assert len(rows[i]["text"].encode()) <= size - removed and rows[i]["n_chars"] == len(rows[i]["text"])
        assert removed or rows[i]["text"] == kept[i]

    four = cp.STAGES[3][1](spark, three, str(tmp_path)).cache()
    leak = {i for i in rows if "bench3 bench4" in rows[i]["text"]}
    assert leak and {r["doc_id"] for r in four.collect()} == want - leak and four.columns == columns

    five = cp.STAGES[4][1](spark, four, str(tmp_path)).collect()
    b = load(*default_vocabulary())
    left = {r["doc_id"]: r["text"] for r in four.collect()}
    assert {r["doc_id"]: b.decode(__import__("numpy").array(r["token_ids"], dtype=int)).decode() for r in five} == left


def test_run_and_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    t = awkward()
    d = documents(spark, t + [t[0], t[0]], ids=[*range(len(t)), None, 0])
    d.write.parquet(str(tmp_path / "documents.parquet"))
    rows = cp.run(spark, str(tmp_path)).collect()
    fox = [r for r in rows if r["n_chars"] == len(t[0])]
    assert len(fox) == 1 and all(r["n_tokens"] == len(r["token_ids"]) for r in rows)
    assert len(rows) <= sum(bool(re.search(r"[^\W\d_]", x or "")) for x in t)
    empty = str(tmp_path / "e")
    d.where("false").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert cp.run(spark, empty).collect() == []


def test_clashing_columns_come_through_unchanged(spark, tmp_path):
    names = ["score", "lang_pred", "bits", "kept", "n_bytes", "n_removed", "n_spans", "t1_", "t2_", "_t", "k1", "k2", "row", "ranges", "a", "b", "text_", "token", "item_id"]
    texts = [*corpus(3, groups=2, members=4), "solo words here", None]
    plain = documents(spark, texts, langs=["en"] * len(texts))
    docs = plain.selectExpr("*", *[f"{i} AS `{x}`" for i, x in enumerate(names)])
    spark.createDataFrame([(1, "solo words here and there")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in cp.STAGES[:-1]:
        with_, without = stage(spark, docs, str(tmp_path)), stage(spark, plain, str(tmp_path))
        rows = with_.collect()
        assert with_.columns == docs.columns and all(r[x] == i for r in rows for i, x in enumerate(names))
        assert sorted(((r["doc_id"], r["text"]) for r in rows)) == sorted((r["doc_id"], r["text"]) for r in without.collect())
    last = cp.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.columns == ["doc_id", "lang", "source", "n_chars", "token_ids", "n_tokens"] and last.count() == len(texts)
