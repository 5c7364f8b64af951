from graphloom.plans import catalog


def test_snippets_of_long_lines_are_whole(spark, tmp_path):
    lines = [c * 4000 for c in "abcdefgh"]
    docs = [(1, "\n".join(lines)), (2, "short"), (3, ""), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["snippet"], r["lines"]) for r in catalog.QUERIES["s12_snippet"](spark, str(tmp_path)).collect()}
    assert got == {1: ("\n".join(lines[2:6]), 8), 2: ("", 1), 3: ("", 1)}
