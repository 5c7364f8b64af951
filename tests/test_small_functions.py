"""Functions that no registered query calls."""

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import resolve as R
from graphloom.operators import types as TY
from graphloom.sources import files as S


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_texts(spark):
    assert one(spark, X.embedding_text_short(F.lit("Function"), F.lit("f"), F.lit("a.py"), F.lit("f(x)"), F.lit(""))) == "Function f in a.py\nf(x)"
    assert one(spark, X.strip_line_comments(F.lit("a // b\nc//d\n"))) == "a \nc\n"
    assert one(spark, X.first_json_object(F.lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}' and one(spark, X.first_json_object(F.lit("none"))) is None
    assert one(spark, X.csv_field(F.lit('a "b"\r\nc'))) == '"a ""b""\nc"' and one(spark, X.csv_field(F.lit(None).cast("string"))) == '""'
    assert [one(spark, S.is_binary(F.lit(t))) for t in ("plain\n\ttext", "\x00\x01ab", "", "x" * 2000 + "\x00" * 500)] == [False, True, False, False]


def test_ids_and_handoffs(spark):
    e = spark.createDataFrame([("Function:a.py:f", "comm_1"), ("proc_2", "File:x")], "src string, dst string")
    assert [tuple(r)[2:] for r in S.split_by_labels(e).collect()] == [("Function", "Community"), ("Process", "File")]
    text = S.render_handoff({"Done": F.array(F.lit("one"), F.lit("two")), "Open": F.array(F.lit("three"))})
    assert one(spark, text) == "## Done\n- one\n- two\n\n## Open\n- three"
    assert one(spark, S.parse_handoff(text, "Done")) == ["one", "two"] and one(spark, S.parse_handoff(text, "Open")) == ["three"] and one(spark, S.parse_handoff(text, "None")) == []


def test_resolution(spark):
    paths = lambda m: one(spark, R.rust_candidates(F.lit(m), F.lit("src"), F.lit("src/a/b")))
    assert paths("crate::x::y") == ["src/x/y.rs", "src/x/y/mod.rs", "src/x/y", "src/x.rs", "src/x/mod.rs"]
    assert paths("super::c")[0] == "src/a/c.rs" and paths("self::d")[0] == "src/a/b/d.rs" and paths("serde::de")[0] == "serde/de.rs"
    calls = spark.createDataFrame([("print", 1), ("mine", 2)], "name string, k int")
    assert [r["k"] for r in R.drop_builtins(calls, spark.createDataFrame([("print",), ("print",)], "name string")).collect()] == [2]
    rows = spark.createDataFrame([("f", ["a", "b"], "x.py", 1), ("f", ["b"], "y.py", 2), ("g", [], "z.py", 3)], "file string, names array<string>, path string, seq int")
    assert {(r["file"], r["name"]): r["imported"] for r in R.named_import_map(rows).collect()} == {("f", "a"): "x.py", ("f", "b"): "y.py"}
    asked = spark.createDataFrame([(1, "f", "v", "function"), (2, "f", "v", "class"), (3, "f", "w", "file"), (4, "f", "none", "function")], "lookup_id int, file string, name string, scope string")
    known = spark.createDataFrame([("f", "v", "function", "Near"), ("f", "v", "file", "Far"), ("f", "w", "function", "Inner")], "file string, name string, scope string, type string")
    assert {r["lookup_id"]: r["type"] for r in R.scoped_type(asked, known).collect()} == {1: "Near", 2: "Far"}


def test_encoder(spark):
    d = spark.createDataFrame([("ab",), (None,)], "text string")
    got = TY.with_encoder(d, lambda texts: [[len(t), 1] for t in texts])
    assert sorted(list(r["embedding"]) for r in got.collect()) == [[0.0, 1.0], [2.0, 1.0]]
