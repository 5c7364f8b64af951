"""Operators against published golden values and plain-Python rederivations."""

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import consensus as C
from graphloom.operators import graph as G
from graphloom.operators import history as H
from graphloom.operators import modules as M
from graphloom.operators import resolve as R
from graphloom.operators import rules as RU
from graphloom.operators import types as TY
from graphloom.sources import files as S
from graphloom.streaming import events as E


def evaluations(spark, scores, confidences=None, claim="c"):
    return spark.createDataFrame([(claim, f"e{i}", float(s), float((confidences or [1.0] * len(scores))[i])) for i, s in enumerate(scores)], "claim_id string, evaluator_id string, score double, confidence double")


def test_consensus_golden(spark):
    b = C.with_interval(C.bayesian(evaluations(spark, [0.85, 0.90, 0.88, 0.82]))).first()
    assert (b["alpha"], b["beta"], b["consensus_score"], b["agreement_level"]) == (5.0, 1.0, 0.833333, "high")
    assert abs(b["lower"] - 0.025 ** (1 / 5)) < 1e-5 and abs(b["upper"] - 0.975 ** (1 / 5)) < 1e-5
    m = C.majority(evaluations(spark, [0.8, 0.7, 0.3, 0.9, 0.6])).first()
    assert (m["yes"], m["consensus_score"], m["margin"], m["agreement_level"], m["resolution"]) == (4, 0.8, 0.6, "medium", "accept")
    w = C.weighted_average(evaluations(spark, [0.85, 0.87, 0.83])).first()
    assert (w["consensus_score"], w["agreement_level"], w["resolution"]) == (0.85, "high", "accept")
    assert C.route(evaluations(spark, [0.5]), "adaptive_stability").count() == 1


def test_beta_cdf_against_integration():
    for a, b in ((1, 1), (2, 5), (5, 1), (3.5, 2.25)):
        n = 20000
        c = math.gamma(a + b) / math.gamma(a) / math.gamma(b)
        for x in (0.1, 0.5, 0.9):
            want = sum(c * ((i + 0.5) / n * x) ** (a - 1) * (1 - (i + 0.5) / n * x) ** (b - 1) for i in range(n)) * x / n
            assert abs(float(C.beta_cdf(x, a, b)) - want) < 1e-4


def test_compound_golden(spark):
    d = spark.createDataFrame([(0.8, 0.6, 0.9, 0.7)], "relevance double, uniqueness double, impact double, confidence double")
    assert C.compound_score(d).first()["weighted_total"] == 0.77
    e = spark.createDataFrame([(0.9, 0.4, 0.7, 0.8)], d.schema)
    assert C.compound_score(e, dict.fromkeys(C.WEIGHTS, 1.0)).first()["weighted_total"] == 0.7
    with pytest.raises(ValueError):
        C.compound_score(d, dict.fromkeys(C.WEIGHTS, 0.0))


def test_propagation_golden(spark):
    edges = lambda pairs: spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "src string, dst string, edge_seq long")
    line = G.propagation(edges([("a", "b"), ("b", "c"), ("c", "d")]), "a")
    r = G.propagation_impact(line).first()
    assert (r["paths"], r["max_depth"], r["impact"]) == (3, 3, 1.0)
    d = G.propagation_impact(G.propagation(edges([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]), "a")).first()
    assert (d["paths"], d["max_depth"]) == (3, 2)
    path = {x["target"]: x["path"] for x in G.propagation(edges([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]), "a").collect()}
    assert path["d"] == ["b", "d"]


def test_history_golden(spark):
    commits = [["a.py", "b.py", "c.py"], ["a.py", "b.py"], ["a.py", "b.py"], ["a.py", "c.py"], ["d.py"]]
    cf = spark.createDataFrame([(i, f) for i, c in enumerate(commits) for f in c], "commit_id int, file string")
    s = {(r["file_a"], r["file_b"]): r["support"] for r in H.cochange_support(cf).collect()}
    assert s[("a.py", "b.py")] == 3
    assert {(r["file_a"], r["file_b"]): r["support"] for r in H.cochange_support(cf, block=1).collect()} == s
    large = spark.createDataFrame([(1, i) for i in range(300)] + [(2, i) for i in range(0, 300, 50)] + [(3, 7)], "commit_id int, file int")
    got = {(r["file_a"], r["file_b"]): r["support"] for r in H.cochange_support(large, block=32).collect()}
    assert got == {(a, b): 1 + (a % 50 == b % 50 == 0) for b in range(300) for a in range(b)}
    r = H.cochange(cf, 3, 0.5).collect()
    assert [(x["file_a"], x["file_b"], x["confidence_ab"], x["confidence_ba"]) for x in r] == [("a.py", "b.py", 0.75, 1.0)]
    blame = spark.createDataFrame([("f", "x", 80), ("f", "y", 16), ("f", "z", 4)], "file string, author string, line_count long")
    o = H.ownership(blame).first()
    assert (o["ownership_ratio"], o["top_contributor"], o["author_count"], o["minor_count"]) == (0.8, "x", 3, 1)
    one = spark.createDataFrame([(f"f{i}", "x", 1.0) for i in range(5)], "file string, author string, confidence double")
    assert tuple(H.bus_factor(one).first()) == (1, 5, "CRITICAL")
    many = spark.createDataFrame([(f"f{i}", f"a{i}", 1.0) for i in range(10)], one.schema)
    assert tuple(H.bus_factor(many).first()) == (5, 10, "MEDIUM")
    assert tuple(H.bus_factor(one.where("false")).first()) == (0, 0, "UNKNOWN")


def _random_graph(seed, n=40, m=70):
    rnd = random.Random(seed)
    return sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)})


def test_bfs_first_discoverer(spark):
    pairs = _random_graph(3)
    e = spark.createDataFrame([(a, b, "CALLS", 1.0, i) for i, (a, b) in enumerate(pairs)], "src int, dst int, type string, confidence double, edge_seq long")
    got = {r["id"]: (r["depth"], r["via"]) for r in G.bfs(e, spark.createDataFrame([(pairs[0][0],)], "id int"), max_depth=None).collect()}
    want, todo = {pairs[0][0]: (0, None)}, deque([pairs[0][0]])
    while todo:
        x = todo.popleft()
        for a, b in pairs:
            if a == x and b not in want:
                want[b] = (want[x][0] + 1, x)
                todo.append(b)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got == want


def test_dead_code_and_traces(spark):
    nodes = spark.createDataFrame([("main", "Function", "main", "a.java", "java", True), ("process", "Function", "process", "a.java", "java", False), ("save", "Function", "save", "a.java", "java", False), ("lost", "Function", "lost", "a.java", "java", False), ("AHandler", "Class", "AHandler", "a.java", "java", False), ("py", "Function", "py", "a.py", "python", False)], "id string, label string, name string, file_path string, language string, is_exported boolean")
    e = spark.createDataFrame([("main", "process", 1, "CALLS", 1.0), ("process", "save", 2, "CALLS", 0.5), ("main", "lost", 3, "CALLS", 0.4), ("main", "py", 4, "USES", 1.0)], "src string, dst string, edge_seq long, type string, confidence double")
    used = e.where("edge_seq < 3")
    got = {r["id"]: r["confidence"] for r in G.dead_code(nodes, used, X.is_test_v1(F.col("file_path")), include_low=True).collect()}
    assert got == {"lost": 0.9, "AHandler": 0.3, "py": 0.6}
    t = G.trace_processes(e, spark.createDataFrame([("main", 2.0), ("process", 1.0)], "id string, score double"), min_steps=2)
    assert sorted(tuple(r["path"]) for r in t.collect()) == [("main", "process", "save"), ("process", "save")]
    assert [tuple(r["path"]) for r in G.drop_contained(t).collect()] == [("main", "process", "save")]
    one = lambda **k: {r["id"]: r["score"] for r in G.trace_entries(nodes, e, X.is_test_v1(F.col("file_path")), **k).collect()}
    plain, raised = one(), one(multiplier=F.when(F.col("id") == "process", 3.0).otherwise(0.5))
    assert set(plain) == {"main", "process"} and raised == {"main": plain["main"], "process": 3 * plain["process"]}


def test_traces_of_a_branching_graph(spark):
    rnd = random.Random(11)
    adj = {x: [rnd.randrange(400) for _ in range(rnd.randint(3, 6))] for x in range(400) if rnd.random() > 0.12}
    edges = [(a, b, a * 10 + i, "CALLS", rnd.choice([0.5, 0.9])) for a, bs in adj.items() for i, b in enumerate(bs)]
    edges += [(a, rnd.randrange(400), a * 10 - 1, "CALLS", 0.49) for a in range(400)]
    want, stopped = {}, {}
    for start in range(40):
        traces, queue = [], deque([[start]])
        while queue and len(traces) < 12:
            path = queue.popleft()
            new = [[*path, b] for b in adj.get(path[-1], [])[:4] if b not in path] if len(path) < 6 else []
            queue.extend(new)
            if not new and len(path) >= 3:
                traces.append(path)
        stopped |= {(start, i + 1): t for i, t in enumerate(traces)} if len(stopped) < 40 else {}
        want |= {(start, i + 1): t for i, t in enumerate(traces)}
    rnd.shuffle(edges)
    e = spark.createDataFrame(edges, "src int, dst int, edge_seq int, type string, confidence double")
    entries = spark.createDataFrame([(x, 100.0 - x // 2) for x in range(40)], "id int, score double")
    for most, expected in ((10_000, want), (20, stopped)):
        got = G.trace_processes(e, entries, max_depth=6, most=most).collect()
        assert {(r["entry"], r["rank"]): r["path"] for r in got} == expected and len(got) == len(expected)
    assert 40 <= len(stopped) < len(want) and G.trace_processes(e, entries.where("false"), max_depth=3).count() == 0


def test_member_traces(spark):
    for seed in (5, 6):
        pairs = _random_graph(seed, 25, 90)
        rnd = random.Random(seed)
        seq = rnd.sample(range(1000), len(pairs))
        e = spark.createDataFrame([(a, b, i) for (a, b), i in zip(pairs, seq, strict=True)], "src int, dst int, edge_seq int")
        adj = {}
        for i, (a, b) in sorted(zip(seq, pairs, strict=True)):
            adj.setdefault(a, []).append(b)
        want = set()
        for start in (0, 1, 2):
            seen, todo = {start}, deque([(start, 0)])
            while todo:
                x, d = todo.popleft()
                want.add((start, x, d))
                new = [y for y in dict.fromkeys(adj.get(x, [])) if y not in seen][:2] if d < 3 else []
                seen.update(new)
                todo += [(y, d + 1) for y in new]
        got = G.trace_members(e, spark.createDataFrame([(0,), (1,), (2,)], "id int"), branching=2, max_depth=3)
        assert {tuple(r) for r in got.collect()} == want
    m = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (4, 4), (4, 5)], "entry int, id int")
    s = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 7.0), (4, 6.0)], "id int, score double")
    m = m.union(spark.createDataFrame([(1, 3)], m.schema))
    assert sorted(r["entry"] for r in G.drop_subsets(m, s).collect()) == [1, 4]


def test_rules_on_nested_columns(spark):
    s = "title string, content string, sections array<string>, requirements array<struct<id:string,source:string>>, tests array<struct<name:string,traces_to:string>>, stories array<struct<id:string,depends_on:array<string>>>, sprints array<struct<story_points:int>>, files array<struct<path:string,lines:int,public_types:int>>, verdicts array<string>, k int"
    good = ("T", "self-check", list(RU.SECTIONS), [("FR-1", "Codebase")], [("t", "AC-1")], [("S1", ["S2"])], [(3,), (5,), (3,)], [("a", 10, 1)], ["pass"] * 5, 1)
    bad = ("", "x", ["Overview"], [("FR-1", "dream")], [("t", "")], [("S1", ["S1"])], [(3,), (3,), (3,)], [("a", 301, 2)], ["pass"] * 6, 2)
    ids = [1, 2, 6, 9, 13, 15, 17, 21, 26, 28]
    got = {r["k"]: [r[f"r{i}"] for i in ids] for r in RU.rule_flags(spark.createDataFrame([good, bad], s), "k", ids).collect()}
    assert got == {1: [True] * 10, 2: [False] * 10}
    assert len(RU.RULES) == 64 and {r.category for r in RU.RULES.values()} == {"structural", "structural_extended", "architecture", "security", "resilience", "quality", "observability"}


def test_security_and_budget_golden(spark):
    d = spark.createDataFrame([("ls -la",), ("git push origin main",), ("rm -rf /",)], "c string")
    assert [(r[0], r[1]) for r in d.select(X.security_tier(F.col("c")).alias("t")).select("t", X.tier_action(F.col("t"))).collect()] == [(1, "allow"), (5, "allow"), (10, "block")]
    b = spark.createDataFrame([(50,), (71,), (94,)], "u int").select(C.budget_level(F.col("u"), F.lit(100))).collect()
    assert [r[0] for r in b] == ["l3_full", "l2_summary", "l1_config"]


def test_method_resolution(spark):
    rows = [("g", "D", "B", 0), ("g", "D", "C", 1), ("g", "B", "A", 0), ("g", "C", "A", 0)]
    h = spark.createDataFrame(rows, "`group` string, child string, parent string, seq int")
    at = lambda kind: [r["ancestor"] for r in TY.method_resolution(h, kind).where("cls = 'D'").orderBy("place").collect()]
    assert at("c3") == ["D", "B", "C", "A"] and at("dfs") == ["D", "B", "A", "C"]

    class A: ...
    class B(A): ...
    class C_(A): ...
    class D(B, C_): ...

    assert at("c3") == [c.__name__.rstrip("_") for c in D.__mro__[:-1]]


def test_type_strings(spark):
    d = spark.createDataFrame([("Optional[List[int]]", "python"), ("Map<String, List<Int>>?", "kotlin"), ("int[]", "java"), ("*User", "go"), ("str | None", "python"), (None, None)], "t string, l string")
    got = [tuple(r[0]) for r in d.select(TY.type_parts("t", "l")).collect()]
    assert got == [("List", ["int"], True, True), ("Map", ["String", "List<Int>"], True, False), ("int", [], False, True), ("User", [], True, False), ("str", [], True, False), ("", [], False, False)]


def test_imports(spark):
    files = spark.createDataFrame([("src/app/util.ts", 0), ("lib/util.ts", 1), ("pkg/mod/__init__.py", 2), ("src/app/index.ts", 3)], "path string, seq int")
    imp = spark.createDataFrame([(1, "app.util"), (2, "util"), (3, "pkg.mod"), (4, "nothing"), (5, "APP/UTIL")], "import_id int, module string")
    assert {r["import_id"]: r["path"] for r in R.resolve_imports(imp, files).collect()} == {1: "src/app/util.ts", 2: "src/app/util.ts", 3: "pkg/mod/__init__.py", 5: "src/app/util.ts"}
    rel = spark.createDataFrame([(1, "src/app/main.ts", "./util"), (2, "src/app/main.ts", "../../lib/util"), (3, "src/x.ts", "./app")], "import_id int, file string, module string")
    assert {r["import_id"]: r["path"] for r in R.resolve_relative(rel, files).collect()} == {1: "src/app/util.ts", 2: "lib/util.ts", 3: "src/app/index.ts"}
    alias = spark.createDataFrame([("@/", "src/", 0), ("@", "lib/", 1)], "prefix string, target string, alias_seq int")
    a = spark.createDataFrame([(1, "@/app/util"), (2, "@x"), (3, "y")], "import_id int, module string")
    assert {r["import_id"]: r["module"] for r in R.rewrite_alias(a, alias).collect()} == {1: "src/app/util", 2: "lib/x", 3: "y"}


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\nclass A(B):\n    def f(self):\n        return g(1)\n")
    (tmp_path / "node_modules" / "x.js").write_text("no")
    (tmp_path / "big.txt").write_text("x" * (S.MAX_BYTES + 1))
    files = S.with_language(S.walk(spark, str(tmp_path)))
    assert [(r["path"], r["language"]) for r in files.collect()] == [("src/a.py", "python")]
    got = {(r["kind"], r["name"], r["parent"]) for r in S.python_symbols(files).collect()}
    assert {("IMPORT", "os", ""), ("Class", "A", ""), ("EXTENDS", "A", "B"), ("Method", "f", "A"), ("CALL", "g", "f")} <= got
    log = spark.createDataFrame([(1, "s1\tann\ta@x\t2024-01-02T00:00:00\n\na.py\nb.py\n\ns2\tbob\tb@x\t2024-01-03T00:00:00\n\na.py\n")], "log_id int, value string")
    assert sorted((r["sha"], r["file"], r["author"]) for r in S.parse_commit_log(log).collect()) == [("s1", "a.py", "ann"), ("s1", "b.py", "ann"), ("s2", "a.py", "bob")]
    n = spark.createDataFrame([("3\t1\ta.py\n-\t-\tb.png\n10\t0\tc d.py",)], "value string")
    assert sorted(map(tuple, S.parse_numstat(n).collect())) == [("a.py", 3, 1), ("c d.py", 10, 0)]
    bl = spark.createDataFrame([("f", "abc 1 1\nauthor Ann\nauthor-mail <a@x>\n\tcode\nabc 2 2\nauthor Ann\nauthor-mail <a@x>\n\tmore\nd 3 3\nauthor Bob\nauthor-mail <b@x>\n\tx")], "file string, value string")
    assert sorted((r["author"], r["email"], r["line_count"]) for r in S.parse_blame(bl).collect()) == [("Ann", "a@x", 2), ("Bob", "b@x", 1)]


def test_ignored_paths(spark):
    paths = {"src/a.py": False, "out/a.py": True, "a/node_modules/b.js": True, "a\\\\bin\\\\b.c": True, "x/Cargo.lock": True, "license": False, "LICENSE": True,
             "a.MIN.JS": True, "a.min.ts": False, "types.d.ts": True, "m.generated.cs": True, "a.PNG": True, "png": False, ".env.test": True, "packages/a.ts": False}
    paths = {k.replace("\\\\", "\\"): v for k, v in paths.items()}
    d = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"]: r["x"] for r in d.select("path", X.ignored(F.col("path")).alias("x")).collect()} == paths
    assert not d.select(X.ignored(F.col("path"), [], [], []).alias("x")).where("x").where("NOT path RLIKE 'd.ts|generated'").count()


def test_imports_and_heritage_by_pattern(spark):
    code = {
        "typescript": 'import React, { useState as s, type B } from "react";\nimport * as fs from "fs";\nimport "./side";\nexport { z } from \'./z\';\nclass A<T> extends Base<T> implements I, J {\n}\n',
        "go": 'package m\nimport "fmt"\nimport (\n  "os"\n  x "a/b"\n)\n',
        "java": "import a.b.C;\nimport static a.D.*;\npublic class X extends Y implements Z {",
        "kotlin": "import a.b\nclass P(val x: Int) : Q(x), R {",
        "csharp": "using System.Text;\nusing F = A.B;\nclass K : L, M {",
        "cpp": '#include <vector>\n#include "a.h"\nclass S : public T {',
        "rust": "use std::io;\npub use a::{b, c};\n",
        "ruby": "require 'json'\nclass U < V::W\nend\n",
        "php": "<?php\nuse App\\\\Models\\\\User;\nclass G extends H {".replace("\\\\", "\\"),
        "swift": "import UIKit\nclass N: O {",
        "none": None,
    }
    d = spark.createDataFrame([(f"f.{k}", k, v) for k, v in code.items()], "path string, language string, content string")
    got = {(r["language"], r["module"], tuple(r["names"])) for r in S.imports(d).collect()}
    assert got == {
        ("typescript", "react", ("React", "useState", "B")), ("typescript", "fs", ("fs",)), ("typescript", "./side", ()), ("typescript", "./z", ("z",)),
        ("go", "fmt", ()), ("go", "os", ()), ("go", "a/b", ()), ("java", "a.b.C", ()), ("java", "a.D.*", ()), ("kotlin", "a.b", ()),
        ("csharp", "System.Text", ()), ("csharp", "A.B", ()), ("cpp", "vector", ()), ("cpp", "a.h", ()), ("rust", "std::io", ()), ("rust", "a::{b, c}", ()),
        ("ruby", "json", ()), ("php", "App\\Models\\User", ()), ("swift", "UIKit", ()),
    }
    got = {(r["child"], r["parent"], r["kind"][0]) for r in S.heritage(d).collect()}
    assert got == {("A", "Base", "E"), ("A", "I", "I"), ("A", "J", "I"), ("X", "Y", "E"), ("X", "Z", "I"), ("P", "Q", "E"), ("P", "R", "E"), ("K", "L", "E"), ("K", "M", "E"),
                   ("S", "T", "E"), ("U", "V::W", "E"), ("G", "H", "E"), ("N", "O", "E")}


def test_store_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "Function"), ("b", "Odd")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "b", "WHAT")], "src string, dst string, type string")
    S.save_graph(nodes, edges, str(tmp_path / "g"))
    n, e = S.load_graph(spark, str(tmp_path / "g"), ["Function"], ["CALLS"])
    assert {(r["id"], r["label"]) for r in n.collect()} == {("a", "Function"), ("b", "CodeElement")} and {r["type"] for r in e.collect()} == {"CALLS"}
    assert S.upsert(nodes, spark.createDataFrame([("b", "New"), ("c", "New")], nodes.schema), "id").count() == 3
    S.save_csv(nodes, str(tmp_path / "csv"))
    p = tmp_path / "log.json"
    p.write_text('{"event_id":"1","stage_id":2,"timestamp":"2024-01-01T00:00:00Z","outcome":"pass"}\nnot json\n')
    ev = S.read_events(spark, str(p))
    assert ev.count() == 2 and S.query_audit(ev, stage=2).first()["event_id"] == "1"


def test_streams(spark, tmp_path):
    schema = "user_id int, ts timestamp, event_type string, stage int"
    src = tmp_path / "in"
    spark.createDataFrame([(1, "2024-01-01 00:00:00", "a", 1), (1, "2024-01-01 00:00:10", "b", 3), (1, "2024-01-01 00:00:20", "a", 2), (2, "2024-01-01 00:00:05", "a", 1)], "user_id int, ts string, event_type string, stage int").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.json(str(src))
    stream = lambda: E.read_stream(spark, str(src), schema)
    E.append_log(stream(), str(tmp_path / "out"), str(tmp_path / "ck1"), "parquet").awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    seen, failed = [], []

    def broken(batch, number):
        raise ValueError("down")

    E.fan_out(stream(), {"broken": broken, "good": lambda b, n: seen.append(b.count())}, str(tmp_path / "ck3"), failed).awaitTermination(120)
    assert sum(seen) == 4 and failed and failed[0][0] == "broken"
    E.fan_out(stream(), {"broken": broken}, str(tmp_path / "ck4")).awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "ck4" / "failures")).collect()] == [("broken", 0, "down")]
    w = E.windowed_counts(spark.read.schema(schema).json(str(src)), "10 seconds")
    assert w.agg(F.sum("events")).first()[0] == 4


def test_thoughts_and_templates(spark):
    t = spark.createDataFrame([("r", None, 0.1), ("a", "r", 0.9), ("b", "r", 0.8), ("c", "a", 0.2), ("d", "a", 0.7)], "id string, parent string, confidence double")
    assert [r["id"] for r in TY.best_thought_path(t, "r").orderBy("place").collect()] == ["r", "a", "d"]
    p = spark.createDataFrame([(1, "please refactor this"), (2, "hello")], "prompt_id int, text string")
    k = spark.createDataFrame([("x", "refactor", 0.2), ("y", "debug", 0.9), ("z", "plan", 0.8)], "template_id string, category string, success double")
    assert sorted(map(tuple, TY.match_templates(p, k).collect())) == [(1, 1, "x"), (2, 1, "y"), (2, 2, "z")]


def test_metamorphic_edge_order(spark):
    pairs = _random_graph(9)
    e = [(a, b, i) for i, (a, b) in enumerate(pairs)]
    shuffled = e[:]
    random.Random(1).shuffle(shuffled)
    out = [sorted(map(tuple, G.degrees(spark.createDataFrame(x, "src int, dst int, edge_seq int")).collect())) for x in (e, shuffled)]
    assert out[0] == out[1]
    assert M.pack_chunks(spark.createDataFrame([("g", i, 40) for i in range(5)], "g string, o int, s int"), 100, "g", "o", "s").select(F.max("chunk")).first()[0] == 2
