"""Views over a stored graph, and traversal that branches."""

import random
from collections import deque

import pytest

from graphloom.operators import graph as G
from graphloom.operators import search as S
from graphloom.operators import views as V


def test_read_only_sql(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    assert V.read_only_sql(spark, "SELECT t FROM d WHERE id = 2 AND t <> 'd'", d=d).first()[0] == "b"
    for bad in ("DROP TABLE d", " insert into d values (1)", "SELECT 1; DELETE FROM d"):
        with pytest.raises(PermissionError):
            V.read_only_sql(spark, bad, d=d)


@pytest.mark.parametrize(
    "bad",
    ["ADD JAR '/tmp/x.jar'", "CLEAR CACHE", "RESET", "SET x = 1", "DECLARE VARIABLE v INT", "SELECT reflect('java.lang.System', 'exit')", "SELECT `java_method` ('java.lang.System', 'gc') FROM d", "SELECT try_reflect/**/('a', 'b')",
     "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM (SELECT 1) x JOIN parquet.`/tmp/x` y", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "TRUNCATE TABLE d", "LOAD DATA INPATH '/x' INTO TABLE d", "USE other", "CREATE TABLE t AS SELECT * FROM d",
     "SELECT * FROM elsewhere", "SELECT (SELECT max(id) FROM elsewhere) FROM d", "SELECT * FROM d WHERE id IN (SELECT id FROM elsewhere)", "WITH x AS (SELECT * FROM elsewhere) SELECT * FROM x", "EXPLAIN SELECT 1", "SHOW TABLES", "REFRESH TABLE d", "MERGE INTO d USING d s ON d.id = s.id WHEN MATCHED THEN DELETE", "FROM d INSERT INTO t SELECT *", ""],
)
def test_only_queries_over_the_views_run(spark, bad):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    with pytest.raises(PermissionError):
        V.read_only_sql(spark, bad, d=d)


def test_queries_that_read_run(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    for sql, want in (
        ("SELECT 'drop table nation' AS x, '{d} reflect(1)' AS y", ("drop table nation", "{d} reflect(1)")),
        ("SELECT d.t FROM d WHERE d.id = (SELECT max(id) FROM d)", ("b",)),
        ("WITH x AS (SELECT id + 1 AS id FROM d) SELECT sum(x.id) FROM x JOIN d USING (id)", (2,)),
        ("SELECT count(*) FROM (SELECT id FROM d UNION SELECT id FROM d EXCEPT SELECT 1) z", (1,)),
        ("SELECT t, row_number() OVER (ORDER BY id DESC) AS k FROM d ORDER BY k LIMIT 1", ("b", 1)),
        ("SELECT v FROM d LATERAL VIEW explode(array(id, 9)) e AS v WHERE id = 2 AND t IN ('b') GROUP BY v HAVING v > 5", (9,)),
    ):
        assert tuple(V.read_only_sql(spark, sql, d=d).first()) == want, sql


def test_registry_latest_wins(spark):
    d = spark.createDataFrame([("/a/b/", "old", 1), ("/a/b", "new", 2), ("a/b", "x", 3), ("/a/../b", "x", 4), ("/", "root", 5)], "path string, name string, seq int")
    assert sorted(map(tuple, V.registry(d).collect())) == [("/", "root", 5), ("/a/b", "new", 2)]


def test_markdown_of_nulls_bars_and_empty(spark):
    d = spark.createDataFrame([(1, "a|b"), (2, None)], "id int, t string")
    got = [r["line"] for r in V.markdown_rows(d, ["id"]).orderBy("section", "key").collect()]
    assert got == ["| id | t |", "| --- | --- |", "| 1 | a\\|b |", "| 2 |  |", "row_count: 2"]
    assert V.markdown_rows(d.where("false"), ["id"]).count() == 3


def test_like_takes_wildcards_as_text(spark):
    d = spark.createDataFrame([("100%", "x"), ("1000", "x"), ("a_b", "x"), ("acb", "A_B")], "n string, c string")
    assert [r["n"] for r in S.like(d, "0%", "n", "c").collect()] == ["100%"]
    assert sorted((r["n"], r["place"]) for r in S.like(d, "a_b", "n", "c").collect()) == [("a_b", 0), ("acb", 1)]


def test_bfs_discovers_in_queue_order(spark):
    rnd = random.Random(4)
    arcs = list({(rnd.randrange(60), rnd.randrange(60)) for _ in range(200)})
    e = spark.createDataFrame([(a, b, "CALLS", 1.0, i) for i, (a, b) in enumerate(arcs)], "src int, dst int, type string, confidence double, edge_seq int")
    starts = [3, 9]
    got = {r["id"]: (r["depth"], r["via"]) for r in G.bfs(e, spark.createDataFrame([(x,) for x in starts], "id int"), max_depth=None).collect()}
    want, queue = {x: (0, None) for x in starts}, deque(starts)
    while queue:
        x = queue.popleft()
        for a, b in arcs:
            if a == x and b not in want:
                want[b] = (want[x][0] + 1, x)
                queue.append(b)
    assert got == want
    assert {r["id"] for r in G.reach(e, spark.createDataFrame([(3,)], "id int")).collect()} <= set(want)
