"""Queries over the code-graph projections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import communities as C
from ..operators import graph as G
from ..operators import modules as M
from ..operators import project as P
from ..operators import resolve as R
from .projections import cte, frame, table
from .registry import Registry

q = Registry()

TEST1 = "regexp_matches(lower(file_path), '" + T.TEST_1.replace("'", "''") + "')"
START = "(SELECT src FROM calls ORDER BY edge_seq LIMIT 1)"


def _start(e):
    return e.orderBy("edge_seq").limit(1).select(F.col("src").alias("id"))


def _steps(s, d):
    """Process steps with parts as nodes: the lines of an order."""
    return frame(s, d, "lines").select(F.col("l_orderkey").alias("process_id"), F.col("l_partkey").alias("node_id"), F.col("ln").alias("step"))


LSTEPS = "SELECT l_orderkey AS process_id, l_partkey AS node_id, ln AS step FROM lines"


@q("j1_out_neighbours", cte("calls", "nodes") + "SELECT src AS node, dst AS other, type, round(confidence, 6) AS confidence, 'out' AS direction FROM calls JOIN nodes ON id = dst")
def _(s, d):
    return G.neighbours(frame(s, d, "calls"), frame(s, d, "nodes")).select("node", "other", "type", F.round("confidence", 6).alias("confidence"), "direction")


@q("j2_in_neighbours", cte("calls", "nodes") + "SELECT dst AS node, src AS other, type, round(confidence, 6) AS confidence, 'in' AS direction FROM calls JOIN nodes ON id = src")
def _(s, d):
    return G.neighbours(frame(s, d, "calls"), frame(s, d, "nodes"), "in").select("node", "other", "type", F.round("confidence", 6).alias("confidence"), "direction")


@q("j3_both_neighbours", cte("calls", "nodes") + """SELECT src AS node, dst AS other, type, round(confidence, 6) AS confidence, 'out' AS direction FROM calls JOIN nodes ON id = dst
UNION ALL SELECT dst, src, type, round(confidence, 6), 'in' FROM calls JOIN nodes ON id = src WHERE src <> dst""")
def _(s, d):
    return G.neighbours(frame(s, d, "calls"), frame(s, d, "nodes"), "both", loops_once=True).select("node", "other", "type", F.round("confidence", 6).alias("confidence"), "direction")


@q("p1_p2_label_and_edge_filter", cte("calls", "nodes") + "SELECT src, dst, round(confidence, 6) AS confidence FROM calls JOIN nodes ON id = src WHERE type = 'CALLS' AND confidence >= 0.1 AND label IN ('Function', 'Method')")
def _(s, d):
    n = frame(s, d, "nodes").where(F.col("label").isin("Function", "Method"))
    return G.select_edges(frame(s, d, "calls"), ["CALLS"], 0.1).join(n.select(F.col("id").alias("src")), "src").select("src", "dst", F.round("confidence", 6).alias("confidence"))


@q("p3_p6_path_predicates", cte("nodes") + f"""SELECT id, {TEST1} AS v1, regexp_matches(lower(file_path), '{T.TEST_2}') AS v2, regexp_matches(lower(file_path), '{T.TEST_3}') AS v3,
  regexp_matches(lower(file_path), '{T.UTILITY}') AS utility FROM nodes""")
def _(s, d):
    p = F.col("file_path")
    return frame(s, d, "nodes").select("id", T.is_test_v1(p).alias("v1"), T.is_test_v2(p).alias("v2"), T.is_test_v3(p).alias("v3"), T.is_utility(p).alias("utility"))


@q("g13_degrees", cte("calls") + "SELECT id, sum(i) AS callers, sum(o) AS callees FROM (SELECT src AS id, 0 AS i, 1 AS o FROM calls UNION ALL SELECT dst, 1, 0 FROM calls) x GROUP BY id")
def _(s, d):
    return G.degrees(frame(s, d, "calls"))


@q("g14_language_breakdown", cte("nodes") + "SELECT language, count(*) AS files, sum(start_line) AS bytes FROM nodes GROUP BY language")
def _(s, d):
    return M.language_breakdown(frame(s, d, "nodes").select("language", F.col("start_line").alias("bytes")))


@q("g15_graph_stats", cte("nodes", "calls") + "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM calls) AS relationships")
def _(s, d):
    return M.graph_stats(frame(s, d, "nodes"), frame(s, d, "calls"))


ENDS = "calls JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst"


@q("g16_module_edge_counts", cte("calls", "nodes") + f'SELECT a.community AS "from", b.community AS "to", count(*) AS count FROM {ENDS} WHERE a.community <> b.community GROUP BY 1, 2')
def _(s, d):
    return M.module_edge_counts(frame(s, d, "calls"), frame(s, d, "nodes"))


@q("g17_primary_community", cte("nodes") + """, c AS (SELECT file_path, community, row_number() OVER (PARTITION BY file_path ORDER BY count(*) DESC, community) AS k FROM nodes GROUP BY file_path, community),
s AS (SELECT community, count(*) AS files FROM c WHERE k = 1 GROUP BY community)
SELECT CASE WHEN files < 2 THEN '__other__' ELSE community END AS grp, sum(files) AS files FROM s GROUP BY 1 ORDER BY files DESC, grp LIMIT 30""")
def _(s, d):
    return M.primary_community(frame(s, d, "nodes"))


@q("g21_process_stats", cte("lines", "nodes") + """, p AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT community) AS c FROM lines LEFT JOIN nodes ON id = l_partkey GROUP BY l_orderkey)
SELECT count(*) AS processes, sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS cross_community, round(avg(n) + 1e-9, 1) AS avg_steps FROM p""")
def _(s, d):
    return M.process_stats(_steps(s, d), frame(s, d, "nodes").select("id", "community"))


@q("g36_glob_enrichment", cte("nodes") + "SELECT file_path, count(*) AS symbols, list_sort(list(DISTINCT language)) AS languages FROM nodes GROUP BY file_path")
def _(s, d):
    n = frame(s, d, "nodes")
    return M.glob_enrichment(n.select("file_path").distinct(), n)


@q("g37_dependency_counts", cte("hops") + "SELECT src, dst, 'CALLS' AS type, count(*) AS count FROM hops WHERE dst IS NOT NULL GROUP BY src, dst HAVING count(*) > 1")
def _(s, d):
    return M.dependency_counts(frame(s, d, "hops").where("dst IS NOT NULL").withColumn("type", F.lit("CALLS"))).where("count > 1")


@q("j5_node_processes", cte("lines") + "SELECT l_partkey AS node_id, count(DISTINCT l_orderkey) AS processes, min(ln) AS first_step FROM lines GROUP BY l_partkey")
def _(s, d):
    return _steps(s, d).groupBy("node_id").agg(F.count_distinct("process_id").alias("processes"), F.min("step").alias("first_step"))


@q("j6_w8_first_write", cte("hops") + """, e AS (SELECT src, dst, l_orderkey * 100 + ln AS edge_seq, row_number() OVER (PARTITION BY src, dst ORDER BY l_orderkey * 100 + ln) AS k FROM hops WHERE dst IS NOT NULL)
SELECT src, dst, edge_seq FROM e WHERE k = 1""")
def _(s, d):
    e = frame(s, d, "hops").where("dst IS NOT NULL").select("src", "dst", (F.col("l_orderkey") * 100 + F.col("ln")).alias("edge_seq"))
    return G.dedup_edges(e)


@q("j8_resolve_calls", cte("lines", "nodes") + """, c AS (SELECT l_orderkey * 100 + ln AS call_id, lower(replace(n.community, '#', '')) AS file, m.name FROM lines JOIN nodes n ON n.id = l_partkey JOIN nodes m ON m.id = l_suppkey),
defs AS (SELECT lower(replace(community, '#', '')) AS file, name, id AS node_id, def_seq FROM nodes), imp AS (SELECT DISTINCT lower(replace(a.community, '#', '')) AS file, lower(replace(b.community, '#', '')) AS imported FROM nodes a JOIN nodes b ON b.id = a.id + 1),
own AS (SELECT file, name, max_by(node_id, def_seq) AS own FROM defs GROUP BY 1, 2), one AS (SELECT file, name, min(def_seq) AS s FROM defs GROUP BY 1, 2),
via AS (SELECT imp.file, one.name, min(s) AS via FROM imp JOIN one ON one.file = imported GROUP BY 1, 2), w AS (SELECT name, min(def_seq) AS first, count(*) AS n FROM defs GROUP BY name)
SELECT call_id, coalesce(own, via, first) AS target, CASE WHEN own IS NOT NULL THEN 0.85 WHEN via IS NOT NULL THEN 0.9 WHEN n = 1 THEN 0.5 ELSE 0.3 END AS confidence,
  CASE WHEN own IS NOT NULL THEN 'same_file' WHEN via IS NOT NULL THEN 'imported' ELSE 'global' END AS tier
FROM c JOIN w ON w.name = c.name LEFT JOIN own ON own.file = c.file AND own.name = c.name LEFT JOIN via ON via.file = c.file AND via.name = c.name""")
def _(s, d):
    n, ln = frame(s, d, "nodes"), frame(s, d, "lines")
    f = F.lower(F.replace("community", F.lit("#"), F.lit("")))
    c = ln.join(n.select(F.col("id").alias("l_partkey"), f.alias("file")), "l_partkey").join(n.select(F.col("id").alias("l_suppkey"), "name"), "l_suppkey")
    defs = n.select(f.alias("file"), "name", F.col("id").alias("node_id"), "def_seq")
    imp = n.select("id", f.alias("file")).join(n.select((F.col("id") - 1).alias("id"), f.alias("imported")), "id").select("file", "imported")
    return R.resolve_calls(c.select((F.col("l_orderkey") * 100 + F.col("ln")).alias("call_id"), "file", "name"), defs, imp)


@q("j9_resolve_tiered", cte("nodes") + """, f AS (SELECT id, name, language AS file, community, def_seq FROM nodes), c AS (SELECT id AS call_id, file, 'x' AS k, (SELECT max(y.name) FROM f y WHERE y.id = (x.id * 7) % 200) AS name FROM f x),
d AS (SELECT file, name, min(def_seq) AS s FROM f GROUP BY 1, 2), cand AS (
  SELECT c.call_id, 1 AS r, 0 AS q, s FROM c JOIN d ON d.file = c.file AND d.name = c.name
  UNION ALL SELECT c.call_id, 3, i.q, s FROM c JOIN (VALUES ('python', 'java', 1), ('java', 'go', 1), ('go', 'java', 2), ('go', 'python', 1)) i(file, imported, q) ON i.file = c.file JOIN d ON d.file = i.imported AND d.name = c.name
  UNION ALL SELECT c.call_id, 4, 0, (SELECT min(s) FROM d WHERE d.name = c.name) FROM c WHERE c.name IN (SELECT name FROM d)),
b AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY r, q, s) AS k FROM cand)
SELECT call_id, s AS target, CASE r WHEN 1 THEN 1.0 WHEN 3 THEN 0.7 ELSE 0.3 END AS confidence, r AS tier FROM b WHERE k = 1""")
def _(s, d):
    n = frame(s, d, "nodes")
    names = n.select(F.col("id").alias("k"), "name")
    c = n.select(F.col("id").alias("call_id"), F.col("language").alias("file"), ((F.col("id") * 7) % 200).alias("k")).join(names, "k").select("call_id", "file", "name")
    defs = n.select(F.col("language").alias("file"), "name", F.col("id").alias("node_id"), "def_seq")
    imp = s.createDataFrame([("python", "java", 1), ("java", "go", 1), ("go", "java", 2), ("go", "python", 1)], "file string, imported string, import_seq int")
    named = s.createDataFrame([], "file string, name string, imported string")
    return R.resolve_tiered(c, defs, imp, named)


@q("j10_resolve_heritage", cte("nodes") + """, r AS (SELECT file_path AS file, name AS child, language AS parent, 'EXTENDS' AS kind FROM nodes), e AS (SELECT file_path AS file, name AS child, max_by(id, def_seq) AS exact FROM nodes GROUP BY 1, 2),
f AS (SELECT name, min_by(id, def_seq) AS id FROM nodes GROUP BY name)
SELECT coalesce(CAST(exact AS VARCHAR), CAST(f.id AS VARCHAR), 'Class:' || r.child) AS src, coalesce(CAST(g.id AS VARCHAR), 'Class:' || parent) AS dst, kind AS type FROM r LEFT JOIN e ON e.file = r.file AND e.child = r.child LEFT JOIN f ON f.name = r.child LEFT JOIN f g ON g.name = parent""")
def _(s, d):
    n = frame(s, d, "nodes")
    rows = n.select(F.col("file_path").alias("file"), F.col("name").alias("child"), F.col("language").alias("parent"), F.lit("EXTENDS").alias("kind"))
    return R.resolve_heritage(rows, n.select(F.col("file_path").alias("file"), "name", F.col("id").alias("node_id"), "def_seq"))


@q("j16_innermost_scope", cte("nodes") + """, p AS (SELECT id AS point_id, community AS file, start_line + 5 AS line FROM nodes),
h AS (SELECT point_id, n.id AS scope_id, row_number() OVER (PARTITION BY point_id ORDER BY n.end_line - n.start_line, n.id) AS k FROM p JOIN nodes n ON n.community = p.file AND line BETWEEN n.start_line AND n.end_line)
SELECT point_id, scope_id FROM h WHERE k = 1""")
def _(s, d):
    n = frame(s, d, "nodes")
    p = n.select(F.col("id").alias("point_id"), F.col("community").alias("file"), (F.col("start_line") + 5).alias("line"))
    return R.innermost_scope(p, n.select(F.col("community").alias("file"), F.col("id").alias("scope_id"), "start_line", "end_line"))


@q("j18_a31_detect_changes", cte("nodes", "lines") + """, s AS (SELECT id FROM nodes WHERE file_path IN (SELECT DISTINCT file_path FROM nodes WHERE start_line = 12)),
x AS (SELECT (SELECT count(*) FROM s) AS symbols, (SELECT count(DISTINCT l_orderkey) FROM lines WHERE l_partkey IN (SELECT id FROM s)) AS processes)
SELECT symbols, processes, CASE WHEN symbols = 0 THEN 'none' WHEN processes = 0 THEN 'low' WHEN processes <= 5 THEN 'medium' WHEN processes <= 15 THEN 'high' ELSE 'critical' END AS risk FROM x""")
def _(s, d):
    n = frame(s, d, "nodes")
    return M.detect_changes(n.where("start_line = 12").select("file_path"), n, _steps(s, d))


@q("j19_inter_file_calls", cte("calls", "nodes") + 'SELECT DISTINCT a.file_path AS "from", b.file_path AS "to" FROM calls JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.file_path <> b.file_path')
def _(s, d):
    return M.inter_file_calls(frame(s, d, "calls"), frame(s, d, "nodes"))


@q("j20_intra_module_calls", cte("calls", "nodes") + "SELECT src, dst FROM calls WHERE src IN (SELECT id FROM nodes WHERE community = 'Brand#1') AND dst IN (SELECT id FROM nodes WHERE community = 'Brand#1')")
def _(s, d):
    m = frame(s, d, "nodes").where("community = 'Brand#1'")
    return M.intra_calls(frame(s, d, "calls"), m).select("src", "dst")


@q("j21_crossing_calls", cte("calls", "nodes") + """, m AS (SELECT id FROM nodes WHERE community = 'Brand#1')
(SELECT src, dst, 'out' AS way FROM calls WHERE src IN (SELECT id FROM m) AND dst NOT IN (SELECT id FROM m) ORDER BY edge_seq LIMIT 30) UNION ALL
(SELECT src, dst, 'in' FROM calls WHERE src NOT IN (SELECT id FROM m) AND dst IN (SELECT id FROM m) ORDER BY edge_seq LIMIT 30)""")
def _(s, d):
    m = frame(s, d, "nodes").where("community = 'Brand#1'")
    return M.crossing_calls(frame(s, d, "calls"), m).select("src", "dst", "way")


@q("j23_files_with_exports", cte("nodes") + "SELECT file_path, list_sort(list(DISTINCT name)) AS exports, count(*) AS n_exports FROM nodes WHERE is_exported GROUP BY file_path")
def _(s, d):
    return M.files_with_exports(frame(s, d, "nodes"))


@q("j25_longest_prefix", cte("nodes") + """, r(repo, root) AS (VALUES ('python', 'src'), ('java', 'src/core'), ('go', 'app/api')),
h AS (SELECT id, repo, row_number() OVER (PARTITION BY id ORDER BY length(root) DESC, repo DESC) AS k FROM nodes JOIN r ON file_path LIKE root || '/%') SELECT id, repo FROM h WHERE k = 1""")
def _(s, d):
    r = s.createDataFrame([("python", "src"), ("java", "src/core"), ("go", "app/api")], "repo string, root string")
    return R.longest_prefix(frame(s, d, "nodes").select("id", F.col("file_path").alias("path")), r)


@q("j26_grep_enrichment", cte("nodes") + """, h AS (SELECT event_id AS hit_id, CASE event_type WHEN 'click' THEN 'red_widget' WHEN 'view' THEN 'blue_bolt' ELSE event_type END AS match_text FROM events),
f AS (SELECT name, min(def_seq) AS s FROM nodes GROUP BY name), g AS (SELECT f.name, id, label, file_path FROM f JOIN nodes n ON n.def_seq = f.s)
SELECT hit_id, coalesce(CAST(id AS VARCHAR), '') AS symbol, coalesce(label, '') AS label, coalesce(file_path, '') AS file_path FROM h LEFT JOIN g ON g.name = match_text""")
def _(s, d):
    t = F.expr("CASE event_type WHEN 'click' THEN 'red_widget' WHEN 'view' THEN 'blue_bolt' ELSE event_type END")
    return M.grep_enrichment(table(s, d, "events").select(F.col("event_id").alias("hit_id"), t.alias("match_text")), frame(s, d, "nodes"))


WALK = cte("calls", recursive=True)


@q("a1_bfs", WALK + f""", w AS (SELECT {START} AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN calls ON src = id WHERE depth < 6)
SELECT id, min(depth) AS depth FROM w GROUP BY id""")
def _(s, d):
    e = frame(s, d, "calls")
    return G.bfs(e, _start(e), "out", ["CALLS"], 6).select("id", "depth")


@q("a1_bfs_both_ways", WALK + f""", u AS (SELECT src, dst FROM calls UNION ALL SELECT dst, src FROM calls), w AS (SELECT {START} AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN u ON src = id WHERE depth < 4)
SELECT id, min(depth) AS depth FROM w GROUP BY id""")
def _(s, d):
    e = frame(s, d, "calls")
    return G.bfs(e, _start(e), "both", None, 4).select("id", "depth")


@q("a2_impact", cte("calls", "nodes", "lines", recursive=True) + f""", w AS (SELECT {START} AS id, 0 AS depth UNION SELECT src, depth + 1 FROM w JOIN calls ON dst = id WHERE depth < 4),
h AS (SELECT id, min(depth) AS depth FROM w GROUP BY id HAVING min(depth) > 0), x AS (SELECT (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h WHERE depth = 1) AS direct,
  least(20, (SELECT count(DISTINCT l_orderkey) FROM lines WHERE l_partkey IN (SELECT id FROM h))) AS processes, least(20, (SELECT count(DISTINCT community) FROM nodes WHERE id IN (SELECT id FROM h))) AS modules)
SELECT *, CASE WHEN direct >= 30 OR processes >= 5 OR modules >= 5 OR total >= 200 THEN 'CRITICAL' WHEN direct >= 15 OR processes >= 3 OR modules >= 3 OR total >= 100 THEN 'HIGH' WHEN direct >= 5 OR total >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x""")
def _(s, d):
    e = frame(s, d, "calls")
    r = G.bfs(e, _start(e), "in", ["CALLS"], 4)
    return G.impact(r, frame(s, d, "nodes").select("id", "community"), _steps(s, d))


DEG = """, deg AS (SELECT id, sum(i) AS callers, sum(o) AS callees FROM (SELECT src AS id, 0 AS i, 1 AS o FROM calls UNION ALL SELECT dst, 1, 0 FROM calls) x GROUP BY id)"""
DEAD = (DEG + f""", sym AS (SELECT n.*, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees FROM nodes n LEFT JOIN deg ON deg.id = n.id WHERE label IN ('Function', 'Method', 'Class', 'Constructor') AND NOT {TEST1}),
ent AS (SELECT id, round(callees * 1.0 / (callers + 1) * CASE WHEN is_exported THEN 2 ELSE 1 END, 6) AS score FROM sym WHERE callees * 1.0 / (callers + 1) * CASE WHEN is_exported THEN 2 ELSE 1 END >= 1.5),
live AS (SELECT id FROM ent UNION SELECT dst FROM live JOIN calls ON src = id)""")


@q("a3_entry_points", cte("calls", "nodes", recursive=True) + DEAD + "SELECT id, score FROM ent")
def _(s, d):
    return G.entry_points(frame(s, d, "nodes"), frame(s, d, "calls"), T.is_test_v1(F.col("file_path")))


@q("a4_reachable", cte("calls", "nodes", recursive=True) + DEAD + "SELECT id FROM live")
def _(s, d):
    e = frame(s, d, "calls")
    return G.reach(e, G.entry_points(frame(s, d, "nodes"), e, T.is_test_v1(F.col("file_path"))))


@q("a5_dead_code", cte("calls", "nodes", recursive=True) + DEAD + f""", c AS (SELECT id, name, CASE WHEN regexp_matches(name, '{G.DYNAMIC_NAME}') THEN 0.3 WHEN language = 'python' THEN 0.6 WHEN is_exported THEN 0.6 ELSE 0.9 END AS confidence,
  CASE WHEN regexp_matches(name, '{G.DYNAMIC_NAME}') THEN 'dynamic-pattern-name' WHEN language = 'python' THEN 'dynamic-language' WHEN is_exported THEN 'exported-but-unreachable' ELSE 'static-unreachable' END AS reason
  FROM sym WHERE id NOT IN (SELECT id FROM live) AND NOT (starts_with(name, '__') AND ends_with(name, '__')))
SELECT * FROM c WHERE confidence >= 0.5""")
def _(s, d):
    return G.dead_code(frame(s, d, "nodes"), frame(s, d, "calls"), T.is_test_v1(F.col("file_path")))


@q("a5_dead_code_in_modules", cte("module_calls", "nodes", recursive=True) + DEAD.replace(" calls", " module_calls") + f""", c AS (SELECT id, name, CASE WHEN regexp_matches(name, '{G.DYNAMIC_NAME}') THEN 0.3 WHEN language = 'python' THEN 0.6 WHEN is_exported THEN 0.6 ELSE 0.9 END AS confidence,
  CASE WHEN regexp_matches(name, '{G.DYNAMIC_NAME}') THEN 'dynamic-pattern-name' WHEN language = 'python' THEN 'dynamic-language' WHEN is_exported THEN 'exported-but-unreachable' ELSE 'static-unreachable' END AS reason
  FROM sym WHERE id NOT IN (SELECT id FROM live) AND NOT (starts_with(name, '__') AND ends_with(name, '__')))
SELECT * FROM c WHERE confidence >= 0.5""")
def _(s, d):
    return G.dead_code(frame(s, d, "nodes"), frame(s, d, "module_calls"), T.is_test_v1(F.col("file_path")))


@q("a8_modularity", cte("calls", "nodes") + """, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM calls WHERE src <> dst), j AS (SELECT x.community AS ca, y.community AS cb FROM u JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b),
m AS (SELECT count(*) AS m FROM j), e AS (SELECT c, count(*) AS d FROM (SELECT ca AS c FROM j UNION ALL SELECT cb FROM j) z GROUP BY c), l AS (SELECT ca AS c, count(*) AS l FROM j WHERE ca = cb GROUP BY ca)
SELECT round(sum(coalesce(l, 0) * 1.0 / m - power(d / (2.0 * m), 2)), 6) AS modularity, count(*) AS communities FROM e LEFT JOIN l ON l.c = e.c, m""")
def _(s, d):
    return G.modularity(frame(s, d, "calls"), frame(s, d, "nodes").select("id", "community"))


@q("a6_communities")
def _(s, d):
    v, pairs, resolution = C.community_graph(frame(s, d, "nodes"), frame(s, d, "calls"))
    return C.communities(pairs, v, resolution)


@q("a7_communities_with_constructors")
def _(s, d):
    v, pairs, resolution = C.community_graph(frame(s, d, "nodes"), frame(s, d, "calls"), (*C.SYMBOL_LABELS, "Constructor"), large_from=None)
    return C.communities(pairs, v, resolution)


@q("a9_community_labels", cte("nodes") + """, f AS (SELECT community, split_part(file_path, '/', 2) AS f, count(*) AS n FROM nodes WHERE lower(split_part(file_path, '/', 2)) NOT IN ('src', 'lib', 'core', 'utils', 'common', 'shared', 'helpers') GROUP BY 1, 2),
b AS (SELECT community, f, row_number() OVER (PARTITION BY community ORDER BY n DESC, f) AS k FROM f)
SELECT c.community, coalesce(upper(substr(f, 1, 1)) || substr(f, 2), 'Cluster_' || c.community) AS label FROM (SELECT DISTINCT community FROM nodes) c LEFT JOIN b ON b.community = c.community AND k = 1""")
def _(s, d):
    n = frame(s, d, "nodes")
    return G.community_labels(n.select("id", "community"), n)


@q("a10_cohesion", cte("calls", "nodes") + """, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM calls WHERE src <> dst), j AS (SELECT x.community AS ca, y.community AS cb FROM u JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b),
e AS (SELECT ca AS c, CASE WHEN ca = cb THEN 1 ELSE 0 END AS i FROM j UNION ALL SELECT cb, CASE WHEN ca = cb THEN 1 ELSE 0 END FROM j), g AS (SELECT c, round(avg(i), 4) AS s FROM e GROUP BY c)
SELECT n.community, count(*) AS members, 1.0 AS cohesion, coalesce(max(s), 0) AS internal_share FROM nodes n LEFT JOIN g ON g.c = n.community GROUP BY n.community""")
def _(s, d):
    return G.cohesion(frame(s, d, "calls"), frame(s, d, "nodes").select("id", "community"))


U, E = T.UTILITY_NAME.replace("'", "''"), T.ENTRY_NAME.replace("'", "''")
SCORE = f"callees * 1.0 / (callers + 1) * CASE WHEN is_exported THEN 2 ELSE 1 END * CASE WHEN regexp_matches(name, '{U}') THEN 0.3 WHEN regexp_matches(name, '{E}') THEN 1.5 ELSE 1 END"


@q("a11_a13_entry_score", cte("calls", "nodes") + DEG + f"""SELECT n.id, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees,
  round(CASE WHEN coalesce(callees, 0) = 0 THEN 0 ELSE {SCORE} * CASE WHEN regexp_matches(file_path, '/api/.*[.]py$') OR file_path LIKE 'app/api/%' THEN 2 ELSE 1 END END, 6) AS score,
  round(CASE WHEN coalesce(callees, 0) = 0 THEN 0 ELSE {SCORE} * CASE WHEN regexp_matches(file_path, '{T.TEST_2}') THEN 0.1 ELSE 1 END END, 6) AS score_v2
FROM nodes n LEFT JOIN deg ON deg.id = n.id""")
def _(s, d):
    n = frame(s, d, "nodes").join(G.degrees(frame(s, d, "calls")), "id", "left").na.fill(0, ["callers", "callees"])
    a = (F.col("name"), F.col("is_exported"), F.col("callers"), F.col("callees"), F.col("file_path"))
    return n.select("id", "callers", "callees", T.entry_score(*a).alias("score"), T.entry_score(*a, with_framework=False, test_penalty=True).alias("score_v2"))


STRONG = cte("calls", recursive=True) + ", g AS (SELECT src, dst, edge_seq FROM calls)"


@q("a24_strong_components", STRONG + """, w AS (SELECT src AS a, dst AS b FROM g UNION SELECT w.a, g.dst FROM w JOIN g ON g.src = w.b)
SELECT x.a AS node, least(min(y.a), x.a) AS component FROM w x JOIN w y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a""")
def _(s, d):
    return G.strong_components(frame(s, d, "calls"))


@q("a24_strong_components_in_modules", cte("module_calls", recursive=True) + """, g AS (SELECT src, dst FROM module_calls), w AS (SELECT src AS a, dst AS b FROM g UNION SELECT w.a, g.dst FROM w JOIN g ON g.src = w.b)
SELECT x.a AS node, least(min(y.a), x.a) AS component FROM w x JOIN w y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b GROUP BY x.a""")
def _(s, d):
    return G.strong_components(frame(s, d, "module_calls"))


@q("a25_a26_claim_scores", STRONG + """, nn AS (SELECT l_partkey AS id, CASE WHEN l_partkey % 3 = 0 THEN 'requirement' WHEN l_partkey % 3 = 1 THEN 'specification' ELSE 'implementation' END AS node_type FROM (SELECT DISTINCT l_partkey FROM lines) z),
w AS (SELECT src AS a, dst AS b FROM g UNION SELECT w.a, g.dst FROM w JOIN g ON g.src = w.b), cyc AS (SELECT DISTINCT x.a AS id FROM w x JOIN w y ON y.a = x.b AND y.b = x.a WHERE x.a <> x.b),
con AS (SELECT src AS id FROM g WHERE edge_seq % 5 = 0 UNION SELECT dst FROM g WHERE edge_seq % 5 = 0),
f AS (SELECT id, CASE WHEN id IN (SELECT id FROM cyc) THEN 1 ELSE 0 END AS cycle, CASE WHEN id IN (SELECT id FROM con) THEN 1 ELSE 0 END AS conflict, CASE WHEN id NOT IN (SELECT dst FROM g) AND node_type <> 'requirement' THEN 1 ELSE 0 END AS orphan, CASE WHEN node_type = 'requirement' THEN 0.1 ELSE 0 END AS bonus FROM nn),
s AS (SELECT *, round(greatest(0, least(1, 1 - 0.3 * cycle - 0.25 * conflict - 0.1 * orphan + bonus)), 6) AS score FROM f)
SELECT id, cycle, conflict, orphan, score, score >= 0.6 AS passed FROM s""")
def _(s, d):
    e = frame(s, d, "calls").withColumn("type", F.when(F.col("edge_seq") % 5 == 0, "contradicts").otherwise("supports"))
    n = frame(s, d, "lines").select(F.col("l_partkey").alias("id")).distinct()
    kind = F.when(F.col("id") % 3 == 0, "requirement").when(F.col("id") % 3 == 1, "specification").otherwise("implementation")
    return G.claim_node_scores(n.withColumn("node_type", kind), e)


@q("a22_a23_propagation", WALK + f""", w AS (SELECT {START} AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN calls ON src = id WHERE depth < 5),
h AS (SELECT id, min(depth) AS depth FROM w GROUP BY id HAVING min(depth) > 0) SELECT count(*) AS paths, coalesce(max(depth), 0) AS max_depth, CASE WHEN count(*) = 0 THEN 0 ELSE 1.0 END AS impact FROM h""")
def _(s, d):
    e = frame(s, d, "calls")
    return G.propagation_impact(G.propagation(e, _start(e).first()[0]))


@q("a30_folder_tree", cte("hierarchy") + """, p AS (SELECT string_split(path, '/') AS p FROM hierarchy), x AS (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM p)
SELECT DISTINCT array_to_string(p[1:k], '/') AS id, CASE WHEN k = len(p) THEN 'File' ELSE 'Folder' END AS label, p[k] AS name, CASE WHEN k > 1 THEN array_to_string(p[1:k - 1], '/') END AS parent FROM x""")
def _(s, d):
    return G.folder_tree(frame(s, d, "hierarchy"))


@q("a32_context", cte("calls", "lines") + f""", s AS (SELECT {START} AS id), e AS (SELECT src AS id, 'out' AS direction, type, dst AS other FROM calls UNION ALL SELECT dst, 'in', type, src FROM calls)
SELECT e.id, direction, type, list_sort(list(other)) AS refs, (SELECT count(*) FROM lines WHERE l_partkey = e.id) AS processes FROM e JOIN s ON s.id = e.id GROUP BY e.id, direction, type""")
def _(s, d):
    e = frame(s, d, "calls")
    return G.context(frame(s, d, "nodes"), e, _steps(s, d), _start(e))


TRUSTED = DEG.replace("FROM calls", "FROM tiered_calls WHERE confidence >= 0.5")
AST = "CASE WHEN start_line % 10 = 0 THEN 3.0 ELSE 1.0 END"


@q("a15_trace_entries", cte("tiered_calls", "nodes") + TRUSTED + f"""SELECT id, round(score * {AST}, 6) AS score FROM (SELECT n.id, start_line, round({SCORE} * CASE WHEN regexp_matches(file_path, '/api/.*[.]py$') OR file_path LIKE 'app/api/%' THEN 2 ELSE 1 END, 6) AS score
  FROM nodes n JOIN deg ON deg.id = n.id WHERE callees > 0 AND label IN ('Function', 'Method') AND NOT regexp_matches(replace(lower(file_path), chr(92), '/'), '{T.TEST_1}')) x
WHERE score > 0 ORDER BY 2 DESC, id LIMIT 200""")
def _(s, d):
    return _entries(s, d)


def _entries(s, d):
    return G.trace_entries(frame(s, d, "nodes"), frame(s, d, "tiered_calls"), T.is_test_v1(F.col("file_path")), multiplier=F.expr("CASE WHEN start_line % 10 = 0 THEN 3.0D ELSE 1.0D END"))


@q("a15_a16_traces")
def _(s, d):
    return G.trace_processes(frame(s, d, "tiered_calls"), _entries(s, d))


@q("a17_a18_distinct_traces")
def _(s, d):
    return G.longest_per_ends(G.drop_contained(G.trace_processes(frame(s, d, "tiered_calls"), _entries(s, d))), G.MAX_PROCESSES).select("entry", "rank", "path")


@q("a19_process_names", cte("steps") + """SELECT process_id, count(*) AS n_steps, min_by(label, step) || ' -> ' || max_by(label, step) AS label FROM steps GROUP BY process_id""")
def _(s, d):
    return M.process_names(frame(s, d, "steps"))


@q("x11_module_diagram")
def _(s, d):
    return M.module_diagram(M.module_edge_counts(frame(s, d, "calls"), frame(s, d, "nodes")))


@q("x7_prefix_within_budget", """SELECT doc_id, source, n_chars, used FROM (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) x WHERE used <= 20000""")
def _(s, d):
    t = table(s, d, "documents").select("doc_id", "source", "n_chars")
    return M.prefix_within_budget(t, 20000, "doc_id", "n_chars", "source")


@q("s4_pack_chunks", """WITH RECURSIVE f AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r AS (SELECT source, doc_id, n_chars, k, 0 AS chunk, n_chars AS used FROM f WHERE k = 1
  UNION ALL SELECT f.source, f.doc_id, f.n_chars, f.k, CASE WHEN used > 0 AND used + f.n_chars > 20000 THEN chunk + 1 ELSE chunk END, CASE WHEN used > 0 AND used + f.n_chars > 20000 THEN f.n_chars ELSE used + f.n_chars END
  FROM r JOIN f ON f.source = r.source AND f.k = r.k + 1)
SELECT source, doc_id, n_chars, chunk FROM r""")
def _(s, d):
    return M.pack_chunks(table(s, d, "documents"), 20000, "source", "doc_id", "n_chars")


@q("u4_except", cte("nodes") + "SELECT DISTINCT name FROM nodes WHERE label = 'Function' EXCEPT SELECT name FROM nodes WHERE label = 'Method'")
def _(s, d):
    n = frame(s, d, "nodes")
    return n.where("label = 'Function'").select("name").distinct().join(n.where("label = 'Method'").select("name"), "name", "left_anti")


@q("w10_rank_strategies", cte("nodes") + """, p AS (SELECT id AS problem_id, CASE WHEN start_line % 4 = 0 THEN [] ELSE [language, label] END AS traits FROM nodes),
s(strategy_id, tier, weight, has) AS (VALUES ('a', 1, 0.9, ['python', 'Function']), ('b', 1, 0.8, ['java', 'Class', 'Method']), ('c', 2, 0.7, ['go']), ('d', 2, 0.95, []), ('e', 3, 0.6, ['Function', 'Class', 'go', 'python'])),
j AS (SELECT problem_id, strategy_id, tier, CASE WHEN len(traits) = 0 OR len(has) = 0 THEN weight * 0.1 ELSE weight * len(list_filter(traits, lambda t: list_contains(has, t))) / len(traits) END AS score FROM p, s),
r AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY round(score, 9) DESC, tier, strategy_id) AS rank FROM j) SELECT problem_id, rank, strategy_id, round(score, 4) AS score FROM r WHERE rank <= 4""")
def _(s, d):
    reg = [("a", 1, 0.9, ["python", "Function"]), ("b", 1, 0.8, ["java", "Class", "Method"]), ("c", 2, 0.7, ["go"]), ("d", 2, 0.95, []), ("e", 3, 0.6, ["Function", "Class", "go", "python"])]
    st = s.createDataFrame(reg, "strategy_id string, tier int, weight double, traits array<string>")
    traits = F.when(F.col("start_line") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("language", "label"))
    return M.rank_strategies(st, frame(s, d, "nodes").select(F.col("id").alias("problem_id"), traits.alias("traits")))


@q("a20_process_cap", cte("nodes") + "SELECT CAST(greatest(20, least(300, round(sum(CASE WHEN label = 'File' THEN 0 ELSE 1 END) / 10.0))) AS INTEGER) AS cap FROM nodes")
def _(s, d):
    return P.process_cap(frame(s, d, "nodes"))


@q("a35_commits_behind", "SELECT count(*) AS behind, count(*) > 0 AS stale FROM orders WHERE o_orderkey > 500")
def _(s, d):
    return P.commits_behind(table(s, d, "orders"), 500, "o_orderkey")


@q("g38_project_framework", cte("nodes") + """SELECT community, CASE WHEN sum(CASE WHEN file_path LIKE '%manage.py' THEN 1 ELSE 0 END) >= 1 THEN 'django' WHEN sum(CASE WHEN contains(file_path || community, 'flask') THEN 1 ELSE 0 END) >= 1 THEN 'flask' ELSE 'unknown' END AS framework, 0.0 AS confidence FROM nodes GROUP BY community""")
def _(s, d):
    return P.project_framework(frame(s, d, "nodes").withColumnRenamed("file_path", "path"), "community")


@q("u6_missing_keys", "SELECT event_id, len(list_filter(['k', 'v'], lambda x: NOT list_contains(json_keys(props), x))) AS missing FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.size(P.missing_keys(F.col("props"), ["k", "v"])).alias("missing"))


@q("g30_overall_score", STRONG + ", deg AS (SELECT dst, count(*) AS n FROM g GROUP BY dst) SELECT round(avg(least(1.0, n / 3.0)), 4) AS overall FROM deg")
def _(s, d):
    n = frame(s, d, "calls").groupBy("dst").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.avg(F.least(F.lit(1.0), F.col("n") / 3)) + 1e-9, 4).alias("overall"))


@q("a14_framework_of_text", "SELECT doc_id, CASE WHEN contains(lower(substr(text, 1, 300)), '@app.get') THEN 'fastapi' END AS framework FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", P.framework_of_text(F.lit("python"), F.col("text"))["framework"].alias("framework"))


@q("a34_augment")
def _(s, d):
    return P.augment(frame(s, d, "nodes"), frame(s, d, "calls"), _steps(s, d), "red bolt")


@q("a21_member_traces")
def _(s, d):
    e = frame(s, d, "module_calls")
    n = G.trace_entries(frame(s, d, "nodes"), e.withColumn("confidence", F.lit(1.0)), T.is_test_v1(F.col("file_path")))
    return G.drop_subsets(G.trace_members(e, n.select("id")), n)
