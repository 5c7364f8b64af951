"""Queries over the views of a stored graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import views as V
from ..functions.cut import cut, new_path
from ..sources.scan import scan
from ..sources.versions import Versions, build, reindex
from .projections import cte, frame, table
from .registry import Registry

q = Registry()


def _steps(s, d):
    return frame(s, d, "lines").select(F.col("l_orderkey").alias("process_id"), F.col("l_partkey").alias("node_id"), F.col("ln").alias("step"))


@q("l3_cluster_members", cte("nodes") + """SELECT community, rank, id, name, label, file_path FROM (
  SELECT *, row_number() OVER (PARTITION BY community ORDER BY name, id) AS rank FROM nodes) x WHERE rank <= 30""")
def _(s, d):
    n = frame(s, d, "nodes")
    return V.cluster_members(n, n.select("id", "community"))


@q("l4_processes_with_steps", cte("lines", "nodes") + """, b AS (SELECT l_orderkey, count(*) AS n_steps FROM lines GROUP BY l_orderkey ORDER BY n_steps DESC, l_orderkey LIMIT 20)
SELECT l_orderkey AS process_id, n_steps, ln AS step, name FROM lines JOIN b USING (l_orderkey) JOIN nodes ON id = l_partkey""")
def _(s, d):
    p = V.processes_with_steps(_steps(s, d), frame(s, d, "nodes"))
    return p.select("process_id", "n_steps", F.explode("steps").alias("x")).select("process_id", "n_steps", "x.step", "x.name")


@q("l5_cross_community", cte("lines", "nodes") + """SELECT l_orderkey AS process_id, count(*) AS n_steps, count(DISTINCT community) AS communities FROM lines LEFT JOIN nodes ON id = l_partkey
GROUP BY l_orderkey HAVING count(DISTINCT community) > 1 ORDER BY n_steps DESC, process_id LIMIT 10""")
def _(s, d):
    return V.cross_community_processes(_steps(s, d), frame(s, d, "nodes").select("id", "community"))


@q("p14_tool_symbols", cte("nodes") + """SELECT id AS uid, name, label AS kind, file_path AS "filePath", start_line AS line FROM nodes""")
def _(s, d):
    return V.tool_symbols(frame(s, d, "nodes"))


@q("p16_markdown", """SELECT section, line FROM (SELECT 0 AS section, '| n_name | n_regionkey |' AS line UNION ALL SELECT 1, '| --- | --- |'
  UNION ALL SELECT 2, '| ' || n_name || ' | ' || n_regionkey || ' |' FROM nation UNION ALL SELECT 3, 'row_count: ' || count(*) FROM nation) x""")
def _(s, d):
    return V.markdown_rows(table(s, d, "nation").select("n_name", "n_regionkey"), ["n_name"]).select("section", "line")


@q("s14_registry", """SELECT '/repos/' || user_id % 50 AS path, arg_max('r' || event_id, event_id) AS name, max(event_id) AS seq FROM events WHERE user_id % 7 <> 0 GROUP BY 1""")
def _(s, d):
    e = table(s, d, "events")
    bad = F.when(F.col("event_id") % 2 == 0, F.lit("repos/x")).otherwise(F.lit("/repos/../x"))
    path = F.when(F.col("user_id") % 7 == 0, bad).otherwise(F.concat(F.lit("/repos/"), (F.col("user_id") % 50).cast("string"), F.lit("/")))
    return V.registry(e.select(path.alias("path"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("name"), F.col("event_id").alias("seq")))


@q("j27_module_tree", cte("nodes") + """, o AS (SELECT regexp_replace(file_path, '/[^/]*$', '') AS module, file_path, CASE WHEN label <> 'File' THEN name END AS name FROM nodes),
f AS (SELECT module, name, row_number() OVER (PARTITION BY module ORDER BY name) AS k FROM (SELECT DISTINCT module, name FROM o WHERE name IS NOT NULL) x)
SELECT o.module, count(DISTINCT file_path) AS files, count(name) AS symbols, (SELECT string_agg(name, ',' ORDER BY name) FROM f WHERE f.module = o.module AND k <= 50) AS names FROM o GROUP BY o.module""")
def _(s, d):
    return V.module_tree(frame(s, d, "nodes")).withColumn("names", F.array_join("names", ","))


@q("x11_call_diagram", cte("calls", "nodes") + """, b AS (SELECT x.id, name FROM (SELECT id, count(*) AS n FROM (SELECT src AS id FROM calls UNION ALL SELECT dst FROM calls) y GROUP BY id ORDER BY n DESC, id LIMIT 12) x JOIN nodes ON nodes.id = x.id),
r AS (SELECT 0 AS o, id AS a, id AS b, '  n' || id || '["' || name || '"]' AS t FROM b UNION ALL SELECT DISTINCT 1, src, dst, '  n' || src || ' --> n' || dst FROM calls WHERE src IN (SELECT id FROM b) AND dst IN (SELECT id FROM b))
SELECT 'graph TD' || chr(10) || string_agg(t, chr(10) ORDER BY o, a, b) AS diagram FROM r""")
def _(s, d):
    return V.call_diagram(frame(s, d, "calls"), frame(s, d, "nodes"))


@q("p8_p9_read_only_sql", "SELECT n_name, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def _(s, d):
    sql = "SELECT n_name, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name"
    return V.read_only_sql(s, sql, nation=table(s, d, "nation"), customer=table(s, d, "customer"))


def _sources(s, d):
    """A source file for each part, in one of three languages, that calls what the part calls; strings and comments hold calls too."""
    n = frame(s, d, "nodes").select("id")
    c = frame(s, d, "calls").groupBy(F.col("src").alias("id")).agg(F.transform(F.sort_array(F.collect_list("dst")), lambda x: x.cast("string")).alias("to"))
    f = n.join(c, "id", "left").withColumn("to", F.coalesce("to", F.array().cast("array<string>")))
    lines = lambda head, tail: F.concat(F.lit(""), F.array_join(F.transform("to", lambda x: F.concat(F.lit(head), x, F.lit(tail))), ""))
    java = F.concat(F.format_string("class P%d extends Q {\n  int m%d(int a) {\n", "id", "id"), lines("    x.m", "(a, \"m0(1)\"); // m0()\n"), F.lit("  }\n}\n"))
    go = F.concat(F.format_string("package p\nfunc m%d(a int) {\n", "id"), lines("\tx.m", "(a, `m0(1)`) // m0()\n"), F.lit("}\n"))
    script = F.concat(F.format_string("import { q } from './q';\nexport const m%d = (a: number) => {\n", "id"), lines("  x.m", "(a, 'm0(1)'); /* m0() */\n"), F.lit("};\n"))
    k = F.col("id") % 3
    return f.select(F.col("id").cast("string").alias("path"), F.when(k == 0, "java").when(k == 1, "go").otherwise("typescript").alias("language"), F.when(k == 0, java).when(k == 1, go).otherwise(script).alias("content"))


@q("s23_scan_sources", cte("calls", "nodes") + """, c AS (SELECT src AS id, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM calls), f AS (SELECT nodes.id, count(dst) AS n FROM nodes LEFT JOIN c ON c.id = nodes.id GROUP BY nodes.id),
r AS (SELECT id, 'CALL' AS kind, 'm' || dst AS name, 'm' || id AS parent, 2 + k AS start_line, 2 + k AS end_line, 'x' AS receiver, 2 AS arguments, 'member' AS form FROM c
  UNION ALL SELECT id, CASE WHEN id % 3 = 0 THEN 'Method' ELSE 'Function' END, 'm' || id, CASE WHEN id % 3 = 0 THEN 'P' || id ELSE '' END, 2, 3 + n, '', NULL, NULL FROM f
  UNION ALL SELECT id, 'Class', 'P' || id, '', 1, 4 + n, '', NULL, NULL FROM f WHERE id % 3 = 0
  UNION ALL SELECT id, 'EXTENDS', 'P' || id, '', 1, 1, 'Q', NULL, NULL FROM f WHERE id % 3 = 0
  UNION ALL SELECT id, 'IMPORT', './q', '', 1, 1, '', NULL, NULL FROM f WHERE id % 3 = 2)
SELECT CAST(id AS VARCHAR) AS path, kind, name, parent, start_line, end_line, receiver, arguments, form FROM r""")
def _(s, d):
    return scan(_sources(s, d)).select("path", "kind", "name", "parent", "start_line", "end_line", "receiver", "arguments", "form")


@q("s19_incremental_graph", cte("calls", "nodes") + """, e AS (SELECT src, dst FROM calls JOIN nodes a ON a.id = src WHERE a.file_path LIKE 'src/core/%' OR edge_seq % 2 = 0),
n AS (SELECT id, community FROM nodes WHERE file_path LIKE 'src/core/%' OR label <> 'File'),
r AS (SELECT 'degree' AS part, CAST(id AS VARCHAR) AS a, '' AS b, sum(i) AS n, sum(o) AS m FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) x GROUP BY id
  UNION ALL SELECT 'module', x.community, y.community, count(*), 0 FROM e JOIN n x ON x.id = src JOIN n y ON y.id = dst WHERE x.community <> y.community GROUP BY 2, 3)
SELECT part, a, b, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m FROM r""")
def _(s, d):
    n = cut(frame(s, d, "nodes").select(F.col("id").cast("string").alias("id"), "file_path", "label", "name", F.col("community").alias("module")))
    e = cut(frame(s, d, "calls").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "type", "edge_seq").join(n.select(F.col("id").alias("src"), "file_path"), "src"))  # read many times
    store = Versions(s, new_path(s), 16)
    build(store, n, e.select("src", "dst", "type", "file_path"))
    changed = n.where("file_path NOT LIKE 'src/core/%'").select("file_path")
    now = reindex(store, changed, n.where("label <> 'File'"), e.where("edge_seq % 2 = 0").select("src", "dst", "type", "file_path"))
    degrees = store.read("degrees", now).select(F.lit("degree").alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.col("callers").alias("n"), F.col("callees").alias("m"))
    return degrees.unionAll(store.read("modules", now).select(F.lit("module"), "from", "to", "n", F.lit(0).cast("long")))
