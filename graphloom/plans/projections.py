"""How the star-schema tables are read as a code graph, a history and a stream of evaluations.

Each projection is one SQL text that Spark and an ANSI engine both run; ``frame`` gives it as a DataFrame,
``cte`` as the head of an equivalent query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

SQL: dict[str, str] = {
    # the number of a line inside its order, made unique
    "lines": """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_shipdate,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ln
      FROM {lineitem}""",
    "commit_files": "SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file FROM {lineitem}",
    "blame": "SELECT l_partkey AS file, l_suppkey AS author, count(*) AS line_count FROM {lineitem} GROUP BY l_partkey, l_suppkey",
    "numstat": """SELECT l_partkey AS file, CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END AS added,
        CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS deleted FROM {lineitem}""",
    "loc": "SELECT p_partkey AS file, p_size * 20 AS total_loc FROM {part}",
    "nodes": """SELECT p_partkey AS id,
        CASE p_type WHEN 'ECONOMY' THEN 'Function' WHEN 'SMALL' THEN 'Method' WHEN 'LARGE' THEN 'Class' WHEN 'MEDIUM' THEN 'Constructor'
          WHEN 'PROMO' THEN 'Interface' ELSE 'File' END AS label,
        CASE WHEN p_size > 47 THEN '__' || replace(p_name, ' ', '_') || '__' WHEN p_size > 44 THEN replace(p_name, ' ', '') || 'Handler'
          WHEN p_size > 41 THEN 'handle' || upper(substr(p_name, 1, 1)) || substr(replace(p_name, ' ', ''), 2) WHEN p_size > 38 THEN 'get' || upper(p_name)
          ELSE replace(p_name, ' ', '_') END AS name,
        CASE WHEN p_size < 4 THEN 'src/tests/' WHEN p_size < 7 THEN 'src/utils/' WHEN p_size < 10 THEN 'app/api/' ELSE 'src/core/' END
          || lower(replace(p_brand, '#', '')) || CASE WHEN p_size = 12 THEN '_test.py' ELSE '.py' END AS file_path,
        CASE WHEN p_name LIKE 'red%' THEN 'python' WHEN p_name LIKE 'blue%' THEN 'java' ELSE 'go' END AS language,
        p_size > 25 AS is_exported, p_size AS start_line, p_size + 10 AS end_line, p_brand AS community, p_partkey AS def_seq
      FROM {part}""",
    "hops": "SELECT l_orderkey, ln, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY ln) AS dst FROM lines",
    "calls": """SELECT src, dst, 'CALLS' AS type, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY src) AS confidence, edge_seq FROM (
        SELECT src, dst, count(*) AS n, min(l_orderkey * 100 + ln) AS edge_seq FROM hops WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst) x""",
    # all calls, with the confidence of the way that each was resolved
    "tiered_calls": """SELECT src, dst, type, n, CASE WHEN n > 1 THEN 0.9D WHEN edge_seq % 3 = 0 THEN 0.3D WHEN edge_seq % 3 = 1 THEN 0.5D ELSE 0.85D END AS confidence, edge_seq FROM calls""",
    # calls inside a module: sparse, with chains, cycles and nodes that nothing reaches
    "module_calls": """SELECT src, dst, type, n, confidence, edge_seq FROM calls JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.community = b.community""",
    "evaluations": """SELECT l_orderkey AS claim_id, ln AS evaluator_id, round(l_discount * 10, 6) AS score, round(1 - l_tax * 5, 6) AS confidence FROM lines""",
    "steps": """SELECT user_id AS process_id, event_id AS node_id, event_type AS label,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM {events}""",
    "hierarchy": """SELECT r_name || '/' || n_name || '/' || c_name AS path FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "estimates": """SELECT o_orderkey AS group_id, CASE l_returnflag WHEN 'A' THEN 'adaptive_expansion' WHEN 'N' THEN 'collaborative_inference' ELSE 'metacognitive' END AS source,
        round(0.5 + l_discount * 5, 6) AS value, round(l_tax, 6) AS uncertainty FROM lines JOIN {orders} ON l_orderkey = o_orderkey""",
    "signals": """SELECT p_partkey AS id, p_size / 50.0D AS relevance, (p_retailprice - 900) / 2000.0D AS uniqueness, CAST(length(p_name) AS DOUBLE) / 30 AS impact, 0.7D AS confidence FROM {part}""",
}

NEEDS = {name: [x for x in SQL if x != name and re.search(rf"\b(?:FROM|JOIN) {x}\b", text)] for name, text in SQL.items()}


def needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS[n]:
            add(x)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def _body(names: tuple[str, ...], recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({SQL[n]})" for n in needed(names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = f"{_body((name,))} SELECT * FROM {name}"
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def cte(*names: str, recursive: bool = False) -> str:
    """Head of an equivalent query for an engine where the tables are views."""
    return re.sub(r"(\d)D\b", r"\1", re.sub(r"\{(\w+)\}", r"\1", _body(names, recursive)))
