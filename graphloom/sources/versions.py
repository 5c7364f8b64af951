"""A graph store in versions, and re-indexing of changed files by differences.

A table lies in buckets of its key.  A version is a list of (table, bucket, the folder that holds it); a new one writes the buckets that change
and names the others where they are.  Folders are never written twice, and a version counts once its list is committed by one rename, so a
reader always sees a whole version, a writer may read what it replaces, and one that stops half-way leaves nothing that anybody reads.
Two writers of one version: the second fails.

``reindex`` takes back what changed files gave and adds what they give now; degrees and counts of edges between modules are
summed up from these differences alone, and only their buckets are written again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "id string, file_path string, label string, name string, module string"
EDGES = "src string, dst string, type string, file_path string"
#: table -> schema, and the columns that a row's bucket is made from.
TABLES = {
    "nodes": (NODES, ["file_path"]),
    "edges": (EDGES, ["file_path"]),
    "degrees": ("id string, callers long, callees long", ["id"]),
    "modules": ("`from` string, `to` string, n long", ["from", "to"]),
}


LISTED = "version long, table string, bucket int, written string"


class Versions:
    """The store in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(self.buckets)).cast("int")

    def lists(self) -> DataFrame:
        """(version, table, bucket, written: the folder) of all versions."""
        schema = LISTED
        self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{self.path}/lists/none")
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/lists")

    def current(self) -> int:
        """The newest version; 0 before any."""
        return self.lists().agg(F.max("version")).first()[0] or 0

    def read(self, table: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A table as of a version (the newest), or some buckets of it."""
        version = self.current() if version is None else version
        held: dict[str, list[int]] = {}  # at most a row for each bucket
        for r in self.lists().where((F.col("version") == version) & (F.col("table") == table)).collect():
            if only is None or r["bucket"] in only:
                held.setdefault(r["written"], []).append(r["bucket"])
        schema, _ = TABLES[table]
        parts = [self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{table}/{w}").where(F.col("bucket").isin(b)).drop("bucket") for w, b in sorted(held.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, path: str) -> None:
        """Rows in folders of their buckets.  Buckets are few and of any size, so each is dealt to as many tasks as there are for all."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        part = F.pmod(F.xxhash64(*[c for c in df.columns if c != "bucket"]), F.lit(max(1, -(-tasks // self.buckets))))
        df.repartition(tasks, "bucket", part).write.partitionBy("bucket").parquet(path)

    def commit(self, base: int, changes: dict[str, tuple[DataFrame, list[int] | None]]) -> int:
        """A new version after ``base``: for each table the new rows of some buckets (of all with None)."""
        version, rows = base + 1, []
        folder = f"{version}-{uuid.uuid4().hex}"  # no other writer's, whoever wins
        old = self.lists().where(F.col("version") == base).collect()
        for table in TABLES:
            if table in changes:
                df, only = changes[table]
                self._write(df.withColumn("bucket", self.bucket(TABLES[table][1])), f"{self.path}/{table}/{folder}")
                changed = set(range(self.buckets) if only is None else only)
                rows += [(version, table, b, folder) for b in changed]
            else:
                changed = set()
            rows += [(version, table, r["bucket"], r["written"]) for r in old if r["table"] == table and r["bucket"] not in changed]
        listed = self.spark.createDataFrame(rows, LISTED)
        listed.coalesce(1).write.mode("error").parquet(f"{self.path}/lists/{version}")
        return version


def degrees_of(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), "sign").unionByName(edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), "sign"))
    return ends.groupBy("id").agg(F.sum(F.col("i") * F.col("sign")).alias("callers"), F.sum(F.col("o") * F.col("sign")).alias("callees"))


def modules_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes of two modules; ends that aren't nodes count for none."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("module").alias("from")), nodes.select(F.col("id").alias("dst"), F.col("module").alias("to"))
    j = edges.join(a, "src").join(b, "dst").where("`from` <> `to`")
    return j.groupBy("from", "to").agg(F.sum("sign").alias("n"))


def build(store: Versions, nodes: DataFrame, edges: DataFrame) -> int:
    """A version with everything new; of nodes of one id the least row counts."""
    one = nodes.groupBy("id").agg(F.min(F.struct("module")).alias("m")).select("id", "m.module")
    signed = edges.withColumn("sign", F.lit(1).cast("long"))
    tables = {"nodes": nodes, "edges": edges, "degrees": degrees_of(signed), "modules": modules_of(signed, one)}
    return store.commit(store.current(), {k: (v.select(*_names(k)), None) for k, v in tables.items()})


def _names(table: str) -> list[str]:
    return [f"`{part.split()[0].strip('`')}`" for part in TABLES[table][0].split(", ")]


def reindex(store: Versions, changed: DataFrame, nodes: DataFrame, edges: DataFrame) -> int:
    """changed(file_path): files that are new, other than before, or gone; nodes and edges are what those files give now (rows of other files are
    left out).  Ids are assumed to belong to one file.  Gives the new version."""
    base = store.current()
    paths = changed.select("file_path").distinct()
    touched = [r[0] for r in paths.select(store.bucket(["file_path"]).alias("b")).distinct().collect()]  # at most all buckets
    fresh = {"nodes": nodes.join(paths, "file_path", "left_semi"), "edges": edges.join(paths, "file_path", "left_semi")}
    old = {t: store.read(t, base, touched) for t in fresh}
    gone = {t: old[t].join(paths, "file_path", "left_semi") for t in fresh}
    kept = {t: old[t].join(paths, "file_path", "left_anti") for t in fresh}
    changes = {t: (kept[t].unionByName(fresh[t].select(*_names(t))), touched) for t in fresh}

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select("src", "dst", F.lit(sign).cast("long").alias("sign"))

    turned = signed(gone["edges"], -1).unionByName(signed(fresh["edges"], 1))
    turned = turned.groupBy("src", "dst").agg(F.sum("sign").alias("sign")).where("sign <> 0")
    # nodes that come, go or move to another module turn edges of other files too
    module = lambda df, name: df.groupBy("id").agg(F.min("module").alias(name))
    moved = module(gone["nodes"], "was").join(module(fresh["nodes"], "now"), "id", "full").where("NOT was <=> now").select("id")
    everywhere = store.read("edges", base)
    still = everywhere.join(paths, "file_path", "left_anti").select("src", "dst")
    beside = still.join(moved.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(still.join(moved.withColumnRenamed("id", "src"), "src", "left_anti").join(moved.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    all_nodes = store.read("nodes", base)
    before = module(all_nodes, "module")
    after = module(all_nodes.join(paths, "file_path", "left_anti").select("id", "module").unionByName(fresh["nodes"].select("id", "module")), "module")
    less = modules_of(signed(gone["edges"].select("src", "dst").unionByName(beside), -1), before)
    more = modules_of(signed(fresh["edges"].select("src", "dst").unionByName(beside), 1), after)
    differences = {"degrees": degrees_of(turned), "modules": less.unionByName(more)}
    for table, delta in differences.items():
        _, keys = TABLES[table]
        values = [n.strip("`") for n in _names(table) if n.strip("`") not in keys]
        delta = delta.groupBy(*[f"`{k}`" for k in keys]).agg(*[F.sum(v).alias(v) for v in values]).where(" OR ".join(f"{v} <> 0" for v in values))
        buckets = [r[0] for r in delta.select(store.bucket(keys).alias("b")).distinct().collect()]
        if buckets:
            new = store.read(table, base, buckets).unionByName(delta.select(*_names(table))).groupBy(*[f"`{k}`" for k in keys]).agg(*[F.sum(v).alias(v) for v in values])
            changes[table] = (new.where(" OR ".join(f"{v} <> 0" for v in values)).select(*_names(table)), buckets)
    return store.commit(base, changes)
