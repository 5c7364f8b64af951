import random

import pytest

from graphloom.sources import versions as V


def content(rnd, n=12):
    """path -> (nodes, edges) of random files; ids belong to their files, edges may lead anywhere, also to nothing."""
    out = {}
    for f in range(n):
        path = f"m{f % 3}/f{f}.py"
        out[path] = give(rnd, path, n)
    return out


def give(rnd, path, n=12):
    names = rnd.sample("abcd", rnd.randrange(1, 4))
    nodes = [(f"{path}:{x}", path, "Function", x, path.split("/")[0] if rnd.random() < 0.8 else "moved") for x in names]
    edges = [(f"{path}:{rnd.choice(names)}", f"m{t % 3}/f{t}.py:{rnd.choice('abcd')}", "CALLS", path) for t in [rnd.randrange(n + 2) for _ in range(rnd.randrange(6))]]
    return nodes, edges


def frames(spark, files):
    return spark.createDataFrame([x for n, _ in files.values() for x in n], V.NODES), spark.createDataFrame([x for _, e in files.values() for x in e], V.EDGES)


def state(store, version=None):
    return {t: sorted(map(tuple, store.read(t, version).collect())) for t in V.TABLES}


def test_differences_equal_a_rebuild(spark, tmp_path):
    rnd = random.Random(4)
    files = content(rnd)
    store = V.Versions(spark, str(tmp_path / "s"), buckets=4)
    assert store.current() == 0 and state(store) == {t: [] for t in V.TABLES}
    V.build(store, *frames(spark, files))
    first = state(store, 1)
    for turn in range(2):
        paths = rnd.sample(sorted(files), 3) + [f"m1/new{turn}.py"]
        for p in paths[1:]:
            files[p] = give(rnd, p)
        files.pop(paths[0])
        changed = spark.createDataFrame([(p,) for p in paths], "file_path string")
        assert V.reindex(store, changed, *frames(spark, files)) == turn + 2
        whole = V.Versions(spark, str(tmp_path / f"w{turn}"), buckets=4)
        V.build(whole, *frames(spark, files))
        assert state(store) == state(whole), turn
    assert state(store, 1) == first  # earlier versions stay as they were


def test_only_touched_buckets_are_written_and_a_lost_race_fails(spark, tmp_path):
    rnd = random.Random(7)
    files = content(rnd)
    store = V.Versions(spark, str(tmp_path / "s"), buckets=16)
    V.build(store, *frames(spark, files))
    path = sorted(files)[0]
    V.reindex(store, spark.createDataFrame([(path,)], "file_path string"), *frames(spark, files))  # the same again
    rows = store.lists().where("version = 2").collect()
    assert sum(r["written"].startswith("2-") for r in rows if r["table"] == "nodes") == 1 and all(r["written"].startswith("1-") for r in rows if r["table"] in ("degrees", "modules"))
    before = state(store)
    with pytest.raises(Exception, match="(?i)already exists"):
        store.commit(1, {"nodes": (store.read("nodes", 1).where("false"), None)})
    assert store.current() == 2 and state(store) == before


def test_a_bucket_of_many_rows_is_written_by_many_tasks(spark, tmp_path):
    store = V.Versions(spark, str(tmp_path / "store"), 1)
    edges = spark.range(2000).selectExpr("cast(id as string) AS src", "cast(id + 1 as string) AS dst", "'CALLS' AS type", "'one.py' AS file_path")
    nodes = spark.range(2001).selectExpr("cast(id as string) AS id", "'one.py' AS file_path", "'Function' AS label", "'f' AS name", "cast(id % 2 as string) AS module")
    V.build(store, nodes, edges)
    assert len(list((tmp_path / "store" / "edges").glob("*/bucket=0/*.parquet"))) > 1
    assert store.read("edges").count() == 2000 and {tuple(r) for r in store.read("modules").collect()} == {("0", "1", 1000), ("1", "0", 1000)}
