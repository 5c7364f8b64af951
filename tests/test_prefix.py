import collections
import itertools

from pyspark.sql import functions as F

from graphloom.operators.prefix import prefix_sums


def test_sums_inside_groups_and_over_all(spark):
    rows = [(i, None if i % 5 == 0 else "hot" if i % 3 else f"g{i % 4}", (i * 7919) % 101, i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, o int, v long").repartition(6)
    got = prefix_sums(df, {"s": "v", "n": "1L"}, ["o", "id"], by=["g"]).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    want = {}
    for some in groups.values():
        some.sort(key=lambda r: (r[2], r[0]))
        for n, (r, s) in enumerate(zip(some, itertools.accumulate(r[3] for r in some)), 1):
            want[r[0]] = (s, n)
    assert {r["id"]: (r["s"], r["n"]) for r in got} == want and len(got) == 400
    over = prefix_sums(df, {"s": "v"}, [F.desc("o"), "id"]).collect()
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert {r["id"]: r["s"] for r in over} == dict(zip((r[0] for r in order), itertools.accumulate(r[3] for r in order)))


def test_no_rows_and_rows_alike(spark):
    df = spark.createDataFrame([(1, 2)] * 9, "o int, v long")
    assert sorted(r["s"] for r in prefix_sums(df, {"s": "v"}, ["o"]).collect()) == list(range(2, 20, 2))
    assert prefix_sums(df.where("false"), {"s": "v"}, ["o"], by=["v"]).collect() == []
