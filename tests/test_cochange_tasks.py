from itertools import combinations

from graphloom.operators import history as H


def test_tasks_go_by_the_number_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(H, "PAIRS", 100)
    commits = {c: [(c * 7 + i) % 50 for i in range(c % 23)] for c in range(60)}
    rows = [(c, f) for c, files in commits.items() for f in set(files)]
    out = H.cochange_support(spark.createDataFrame(rows, "commit_id long, file long"), block=8)
    want = {}
    for files in commits.values():
        for p in combinations(sorted(set(files)), 2):
            want[p] = want.get(p, 0) + 1
    assert {(r["file_a"], r["file_b"]): r["support"] for r in out.collect()} == want
    assert out.rdd.getNumPartitions() >= sum(want.values()) // 100 > 4
    assert H.cochange_support(spark.createDataFrame([], "commit_id long, file long")).count() == 0
