import random

from graphloom.operators import resolve as R


def test_narrowest_range_as_by_brute_force_and_without_pairs(spark):
    rng = random.Random(3)
    scopes = [(rng.choice("ab"), i, a, a + rng.choice([-1, 0, 3, 10, 70, 500])) for i in range(300) for a in [rng.randrange(-200, 400)]]
    scopes += [("a", 900, 0, 10**12), ("c", 901, None, 5)]  # one block of lines after another, this range had 1.6e10 of them
    points = [(i, rng.choice("abc"), rng.randrange(-250, 1200)) for i in range(400)] + [(1000, "a", 10**12), (1001, "a", None)]
    want = {}
    for p, file, line in points:
        near = [(e - s, i) for f, i, s, e in scopes if f == file and None not in (s, line) and s <= line <= e]
        if near:
            want[p] = min(near)[1]
    out = R.innermost_scope(spark.createDataFrame(points, "point_id long, file string, line long"), spark.createDataFrame(scopes, "file string, scope_id long, start_line long, end_line long"))
    got = [tuple(r) for r in out.collect()]
    assert dict(got) == want and len(got) == len(want) and want[1000] == 900


def test_points_and_ranges_of_one_file_are_not_paired(spark):
    n = 200_000  # 4e10 pairs
    points = spark.range(n).selectExpr("id AS point_id", "'f' AS file", "id % 50 AS line")
    scopes = spark.range(n).selectExpr("'f' AS file", "id AS scope_id", "id % 50 AS start_line", "id % 50 + 10 AS end_line")
    out = R.innermost_scope(points, scopes)
    assert out.count() == n and out.where("scope_id <> greatest(point_id % 50 - 10, 0)").count() == 0
