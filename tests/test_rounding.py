from graphloom.operators import consensus as C


def test_scores_are_rounded_as_in_sql(spark):
    e = spark.createDataFrame([(1, 1, 0.5203125, 1.0), (2, 1, 0.5046875, 1.0), (3, 1, 0.8078125, 1.0)], "claim_id long, evaluator_id long, score double, confidence double")
    import duckdb

    want = dict(duckdb.connect().execute("SELECT k, round(x, 6) FROM (VALUES (1, 0.5203125::DOUBLE), (2, 0.5046875), (3, 0.8078125)) t(k, x)").fetchall())
    assert {r["claim_id"]: r["consensus_score"] for r in C.weighted_average(e).collect()} == want
    assert want[1] == 0.520312
