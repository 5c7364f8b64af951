from graphloom.operators import rules as R
from graphloom.plans import catalog


def test_counts_beside_each_other_are_the_summary_of_all_rows(spark):
    a = spark.createDataFrame([(1, "API Key", "t"), (2, None, None), (3, "the API has JWT, TODO", ""), (4, "AC-001 AC-003", "x")], "doc_id long, content string, title string")
    key = lambda r: r["rule_id"]
    assert sorted(R.rule_counts(a, "doc_id").collect(), key=key) == sorted(R.rule_summary(R.run_rules(a, "doc_id")).select("rule_id", "rule_name", "category", "failed", "checked").collect(), key=key)
    assert R.rule_counts(a.where("false"), "doc_id").collect() == []


def test_the_summary_multiplies_no_rows_and_lowers_a_text_once(spark, tmp_path):
    spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = catalog.QUERIES["g39_rule_summary"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and plan.count("lower(") == 1
