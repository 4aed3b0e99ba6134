from tessera.operators import evidence


def test_reported_support_sorts_no_row_before_the_shuffle(spark):
    """Combining before the shuffle sorted every row there, as its states are texts, and spilled it."""
    rows = [("AAAAA", "toxic", 0.5, None, 1, "b", "positive", "negative"), ("AAAAA", "toxic", 0.25, "c2", 3, "a", "positive", "positive"), ("AAAAA", "toxic", None, "c1", 2, "b", None, "positive"), ("CCCCC", "toxic", None, None, 4, None, None, None)]
    df = spark.createDataFrame(rows, "sequence string, endpoint string, fraction double, category string, pos int, input_file string, row_status string, declared_status string")
    out = evidence.reported_support(df)
    assert sorted(map(tuple, out.collect())) == [("AAAAA", "toxic", 0.5, "c1", "a|b", True), ("CCCCC", "toxic", None, None, "", False)]
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "Aggregate" not in below
