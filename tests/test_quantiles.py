import numpy as np
import pytest

from tessera.operators import similarity, stats


def test_quantiles_are_exact(spark):
    values = np.random.default_rng(2).integers(-40, 40, 301).astype(float).tolist()
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    at = [0.0, 0.01, 0.25, 0.5, 0.975, 1.0]
    assert stats.quantiles(df, "x", at) == pytest.approx(np.quantile(values, at).tolist())
    assert stats.quantiles(df.where("x is null"), "x", [0.5]) == [None]
    assert [r.value for r in similarity.percentiles(df, "x", (5, 50)).collect()] == pytest.approx(np.percentile(values, [5, 50]).tolist())


def test_no_aggregate_holds_a_column(spark):
    df = spark.range(100).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b")
    made = [stats.describe_columns(df, ["a", "b"]), stats.regression_metrics(df, "a", "b"), similarity.percentiles(df, "a")]
    for m in made:
        plan = m._jdf.queryExecution().optimizedPlan().toString()
        assert "median(" not in plan and "percentile(" not in plan
    assert {r.column: r.median for r in made[0].collect()} == {"a": 49.5, "b": 3.0}
