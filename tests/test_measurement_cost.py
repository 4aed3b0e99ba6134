"""Costly expressions of measurement queries are worked out once a row, or once a text."""

from tessera.operators import measurements
from tessera.plans import texts


def test_filters_do_not_repeat_the_sequence(spark, sf_dir):
    rows = measurements.valid_split(texts.parsed(spark, sf_dir).where("sequence is not null"))[0]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "sha2(" in line for line in plan.splitlines())


def test_each_text_is_parsed_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(measurements, "materialize", lambda df, name: seen.append(df.count()) or df)
    rows = [(i, t) for i, t in enumerate(["HC50 5 uM", "HC50 5 uM", None, "unknown", "HC50 5 uM"])]
    got = measurements.parse(spark.createDataFrame(rows, "i int, text string")).orderBy("i").collect()
    assert seen == [2]
    assert [(r.type, r.value, r.unit, r.label) for r in got] == [("HC50", 5.0, "µM", "5")] * 2 + [(None,) * 4, (None,) * 4, ("HC50", 5.0, "µM", "5")]
