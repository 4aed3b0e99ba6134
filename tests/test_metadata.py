"""Metadata documents and reference models."""

import numpy as np
import pytest

from tessera.operators import metadata, models, pivots
from tessera.plans import evidence as plans


def test_document(spark, sf_dir):
    pivot, states = plans.pivot(spark, sf_dir), plans.states(spark, sf_dir)
    doc = metadata.document(pivot, states, pivots.ambiguous_support(states, plans.direct(spark, sf_dir)), stamp=False)
    n = pivot.count()
    assert doc["sequences"]["n_unique"] == n and all(sum(v.values()) == n for v in doc["endpoints"].values())
    assert doc["hierarchy"]["ALL"]["n_rows"] == sum(v["n_rows"] for k, v in doc["hierarchy"].items() if k != "ALL")
    assert [r["target"] for r in doc["rules"]] == ["cytotoxic", "toxic"]
    with pytest.raises(ValueError):
        metadata.long_annotation_summary(pivot)


def test_reduction_log():
    first = metadata.reduction_record([], "homology", 10, 7, threshold=0.7)
    assert first == [{"name": "homology", "n_before": 10, "n_after": 7, "n_removed": 3, "parameters": {"threshold": 0.7}}] and len(metadata.reduction_record(first, "x", 7, 7)) == 2


@pytest.mark.parametrize("model", sorted(models.CLASSIFIERS))
def test_models(spark, model):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = (x @ [2, -1, 0.5, 0] > 0).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(t), float(v @ [1, 2, 0, 0])) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, v array<double>, t int, y double")
    train, test = models.holdout(df, "id")
    assert train.count() + test.count() == 300 and 30 < test.count() < 90
    out = models.classify(train, test, "v", "t", model).collect()
    assert sum(r.guess == r.t for r in out) >= 0.85 * len(out)
    fit = models.regress(train, test, "v", "y", ridge=0.01).collect()
    assert sum((r.guess - r.y) ** 2 for r in fit) < 0.1 * sum((r.baseline - r.y) ** 2 for r in fit)
