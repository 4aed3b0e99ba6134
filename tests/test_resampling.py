import inspect
import time

import numpy as np
import pytest

from tessera.operators import stats
from tessera.plans import statistics


def test_queries_draw_as_often_as_the_reference(spark, monkeypatch):
    real, calls = stats.compare_groups, []

    def seen(*args, **options):
        bound = inspect.signature(real).bind(*args, **options)
        bound.apply_defaults()
        calls.append((bound.arguments["n_perm"], bound.arguments["n_boot"]))
        return spark.createDataFrame([], "descriptor string, cliffs_delta double, ci_low double, ci_high double")

    monkeypatch.setattr(stats, "compare_groups", seen)
    monkeypatch.setattr(statistics, "group_values", lambda spark, d: None)
    statistics.permutation_test(spark, "")
    statistics.bootstrap_ci(spark, "")
    assert calls == [(20000, 5000), (0, 5000)]


def test_draws_from_counts_are_those_from_rows():
    """Each counted statistic equals that of the rows, and counted draws have the spread of drawn rows."""
    rng = np.random.default_rng(5)
    v = np.array([0.5, 1.0, 2.0, 4.0, 7.5])
    a, b = rng.integers(0, 9, (40, 5)) + np.eye(5, dtype=int)[2], rng.integers(0, 9, (40, 5)) + np.eye(5, dtype=int)[3]
    for stat in (stats.median_difference, stats.mean_difference, stats.delta, lambda x, y: x.max() - y.min()):
        rows = [stat(np.repeat(v, x), np.repeat(v, y)) for x, y in zip(a, b, strict=True)]
        assert stats.of_counts(stat, v, a, b) == pytest.approx(rows)
    x, y = np.repeat(v, a[0]), np.repeat(v, b[0])
    drawn = np.concatenate([stats.of_counts(stats.delta, v, *xy) for xy in stats.subsampled_counts(a[0], b[0], 4000, rng, cells=1000)])
    rows = stats.resampled(x, y, stats.delta, 4000, rng)
    assert len(drawn) == 4000 and drawn.mean() == pytest.approx(np.mean(rows), abs=0.02) and drawn.std() == pytest.approx(np.std(rows), abs=0.02)
    far = np.concatenate([stats.of_counts(stats.mean_difference, v, *xy) for xy in stats.permuted_counts(a[0], b[0], 4000, rng)])
    observed, p = stats.permutation_p(x, y, stats.mean_difference, 4000, rng)
    assert (np.abs(far) >= abs(observed) - 1e-12).mean() == pytest.approx(p, abs=0.04)


def test_draws_cost_the_different_values_and_not_the_rows(spark):
    """Ten million rows of six values, by their counts."""
    start = time.time()
    a, b = np.full(6, 900_000), np.full(6, 800_000)
    assert sum(len(x) for x, _ in stats.permuted_counts(a, b, 20000, np.random.default_rng(1))) == 20000
    assert time.time() - start < 5
