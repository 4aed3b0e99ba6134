"""Statistics of all pairs against numpy, over blocks and tiles smaller than the table."""

import numpy as np
import pytest

from tessera.operators import similarity


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist(), int(rng.integers(0, 3))) for i in range(90)] + [(90 + i, [1.0, 2.0, 0.0, 0.0, 1.0], 1) for i in range(30)]
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    i, j = np.triu_indices(len(rows), 1)
    label = np.array([r[2] for r in rows])
    return spark.createDataFrame(rows, "k long, v array<double>, l int"), (m @ m.T)[i, j], label[i] == label[j]


@pytest.mark.parametrize("bins", [2, 64, 1 << 16])
def test_pair_quantiles(vectors, bins):
    df, cosines, same = vectors
    for r in similarity.pair_quantiles(df, "k", "v", "l", block=50, bins=bins).collect():
        x = cosines[same == r.same_label]
        assert r.n == len(x) and [r.mean, r.std, r.min, r.max] == pytest.approx([x.mean(), x.std(ddof=1), x.min(), x.max()])
        assert [r.q25, r.q50, r.q75] == pytest.approx(np.percentile(x, [25, 50, 75]).tolist())


def test_blocks_give_every_pair_once(vectors, monkeypatch):
    df, cosines, same = vectors
    monkeypatch.setattr(similarity, "TILE", 7)
    got = similarity.cosine_pairs(df, "k", "v", "l", block=50).collect()
    assert len({(r.a, r.b) for r in got}) == len(got) == len(cosines) and all(r.a < r.b for r in got)
    assert sorted(r.cosine for r in got) == pytest.approx(sorted(cosines.tolist())) and sum(r.same_label for r in got) == same.sum()


def test_copies_of_a_row_follow_the_large_block(spark):
    """20,000 rows are two blocks of 16,384 or as many as the cores need, not twenty of 1,024."""
    df = spark.range(20000).selectExpr("id AS k", "array(1.0D) AS v", "1 AS l")
    assert similarity._blocks(df, "k", "v", "l", similarity.BLOCK).agg({"k": "count"}).agg({"lo": "max"}).first()[0] < 8


def test_wide_vectors_make_small_blocks(spark):
    """A task's memory follows the numbers in its two blocks: 20,000 vectors of 8,192 numbers are 40 blocks and not a few."""
    df = spark.range(20000).selectExpr("id AS k", "array_repeat(1.0D, 8192) AS v", "1 AS l")
    assert similarity._blocks(df, "k", "v", "l", similarity.BLOCK).agg({"k": "count"}).agg({"lo": "max"}).first()[0] >= 38


def test_rounded_in_the_tiles(vectors):
    df, cosines, _ = vectors
    got = [r.cosine for r in similarity.cosine_pairs(df, "k", "v", "l", block=50, digits=3).collect()]
    assert sorted(got) == pytest.approx(sorted(round(float(x), 3) for x in cosines), abs=1e-12) and all(x == round(x, 3) for x in got)


def test_quantiles_leave_no_pairs_to_later_steps(vectors):
    """What is returned has the rows told; collecting it multiplies no block again."""
    df, _, _ = vectors
    out = similarity.pair_quantiles(df, "k", "v", "l", block=50)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString() and out.count() == 2


@pytest.mark.parametrize("low, width", [(0.9, 0.01), (-0.99, 0.01), (0.0, 1e-9)])
def test_quantiles_outside_the_likely_range(vectors, monkeypatch, low, width):
    df, cosines, same = vectors
    monkeypatch.setattr(similarity, "_likely", lambda *of: {(k, q): (low, width) for k in (False, True) for q in of[-1]})
    for r in similarity.pair_quantiles(df, "k", "v", "l", at=(0.5,), block=50, bins=64).collect():
        assert r.q50 == pytest.approx(np.median(cosines[same == r.same_label]))


@pytest.mark.parametrize("whole", [False, True])
def test_bins_are_divided_while_they_hold_much(vectors, monkeypatch, whole):
    df, cosines, same = vectors
    if whole:
        monkeypatch.setattr(similarity, "_likely", lambda *of: {(k, q): (-1.0, 2.0) for k in (False, True) for q in of[-1]})
    for r in similarity.pair_quantiles(df, "k", "v", "l", block=50, bins=8, most=10).collect():
        x = cosines[same == r.same_label]
        assert [r.n, r.q25, r.q50, r.q75] == pytest.approx([len(x), *np.percentile(x, [25, 50, 75])])


def test_quantiles_of_few_pairs(spark):
    """One pair has no deviation; pairs of equal rows are one value; no pair gives no row."""
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 1.0], 1), (3, [1.0, 1.0], 2)], "k long, v array<double>, l int")
    got = {r.same_label: r for r in similarity.pair_quantiles(df, "k", "v", "l").collect()}
    assert (got[True].n, got[True].std) == (1, None) and got[True].q50 == pytest.approx(0.5**0.5)
    assert got[False].n == 2 and got[False].q50 == pytest.approx((1 + 0.5**0.5) / 2) and got[False].max == pytest.approx(1)
    assert similarity.pair_quantiles(df.where("k = 1"), "k", "v", "l").count() == 0
    copies = spark.range(700).selectExpr("id AS k", "array(1.0D, 2.0D, 2.0D) AS v", "CAST(id % 2 AS INT) AS l")
    for r in similarity.pair_quantiles(copies, "k", "v", "l", block=200, most=5).collect():
        assert r.n == (350 * 350 if not r.same_label else 350 * 349) and [r.q25, r.q50, r.q75] == pytest.approx([1.0] * 3)
