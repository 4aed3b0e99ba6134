"""Groups under a distance, their components and folds against brute force."""

import random

import numpy as np
import pytest

from tessera.operators import groups, splits


def union(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(60, 6)) * 3, rng.normal(size=(1, 6)) + rng.normal(size=(120, 6)) * 0.05])
    x = np.concatenate([x, x[:30] + rng.normal(size=(30, 6)) * 0.2, np.repeat(x[:1], 20, 0)])
    rows = [(i, v.tolist(), int(i % 3 == 0)) for i, v in enumerate(x)]
    return x, spark.createDataFrame([*rows, (500, None, 1), (501, [0.0] * 6, 0), (None, [1.0] * 6, 1)], "id long, vector array<double>, label int")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("side", [1024, 16])
def test_groups(vectors, metric, side, monkeypatch):
    monkeypatch.setattr(groups, "SIDE", side)
    x, df = vectors
    most = 0.01 if metric == "cosine" else 0.6
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - unit @ unit.T if metric == "cosine" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = union(len(x), zip(*np.nonzero(d <= most), strict=True))
    assert 30 < len(set(want)) < len(x) - 50
    got = {r["id"]: r["group"] for r in groups.near_groups(df, "id", "vector", most, metric).collect()}
    if metric == "euclidean":  # there the row of zeros can have neighbours
        got.pop(501)
    assert got == dict(enumerate(want)) | {500: 500, None: None} | ({501: 501} if metric == "cosine" else {})


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(300 + i, 301 + i) for i in range(99)]
    rnd.shuffle(pairs)
    want = union(400, pairs)
    got = {r["u"]: r["root"] for r in groups.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()}
    assert got == {u: want[u] for p in pairs if p[0] != p[1] for u in p}
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert groups.near_links(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 0.1).count() == 0


def test_packing():
    rnd = random.Random(2)
    for _ in range(200):
        k = rnd.randrange(2, 7)
        kinds = [(rnd.randrange(1, 40), rnd.choice("ab"), rnd.choice([1, 1, 2, 7, 500])) for _ in range(rnd.randrange(1, 30))]
        out = splits.packed(kinds, k)
        assert [sum(o) for o in out] == [n for _, _, n in kinds] and min(min(o) for o in out) >= 0
        full = [sum(o[f] * size for o, (size, _, _) in zip(out, kinds, strict=True)) for f in range(k)]
        assert max(full) - min(full) <= max(size for size, _, _ in kinds)
    assert splits.packed([], 3) == []


def test_folds_keep_near_rows_together(vectors):
    x, df = vectors
    got = splits.distance_folds(df, "vector", 0.01, seed=3)
    rows = got.collect()
    assert got.columns == ["id", "label", "group", "fold", "in_val"] and len(rows) == len(x) + 3
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = {r["id"]: (r["fold"], r["in_val"]) for r in rows}
    assert all(at[i] == at[j] for i, j in zip(*np.nonzero(1 - unit @ unit.T <= 0.01), strict=True))
    sizes = [sum(r["fold"] == f for r in rows) for f in range(5)]
    largest = max(sum(r["group"] == g for r in rows) for g in {r["group"] for r in rows})
    assert max(sizes) - min(sizes) <= largest and sum(sizes) == len(rows)
    assert {r["id"]: r["fold"] for r in splits.distance_folds(df, "vector", 0.01, seed=3).collect()} == {r["id"]: r["fold"] for r in rows}
    assert {r["id"]: r["fold"] for r in splits.distance_folds(df, "vector", 0.01, seed=4).collect()} != {r["id"]: r["fold"] for r in rows}
    classes = [[sum(r["fold"] == f and r["label"] == c and r["group"] == r["id"] for r in rows) for f in range(5)] for c in (0, 1)]
    assert sum(map(sum, classes)) > 0


def test_rows_are_not_copied_for_each_block(spark, monkeypatch):
    """Vectors that no grid parts: blocks are read from their table, and chains over many blocks still join."""
    monkeypatch.setattr(groups, "SIDE", 16)
    x = np.random.default_rng(3).normal(size=(300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    links = groups.near_links(df, "id", "vector", 0.6)
    assert "Generate" not in links._jdf.queryExecution().executedPlan().toString()
    want = union(len(x), zip(*np.nonzero(1 - x @ x.T <= 0.6), strict=True))
    got = {r["id"]: r["group"] for r in groups.near_groups(df, "id", "vector", 0.6).collect()}
    assert got == dict(enumerate(want)) and 1 < len(set(want)) < 250
