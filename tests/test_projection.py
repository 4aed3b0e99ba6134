"""Neighbour graphs and layouts against all distances in numpy."""

import numpy as np
import pytest

from tessera.operators import projection, similarity
from tessera.plans import all_queries


def distances(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))


def trustworthiness(high, low, k=10):
    """Of the k nearest in `low`, how far down they are in `high`."""
    n = len(high)
    order = np.argsort(distances(high) + np.diag([-1.0] * n), axis=1)
    rank = np.empty((n, n), int)
    rank[np.arange(n)[:, None], order] = np.arange(n)
    near = np.argsort(distances(low) + np.diag([-1.0] * n), axis=1)[:, 1 : k + 1]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(rank[np.arange(n)[:, None], near] - k, 0).sum()


@pytest.fixture(scope="module")
def clusters(spark):
    """1200 rows about 24 centres on a bent surface in 16 dimensions, more than a leaf holds; some rows are equal."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(24, 16)) * 3
    x = centres[np.arange(1200) % 24] + rng.normal(size=(1200, 16)) * 0.7
    x[::100] = x[0]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "extra") for i, v in enumerate(x)] + [(None, x[0].tolist(), ""), (5000, None, "")], "id long, vector array<float>, d string")
    return x, df


def test_graph_finds_the_nearest(clusters):
    x, df = clusters
    graph = projection.neighbour_graph(df, "id", "vector", k=10).collect()
    d = distances(x.astype(np.float64)) + np.diag([np.inf] * len(x))
    found = {}
    for r in graph:
        assert r["u"] != r["v"] and abs(r["distance"] - d[r["u"], r["v"]]) < 1e-3
        found.setdefault(r["u"], set()).add(r["v"])
    assert set(found) == set(range(len(x))) and all(len(f) == 10 for f in found.values())
    tenth = np.sort(d, axis=1)[:, 9]
    hits = sum(sum(d[u, v] <= tenth[u] + 1e-6 for v in f) for u, f in found.items())
    assert hits / (10 * len(x)) >= 0.95


def test_projections_keep_neighbours_better_than_pca(clusters):
    x, df = clusters
    pca = {r[0]: list(r[1]) for r in similarity.pca(df.where("id is not null and vector is not null"), "id", "vector").collect()}
    plain = trustworthiness(x.astype(np.float64), np.array([pca[i] for i in range(len(x))]))
    for f, prefix in ((projection.umap, "umap"), (projection.tsne, "tsne")):
        out = f(df, "id", "vector")
        assert out.columns == ["id", f"{prefix}_1", f"{prefix}_2"]
        places = {r[0]: list(r)[1:] for r in out.collect()}
        assert set(places) == set(range(len(x)))
        assert trustworthiness(x.astype(np.float64), np.array([places[i] for i in range(len(x))])) > max(plain, 0.9)


def test_blocks_agree_with_one_block(clusters, monkeypatch):
    x, df = clusters
    monkeypatch.setattr(projection, "BLOCK", 300)
    places = {r[0]: list(r)[1:] for r in projection.umap(df, "id", "vector").collect()}
    assert trustworthiness(x.astype(np.float64), np.array([places[i] for i in range(len(x))])) > 0.9


def test_clamps(spark):
    assert [projection.clamped_neighbours(n) for n in (2, 3, 10, 16, 100)] == [2, 2, 9, 15, 15]
    assert [projection.clamped_perplexity(n) for n in (3, 10, 31, 100)] == [2.0, 9.0, 30.0, 30.0]
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<float>")
    with pytest.raises(ValueError):
        projection.umap(one, "id", "vector")
    with pytest.raises(ValueError):
        projection.tsne(one, "id", "vector")
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "id long, vector array<float>")
    assert projection.umap(few, "id", "vector").count() == projection.tsne(few, "id", "vector").count() == 3


def test_weights():
    d = np.array([[0.5, 1.0, 2.0, 4.0], [0.1, 0.1, 0.1, np.inf]])
    w = projection.fuzzy(d)
    assert w[0, 0] == 1 and abs(w[0].sum() - 2) < 1e-6 and w[1, 3] == 0
    p = projection.by_perplexity(d[:1], 2.5)
    assert abs(p.sum() - 1) < 1e-9 and abs(np.exp(-(p * np.log(p)).sum()) - 2.5) < 1e-6
    a, b = projection.curve(1.0, 0.1)
    assert abs(a - 1.58) < 0.05 and abs(b - 0.895) < 0.02  # as published for these settings


def test_queries_recall(spark, sf_dir):
    x = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()}
    ids = sorted(x)
    d = distances(np.array([x[i] for i in ids], dtype=np.float64)) + np.diag([np.inf] * len(ids))
    true = {ids[i]: {ids[j] for j in np.argsort(d[i])[:15]} for i in range(len(ids))}
    graph = all_queries()["neighbour_graph"](spark, sf_dir).collect()
    assert sum(r["v"] in true[r["u"]] for r in graph) / (15 * len(ids)) >= 0.9


@pytest.mark.parametrize("search", [16384, 300])
def test_exact_graph_in_blocks(spark, clusters, monkeypatch, search):
    """Every edge is one of the true k nearest, ties by number, also over several blocks and tiles; a descent misses some."""
    x, df = clusters
    monkeypatch.setattr(projection, "SEARCH", search)
    monkeypatch.setattr(projection, "TILE", 128)
    got = {}
    for r in projection.neighbour_graph(df, "id", "vector", k=40).collect():
        got.setdefault(r["u"], set()).add(r["v"])
    d = distances(x.astype(np.float64)) + np.diag([np.inf] * len(x))
    near = np.sort(d, axis=1)[:, 39]
    assert set(got) == set(range(len(x)))
    assert all(len(v) == 40 and all(d[u, w] <= near[u] + 1e-6 for w in v) for u, v in got.items())


def test_descent_beyond_the_exact_search(clusters, monkeypatch):
    x, df = clusters
    monkeypatch.setattr(projection, "EXACT", 0)
    graph = projection.neighbour_graph(df, "id", "vector", k=10)
    d = distances(x.astype(np.float64)) + np.diag([np.inf] * len(x))
    tenth = np.sort(d, axis=1)[:, 9]
    assert sum(d[r["u"], r["v"]] <= tenth[r["u"]] + 1e-6 for r in graph.collect()) / (10 * len(x)) >= 0.95
