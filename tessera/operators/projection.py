"""Projections of vectors: a neighbour graph by exact search in blocks or by neighbour descent, edge weights, and a layout by negative sampling.

Rows are (u, vector). Every step works on bounded groups in numpy: a block of rows against tiles of all, leaves of random planes, the neighbourhood of one row, a block of the layout.
Every round is a written table, so a lost executor costs a round. All draws come from seeded hashes and generators per group, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from .similarity import pca

#: Rows of a leaf, in which all distances are taken.
LEAF = 256
#: Up to this many rows the graph is exact: every row of a block is compared with all rows, which costs less than the vectors that a descent moves.
EXACT = 1 << 20
#: Rows of a block of the exact search at most, and of a tile that it is compared with.
SEARCH, TILE = 16384, 2048
#: Rows of a block of the layout.
BLOCK = 2048
#: Steps of the search for a row's scale.
HALVINGS = 48


def clamped_neighbours(n: int, neighbours: int = 15) -> int:
    """Fixed rule: at least 2 and at most n - 1, and never more than asked for. Fewer than 2 rows: ValueError."""
    if n < 2:
        raise ValueError("neighbours need 2 rows at least")
    return min(neighbours, max(2, n - 1))


def clamped_perplexity(n: int, perplexity: float = 30.0) -> float:
    """Fixed rule: at most n - 1, and under n. Fewer than 3 rows: ValueError."""
    if n < 3:
        raise ValueError("a perplexity needs 3 rows at least")
    out = min(perplexity, max(2.0, n - 1))
    return out if out < n else max(1.0, n - 1)


def _numbered(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(u, x): rows with a null key or vector have no place and go."""
    return df.select(F.col(key).alias("u"), F.col(vector).cast("array<float>").alias("x")).where("u is not null and x is not null")


def _leaves(rows: DataFrame, n: int, width: int, trees: int, seed: int) -> DataFrame:
    """(u, x, tree, leaf): each row once in every tree. Leaves are sign patterns about the mean; one with more than LEAF rows is dealt out by hash, so
    that equal rows without number make no large group."""
    mean = np.array([r["m"] for r in rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()])
    bits = max(0, int(np.ceil(np.log2(max(1.0, n / LEAF)))))
    planes = np.random.default_rng(seed).normal(size=(trees, bits, width))

    def patterns(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                m = np.array(p.x.tolist(), dtype=np.float64) - mean
                for t in range(trees):
                    leaf = ((m @ planes[t].T > 0) @ (1 << np.arange(bits, dtype=np.int64))) if bits else np.zeros(len(p), np.int64)
                    yield pd.DataFrame({"u": p.u, "x": p.x, "tree": t, "pattern": leaf})

    made = materialize(rows.mapInPandas(patterns, "u long, x array<float>, tree int, pattern long"), "patterns")
    sizes = made.groupBy("tree", "pattern").agg(F.ceil(F.count("*") / F.lit(LEAF)).cast("int").alias("chunks"))
    dealt = F.struct("pattern", F.pmod(F.xxhash64("u", F.lit(seed)), F.col("chunks")).alias("chunk"))
    return made.join(sizes, ["tree", "pattern"]).select("u", "x", "tree", dealt.alias("leaf"))


def _squares(m: np.ndarray) -> np.ndarray:
    s = (m * m).sum(1)
    return np.maximum(s[:, None] + s[None, :] - 2 * m @ m.T, 0.0)


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """(u, v, d): the k nearest different v of each u, ties by v. A u has bounded many candidates in every step."""
    best = edges.groupBy("u", "v").agg(F.min("d").alias("d")).groupBy("u").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "v"))), 1, k).alias("e"))
    return best.select("u", F.explode("e").alias("e")).select("u", "e.v", "e.d")


def _reversed(graph: DataFrame, k: int, seed: int) -> DataFrame:
    """(u, v): for each row some of the rows that it is a neighbour of, k at most, drawn by hash in two steps; many may point to one."""
    drawn = F.struct(F.xxhash64("u", "v", F.lit(seed)).alias("h"), F.col("u").alias("other"))
    some = lambda rows, *by: rows.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("r")), 1, k).alias("r"))
    first = some(graph.select("v", F.pmod(F.xxhash64("u"), F.lit(64)).alias("salt"), drawn.alias("r")), "v", "salt")
    return some(first.select("v", F.explode("r").alias("r")), "v").select(F.col("v").alias("u"), F.explode("r").alias("r")).select("u", F.col("r.other").alias("v"))


def _vectors(x: pa.ListArray) -> np.ndarray:
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), -1) if len(x) else flat.reshape(0, 0)


def _exact(rows: DataFrame, n: int, keep: int) -> DataFrame:
    """(u, v, d): the `keep` nearest of each u by Euclidean distance, ties by v. A block of rows meets all rows in tiles, in one sorted partition, and
    holds its best only: memory is bounded, a block moves every vector once and n rows take n * n distances."""
    blocks = max(-(-n // SEARCH), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAF)))
    asking = rows.select(F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("held"), "u", "x")
    told = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("held"), "u", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, u, m, squares, v, d = None, [], None, None, None, None, None

        def ready() -> None:
            nonlocal u, m, squares, v, d
            u, m = np.concatenate([a for a, _ in parts]), np.concatenate([x for _, x in parts])
            squares = (m * m).sum(1)
            v, d = np.zeros((len(u), keep), np.int64), np.full((len(u), keep), np.inf)
            parts.clear()

        def meet(other: np.ndarray, x: np.ndarray) -> None:
            norms = (x * x).sum(1)
            for s in range(0, len(u), TILE):
                best, which = d[s : s + TILE], v[s : s + TILE]
                gap = m[s : s + TILE] @ (-2 * x.T)
                gap += squares[s : s + TILE, None]
                gap += norms
                i, j = np.nonzero(gap < best[:, -1:])
                new = u[s + i] != other[j]
                i, j = i[new], j[new]
                if not len(i):
                    continue
                some, first, count = np.unique(i, return_index=True, return_counts=True)
                at, place = np.repeat(np.arange(len(some)), count), keep + np.arange(len(i)) - np.repeat(first, count)
                dd, vv = np.full((len(some), keep + count.max()), np.inf), np.zeros((len(some), keep + count.max()), np.int64)
                dd[:, :keep], vv[:, :keep] = best[some], which[some]
                dd[at, place], vv[at, place] = np.maximum(gap[i, j], 0.0), other[j]
                order = np.argsort(dd, axis=1, kind="stable")[:, :keep]  # others come by their number, so ties keep the smaller
                best[some], which[some] = np.take_along_axis(dd, order, 1), np.take_along_axis(vv, order, 1)

        def out() -> Iterator[pa.RecordBatch]:
            for s in range(0, len(u), TILE):
                a, b, c = np.repeat(u[s : s + TILE], keep), v[s : s + TILE].ravel(), np.sqrt(d[s : s + TILE]).ravel()
                real = np.isfinite(c)
                yield pa.RecordBatch.from_arrays([pa.array(a[real]), pa.array(b[real]), pa.array(c[real])], names=["u", "v", "d"])

        for batch in batches:
            of, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            other, x = batch.column(2).to_numpy(), _vectors(batch.column(3)).astype(np.float64)
            edges = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (held[1:] != held[:-1])]).tolist() if len(of) else []
            for s, e in zip(edges, [*edges[1:], len(of)], strict=True):
                if of[s] != block:
                    if u is not None:
                        yield from out()
                    block, u = of[s], None
                if not held[s]:
                    parts.append((other[s:e], x[s:e]))
                    continue
                if u is None and not parts:
                    continue  # no row asks in this block
                if parts:
                    ready()
                for t in range(s, e, TILE):
                    meet(other[t : min(e, t + TILE)], x[t : min(e, t + TILE)])
        if u is not None:
            yield from out()

    dealt = asking.unionAll(told).repartition(2 * blocks, "block").sortWithinPartitions("block", "held", "u")
    return dealt.mapInArrow(run, "u long, v long, d double")


def neighbour_graph(df: DataFrame, key: str, vector: str, k: int = 15, trees: int = 4, rounds: int = 6, stop: float = 0.002, seed: int = 0) -> DataFrame:
    """(u, v, distance): the k nearest rows of each by Euclidean distance, k clamped to the rows there are: exactly up to EXACT rows, about so beyond.

    Beyond that, leaves of `trees` sets of random planes begin; then rounds of neighbour descent follow: the neighbours of a row, and rows it is a neighbour of, meet
    in one group and become neighbours of one another where that is nearer than what they have. It ends when a share under `stop` of all edges changes. Rows with a null key or vector go;
    keys are whole numbers and unique. A descent's result is approximate; tests measure its recall. Its traffic: 2 k vectors a row and round.
    """
    rows = materialize(_numbered(df, key, vector), "vectors")
    n = rows.count()
    k = clamped_neighbours(n, k)
    keep = min(k, n - 1)
    if n <= EXACT:
        return materialize(_exact(rows, n, keep), "graph").select("u", "v", F.col("d").alias("distance"))
    width = rows.select(F.max(F.size("x")).alias("w")).first()["w"]

    def within(p: pd.DataFrame) -> pd.DataFrame:
        u = p.u.to_numpy()
        d = _squares(np.array(p.x.tolist(), dtype=np.float64))
        np.fill_diagonal(d, np.inf)
        m = min(keep, len(u) - 1)
        near = np.argpartition(d, m - 1, axis=1)[:, :m] if m > 0 else np.empty((len(u), 0), int)
        return pd.DataFrame({"u": np.repeat(u, m), "v": u[near].ravel(), "d": np.sqrt(np.take_along_axis(d, near, 1)).ravel()})

    leaves = _leaves(rows, n, width, trees, seed)
    graph = materialize(_nearest(leaves.groupBy("tree", "leaf").applyInPandas(within, "u long, v long, d double"), keep), "graph")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of every neighbourhood the pairs that are nearer than the worst edge of their first row; arrays of numbers, no object for a member."""
        for batch in batches:
            members = batch.column(0)
            flat, ends = members.flatten(), members.value_lengths().to_numpy().cumsum()
            v, worst = flat.field("v").to_numpy(), flat.field("worst").to_numpy()
            x = _vectors(flat.field("x"))
            for s, e in zip(np.r_[0, ends[:-1]], ends, strict=True):
                u = v[s:e]
                d = np.sqrt(_squares(x[s:e].astype(np.float64)))
                np.fill_diagonal(d, np.inf)
                i, j = np.nonzero(d < worst[s:e, None])
                yield pa.RecordBatch.from_arrays([pa.array(u[i]), pa.array(u[j]), pa.array(d[i, j])], names=["u", "v", "d"])

    for round_ in range(rounds):
        worst = graph.groupBy("u").agg(F.when(F.count("*") >= keep, F.max("d")).otherwise(float("inf")).alias("worst"))
        known = materialize(rows.join(worst, "u", "left").select(F.col("u").alias("v"), "x", F.coalesce("worst", F.lit(float("inf"))).alias("worst")), "worst")
        met_by = graph.select("u", "v").unionAll(_reversed(graph, keep, seed + round_)).distinct().unionAll(rows.select("u", F.col("u").alias("v")))
        around = met_by.join(known, "v").groupBy("u").agg(F.collect_list(F.struct("v", "x", "worst")).alias("members")).select("members")
        found = around.mapInArrow(met, "u long, v long, d double")
        better = materialize(_nearest(graph.unionAll(found), keep), "graph")
        changed = better.join(graph, ["u", "v"], "left_anti").count()
        release(graph)
        release(known)
        graph = better
        if changed <= stop * n * keep:
            break
    return graph.select("u", "v", F.col("d").alias("distance"))


def _scaled(graph: DataFrame, weigh) -> DataFrame:
    """(u, v, w): the weights that weigh(distances) gives the rows of a matrix; rows with fewer neighbours are filled with infinity."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                sizes = p.e.map(len).to_numpy()
                d = np.full((len(p), sizes.max()), np.inf)
                for i, e in enumerate(p.e):
                    d[i, : len(e)] = [x["distance"] for x in e]
                w = weigh(d)
                yield pd.DataFrame({"u": np.repeat(p.u.to_numpy(), sizes), "v": np.concatenate([[x["v"] for x in e] for e in p.e]).astype(np.int64), "w": w[np.isfinite(d)]})

    lists = graph.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("distance", "v"))).alias("e"))
    return lists.mapInPandas(run, "u long, v long, w double")


def _bisected(value, goal: float, size: int) -> np.ndarray:
    """For each row the scale at which value(scale), which grows with it, is goal: doubled until it is passed, then halved."""
    low, high, scale = np.zeros(size), np.full(size, np.inf), np.ones(size)
    for _ in range(HALVINGS):
        over = value(scale) > goal
        high, low = np.where(over, scale, high), np.where(over, low, scale)
        scale = np.where(np.isinf(high), scale * 2, (low + np.minimum(high, 1e300)) / 2)
    return scale


def fuzzy(d: np.ndarray) -> np.ndarray:
    """exp(-(distance - nearest) / scale), the scale such that a row's weights add up to log2 of its neighbours."""
    nearest = np.where(np.isfinite(d) & (d > 0), d, np.inf).min(1, keepdims=True)
    past = np.maximum(d - np.where(np.isfinite(nearest), nearest, 0.0), 0.0)
    weights = lambda scale: np.exp(-past / np.maximum(scale, 1e-12)[:, None])
    return weights(_bisected(lambda s: weights(s).sum(1), float(np.log2(max(2, d.shape[1]))), len(d)))


def by_perplexity(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Normal weights of squared distances, the width such that a row's entropy is that of `perplexity` equal neighbours."""
    squares = np.where(np.isfinite(d), d, 0.0) ** 2
    squares = np.where(np.isfinite(d), squares - np.where(np.isfinite(d), squares, np.inf).min(1, keepdims=True), np.inf)

    def shares(scale: np.ndarray) -> np.ndarray:
        p = np.exp(-squares / np.maximum(scale, 1e-12)[:, None])
        return p / p.sum(1, keepdims=True)

    def entropy(scale: np.ndarray) -> np.ndarray:
        p = shares(scale)
        return -(p * np.log(np.where(p > 0, p, 1.0))).sum(1)

    return shares(_bisected(entropy, float(np.log(perplexity)), len(d)))


def symmetric(weights: DataFrame, union: bool = True) -> DataFrame:
    """(u, v, w) with u < v from both directions: a + b - ab as of fuzzy sets, else their mean."""
    pairs = weights.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.collect_list("w").alias("w"))
    both = F.when(F.size("w") > 1, F.col("w")[0] + F.col("w")[1] - F.col("w")[0] * F.col("w")[1]).otherwise(F.col("w")[0])
    return pairs.select("u", "v", (both if union else F.aggregate("w", F.lit(0.0), lambda a, x: a + x) / 2).alias("w"))


def curve(spread: float, min_dist: float) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d^(2b)) that comes nearest to 1 up to min_dist, then exp(-(d - min_dist) / spread): a grid, made finer around the best."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b, step = 1.0, 1.0, 0.5
    for _ in range(40):
        tried = [(x, y) for x in (a * (1 - step), a, a * (1 + step)) for y in (b * (1 - step / 2), b, b * (1 + step / 2))]
        best = min(tried, key=lambda t: float(((1 / (1 + t[0] * d ** (2 * t[1])) - want) ** 2).sum()))
        step, (a, b) = (step if best != (a, b) else step / 2), best
    return a, b


def layout(edges: DataFrame, start: DataFrame, a: float, b: float, rounds: int = 8, epochs: int = 20, negatives: int = 5, rate: float = 1.0, seed: int = 0) -> DataFrame:
    """(u, place) of start (u, place): edges (u, v, w) draw their ends together, rows drawn at random push each other away.

    A round deals the rows to blocks, anew each time by hash, with their edges and the places that the other ends have. Within a block, minibatches move the
    block's rows for `epochs`; an edge takes part by its weight's share of the largest. The rate falls to nothing over all epochs. Rounds are written tables.
    """
    n, top = start.count(), edges.agg(F.max("w").alias("w")).first()["w"] or 1.0
    ends = edges.select("u", "v", "w").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    ends = materialize(ends.where(F.col("w") > top / (rounds * epochs)).select("u", "v", (F.col("w") / top).alias("p")), "ends")
    blocks, now = max(1, -(-n // BLOCK)), materialize(start, "places")
    total = rounds * epochs

    def moved(round_: int):
        def run(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("u")
            u, y = p.u.to_numpy(), np.array(p.place.tolist(), dtype=np.float64)
            at = {x: i for i, x in enumerate(u.tolist())}
            pairs = [(i, e["v"], e["p"], e["place"]) for i, es in enumerate(p.e) for e in sorted(es if es is not None else (), key=lambda e: e["v"])]
            own = np.array([i for i, *_ in pairs], dtype=np.int64)
            other = np.array([at.get(v, -1) for _, v, *_ in pairs], dtype=np.int64)
            share, fixed = np.array([x for *_, x, _ in pairs]), np.array([z for *_, z in pairs], dtype=np.float64).reshape(-1, y.shape[1])
            rng = np.random.default_rng([seed, round_, int(p.block.iloc[0])])
            for epoch in range(epochs):
                alpha = rate * (1 - (round_ * epochs + epoch) / total)
                for batch in np.array_split(rng.permutation(len(own)), max(1, len(own) // (2 * len(u)))):
                    batch = batch[rng.random(len(batch)) < share[batch]]
                    i, j = own[batch], other[batch]
                    there = np.where((j >= 0)[:, None], y[j], fixed[batch])
                    gap = y[i] - there
                    s = (gap * gap).sum(1)
                    pull = np.where(s > 0, -2 * a * b * np.maximum(s, 1e-12) ** (b - 1) / (1 + a * s**b), 0.0)
                    step = np.clip(pull[:, None] * gap, -4, 4)
                    far = rng.integers(0, len(u), (len(i), negatives))
                    away = y[i][:, None, :] - y[far]
                    s = (away * away).sum(2)
                    push = np.where(far != i[:, None], 2 * b / ((0.001 + s) * (1 + a * s**b)), 0.0)
                    step = step + np.clip(push[:, :, None] * away, -4, 4).sum(1)
                    np.add.at(y, i, alpha * step)
            return pd.DataFrame({"u": u, "place": y.tolist()})

        return run

    for round_ in range(rounds):
        seen = ends.join(now.select(F.col("u").alias("v"), "place"), "v").groupBy("u").agg(F.collect_list(F.struct("v", "p", "place")).alias("e"))
        dealt = now.join(seen, "u", "left").withColumn("block", F.pmod(F.xxhash64("u", F.lit(round_)), F.lit(blocks)).cast("int"))
        after = materialize(dealt.groupBy("block").applyInPandas(moved(round_), "u long, place array<double>"), "places")
        release(now)
        now = after
    return now


def _start(df: DataFrame, key: str, vector: str, components: int, size: float) -> DataFrame:
    """The first principal components, with `size` as the first one's deviation."""
    first = materialize(pca(_numbered(df, key, vector), "u", "x", components), "start")
    spread = first.agg(F.stddev_pop(F.col("components")[0]).alias("s")).first()["s"] or 1.0
    return first.select("u", F.transform("components", lambda c: c * F.lit(size / spread)).alias("place"))


def _columns(placed: DataFrame, key: str, name: str, components: int) -> DataFrame:
    return placed.select(F.col("u").alias(key), *(F.col("place")[i].alias(f"{name}_{i + 1}") for i in range(components)))


def umap(df: DataFrame, key: str, vector: str, components: int = 2, neighbours: int = 15, min_dist: float = 0.1, seed: int = 42, **options) -> DataFrame:
    """(key, umap_1 ..): the layout of the fuzzy neighbour graph. Rows with a null key or vector go; fewer than 2 rows raise ValueError; options are layout()'s."""
    weights = materialize(symmetric(_scaled(neighbour_graph(df, key, vector, neighbours, seed=seed), fuzzy)), "weights")
    return _columns(layout(weights, _start(df, key, vector, components, 5.0), *curve(1.0, min_dist), seed=seed, **options), key, "umap", components)


def tsne(df: DataFrame, key: str, vector: str, components: int = 2, perplexity: float = 30.0, seed: int = 42, **options) -> DataFrame:
    """(key, tsne_1 ..): the layout, with the kernel 1 / (1 + d^2), of weights by perplexity over three times as many neighbours. Fewer than 3 rows raise ValueError."""
    n = _numbered(df, key, vector).count()
    perplexity = clamped_perplexity(n, perplexity)
    graph = neighbour_graph(df, key, vector, min(n - 1, int(3 * perplexity)), seed=seed)
    weights = materialize(symmetric(_scaled(graph, lambda d: by_perplexity(d, min(perplexity, d.shape[1] - 0.5))), union=False), "weights")
    return _columns(layout(weights, _start(df, key, vector, components, 1.0), 1.0, 1.0, seed=seed, **options), key, "tsne", components)

