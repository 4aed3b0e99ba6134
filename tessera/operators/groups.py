"""Groups of near vectors: links under a distance, found within leaves of random planes and then between all blocks that these left apart, and their connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release

#: Rows of a side of a block in which all distances are taken.
SIDE = 1024
#: Sets of random planes whose leaves are searched first; how many changes only what is left to the blocks.
TREES = 4
#: Rows that the grid's distances are measured from, taken apart from one another among so many.
PIVOTS, TRIED = 2, 512


def _pivots(rows: DataFrame) -> np.ndarray:
    """PIVOTS vectors far from each other, of TRIED that a hash draws; where they lie changes only how well the grid parts the rows."""
    tried = np.array([r["x"] for r in rows.orderBy(F.xxhash64("u"), "u").limit(TRIED).collect()], dtype=np.float64)
    chosen = tried[:1]
    while 0 < len(chosen) < PIVOTS:
        gaps = np.sqrt(((tried[:, None, :] - chosen[None, :, :]) ** 2).sum(2)).min(1)
        chosen = np.concatenate([chosen, tried[[gaps.argmax()]]])
    return chosen


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of a matrix of links, so a block never gives more edges than rows."""
    left, a, b = np.ones(len(linked), bool), [], []
    for start in range(len(linked)):
        front = [start] if left[start] else []
        left[start] = False
        while front:
            i = front.pop()
            new = np.flatnonzero(linked[i] & left)
            left[new] = False
            a.extend([i] * len(new))
            b.extend(new.tolist())
            front.extend(new.tolist())
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


def _exact(m: np.ndarray, other: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of rows of two matrices within limit. What is near by the quick sum is measured once more, difference by difference."""
    near = (m * m).sum(1)[:, None] + (other * other).sum(1)[None, :] - 2 * m @ other.T <= limit * limit * (1 + 1e-6)
    i, j = np.nonzero(near)
    held = np.concatenate([((m[i[k : k + 65536]] - other[j[k : k + 65536]]) ** 2).sum(1) for k in range(0, len(i), 65536)] or [np.empty(0)]) <= limit * limit
    return i[held], j[held]


def _first_links(rows: DataFrame, limit: float) -> DataFrame:
    """(a, b): links of pairs within limit that share a leaf of some random planes; a leaf gives a spanning forest. Only a part of all, but each is one."""
    told = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    bits = max(0, int(np.ceil(np.log2(max(1.0, told["n"] / SIDE)))))
    planes = np.random.default_rng(0).normal(size=(TREES, bits, told["width"] or 0))

    def patterns(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                m = np.array(p.x.tolist(), dtype=np.float64)
                yield pd.DataFrame({"u": p.u, "x": p.x, "leaf": np.stack([(m @ planes[t].T > 0) @ (1 << np.arange(bits, dtype=np.int64)) for t in range(TREES)], 1).tolist()})

    made = rows.mapInPandas(patterns, "u long, x array<double>, leaf array<long>").select("u", "x", F.posexplode("leaf").alias("tree", "leaf"))
    made = materialize(made, "leaves")
    sizes = made.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / F.lit(SIDE)).cast("int").alias("chunks"))
    dealt = made.join(sizes, ["tree", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("u", "tree"), F.col("chunks")))

    def within(p: pd.DataFrame) -> pd.DataFrame:
        u, m = p.u.to_numpy(), np.array(p.x.tolist(), dtype=np.float64)
        near = np.zeros((len(u), len(u)), bool)
        near[_exact(m, m, limit)] = True
        np.fill_diagonal(near, False)
        a, b = _forest(near)
        return pd.DataFrame({"a": np.minimum(u[a], u[b]), "b": np.maximum(u[a], u[b])})

    links = materialize(dealt.select("tree", "leaf", "chunk", "u", "x").groupBy("tree", "leaf", "chunk").applyInPandas(within, "a long, b long").distinct(), "first")
    release(made)
    return links


def near_links(df: DataFrame, key: str, vector: str, most: float, metric: str = "cosine") -> DataFrame:
    """(a, b): links that join all rows within `most` of one another, and no others, through chains of such pairs.

    metric is euclidean, or cosine (1 - similarity); for the latter rows get length 1, where the square of the Euclidean distance is twice that. Leaves of random planes give
    first links. What these join needs no more of its pairs: rows are packed into blocks of SIDE by component, if that is large, and by their distances to two pivots. Of all
    pairs of blocks those are measured that aren't of one component and whose distances to each pivot come within the limit, as two rows within it differ by no more there. So every
    pair of rows in different components is measured or too far by a pivot. Blocks are read from their table, not shuffled: what is written grows with the rows, the time at worst
    with their square. Rows with a null key or vector, and by cosine those of length 0, have no links; rows under one key are one. Keys are whole numbers.
    """
    if metric not in ("cosine", "euclidean") or most <= 0:
        raise ValueError("metric is cosine or euclidean, and the distance over 0")
    limit = float(np.sqrt(2 * most)) if metric == "cosine" else float(most)
    rows = df.select(F.col(key).cast("long").alias("u"), F.col(vector).cast("array<double>").alias("x")).where("u is not null and x is not null").dropDuplicates(["u"])
    if metric == "cosine":
        length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
        rows = rows.withColumn("length", length).where("length > 0").select("u", F.transform("x", lambda v: v / F.col("length")).alias("x"))
    rows = materialize(rows, "vectors")
    pivots = _pivots(rows)
    if not len(pivots):
        return rows.select(F.col("u").alias("a"), F.col("u").alias("b"))
    first = _first_links(rows, limit)
    roots = materialize(components(first), "first-roots")
    large = roots.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= SIDE).select("root", F.col("root").alias("large"))
    told = rows.join(roots, "u", "left").select("u", "x", F.coalesce("root", "u").alias("root")).join(large, "root", "left")

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                m = np.array(p.x.tolist(), dtype=np.float64)
                far = np.sqrt(((m[:, None, :] - pivots[None, :, :]) ** 2).sum(2))
                yield p.assign(far=far.tolist(), cell=np.floor(far / limit).astype(np.int64).tolist())[["u", "x", "root", "large", "far", "cell"]]

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Neighbouring rows as one: a large component's rows are never packed with others."""
        kept: list[pd.DataFrame] = []
        for p in chain(parts, [None]):
            if p is not None and len(p):
                kept.append(p)
                if sum(map(len, kept)) < 8 * SIDE:
                    continue
            if not kept:
                continue
            for _, g in pd.concat(kept).groupby("large", dropna=False, sort=False):
                for at in range(0, len(g), SIDE):
                    q = g.iloc[at : at + SIDE]
                    far = np.array(q.far.tolist())
                    yield pd.DataFrame({"block": [int(q.u.iloc[0])], "u": [q.u.to_numpy()], "root": [q.root.to_numpy()], "x": [np.array(q.x.tolist(), dtype=np.float64).tobytes()], "low": [far.min(0)], "high": [far.max(0)], "least": [int(q.root.min())], "greatest": [int(q.root.max())]})
            kept = []

    order = [F.col("large"), *(F.col("cell")[i] for i in range(len(pivots))), F.col("u")]
    ordered = told.mapInPandas(placed, "u long, x array<double>, root long, large long, far array<double>, cell array<long>").orderBy(*order)
    blocks = materialize(ordered.mapInPandas(packed, "block long, u array<long>, root array<long>, x binary, low array<double>, high array<double>, least long, greatest long"), "blocks")
    other = blocks.select(*(F.col(c).alias(f"{c}_2") for c in blocks.columns))
    one = (F.col("least") == F.col("greatest")) & (F.col("least") == F.col("least_2")) & (F.col("least") == F.col("greatest_2"))
    meet = (F.col("block") <= F.col("block_2")) & ~one
    for i in range(len(pivots)):  # a little wider than the limit, as the distances are rounded
        meet &= (F.col("low")[i] <= F.col("high_2")[i] + limit * (1 + 1e-6)) & (F.col("low_2")[i] <= F.col("high")[i] + limit * (1 + 1e-6))

    def linked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples(index=False):
                i, j = _exact(np.frombuffer(r.x).reshape(len(r.u), -1), np.frombuffer(r.x_2).reshape(len(r.u_2), -1), limit)
                a, b = np.asarray(r.root)[i], np.asarray(r.root_2)[j]
                apart = a != b
                pairs = np.unique(np.stack([np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])], 1), axis=0)
                if len(pairs):
                    yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    # roots stand for their rows: what the first links join is one anyway. A pair of blocks is a megabyte, so few go to a worker at once
    met = blocks.join(other, meet).select("u", "root", "x", "u_2", "root_2", "x_2")
    return first.unionAll(met.mapInPandas(linked, "a long, b long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every end of edges (a, b): the least number in its component.

    In each round every root takes its least neighbour's, chains of those are halved until they are one step, and the edges are drawn between the roots left. Rounds
    are written tables and about as many as the logarithm of the longest path. Null ends and loops add nothing.
    """
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    total = None
    while now.limit(1).count():
        ends = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        up = materialize(ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("root"), F.lit(True).alias("moved")), "up")
        while up.where("moved").limit(1).count():
            ahead = up.select(F.col("u").alias("root"), F.col("root").alias("next"))
            further = materialize(up.join(ahead, "root").select("u", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "up")
            release(up)
            up = further
        up = up.select("u", "root")
        if total is None:
            total = up
        else:
            step = up.select(F.col("u").alias("root"), F.col("root").alias("next"))
            total = materialize(total.join(step, "root", "left").select("u", F.coalesce("next", "root").alias("root")), "roots")
        a, b = (up.select(F.col("u").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
        drawn = now.join(a, "a").join(b, "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        after = materialize(drawn.where("a <> b").distinct(), "edges")
        release(now)
        now = after
    return total if total is not None else now.select(F.col("a").alias("u"), F.col("b").alias("root"))


def near_groups(df: DataFrame, key: str, vector: str, most: float, metric: str = "cosine") -> DataFrame:
    """df with `group`: the least key that chains of rows within `most` of one another lead to; a row without links, or with a null vector, is its own. Null keys: null."""
    roots = materialize(components(near_links(df, key, vector, most, metric)), "groups").withColumnsRenamed({"u": "__u", "root": "__root"})
    return df.join(roots, F.col(key) == F.col("__u"), "left").withColumn("group", F.coalesce("__root", F.col(key))).drop("__u", "__root")
