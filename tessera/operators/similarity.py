"""Vectors: cosine similarity in blocks, scaling, projections, encodings."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import quantiles, running_total


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Rows of a block, of which a task holds two, numbers in its vectors at most, and columns of a tile, whose products are in memory at once (a quarter as many rows).
BLOCK, NUMBERS, TILE = 65536, 1 << 22, 512


def cosine_pairs(df: DataFrame, key: str, vector: str, label: str, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """(a, b, same_label, cosine) for all a < b, the similarity space itself; cosines rounded to `digits`, if given.

    The reference's result is quadratic, so this is for samples and class representatives. Rows go to blocks by hash of the key; each pair of
    blocks is one group of two blocks at most, multiplied in numpy tile by tile, and given out so: no more than a tile's pairs are held.
    """

    def one(pair: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, x, y, s, which in _tiles(pair, parts, ["k"]):
            shape, take = s.shape, (lambda m: m.ravel()) if which is None else (lambda m, which=which: m[which])
            values = take(s)
            values = np.rint(values * 10.0**digits) / 10.0**digits + 0.0 if digits is not None else values.copy()
            low, high = (take(np.broadcast_to(m, shape)) for m in (a[:, None], b[None, :]))
            if pair[0] != pair[1]:
                low, high = np.minimum(low, high), np.maximum(low, high)
            if len(values):
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(take(x[:, None] == y[None, :])), pa.array(values)], names=["a", "b", "same_label", "cosine"])

    return _blocks(df, key, vector, label, block).applyInArrow(_grouped(one), "a long, b long, same_label boolean, cosine double")


def _grouped(one: Callable) -> Callable:
    """A function of plain keys and batches with the hints that tell Spark its kind."""

    def run(pair: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from one(tuple(k.as_py() for k in pair), parts)

    run.__annotations__ = {"pair": tuple[pa.Scalar, ...], "parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _blocks(df: DataFrame, key: str, vector: str, label: str, block: int):
    """Rows grouped by pairs of blocks of `block` rows and NUMBERS numbers at most, about; of a small table there are more, so that every core has some pairs.

    A pair is a long task however few its bytes are, so the pairs are dealt to more partitions than there are pairs, and those aren't put together again.
    """
    told = df.agg(F.count("*").alias("rows"), F.max(F.size(vector)).alias("width")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    block = max(1, min(block, max(TILE, NUMBERS // max(1, told["width"] or 1))))
    n = max(1, -(-told["rows"] // block), min(-(-told["rows"] // TILE), math.ceil(math.sqrt(4 * cores))))
    rows = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(label).cast("int").alias("l"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("own"))
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    return spread.repartition(2 * n * (n + 1), "lo", "hi").groupBy("lo", "hi")


def _side(t: pa.Table, order: list[str]) -> tuple[np.ndarray, ...]:
    """Keys, labels and vectors of length 1 of a block in that order."""
    t = t.take(pa.compute.sort_indices(t.select(["l", "k"]), [(c, "ascending") for c in order]))
    v = t["v"].combine_chunks()
    m = np.array(v.to_pylist(), dtype=np.float64) if v.null_count else v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = m.reshape(len(t), -1)
    return t["k"].to_numpy(), t["l"].to_numpy(), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _tiles(pair: tuple, parts: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[tuple]:
    """Keys and labels of both sides, cosines and which of them count (None: all), of one pair of blocks tile by tile.

    Each pair of rows counts once, those of one key don't. The cosines are in memory that the next tile takes.
    """
    t = pa.Table.from_batches([b.select(["k", "v", "l", "own"]) for b in parts])
    one = pair[0] == pair[1]
    lo, hi = (t.filter(pa.compute.equal(t["own"], block)) for block in pair)
    del t
    if not len(lo) or not len(hi):
        return
    a, x, u = _side(lo, order)
    b, y, w = (a, x, u) if one else _side(hi, order)
    del lo, hi
    unique = len(np.unique(a)) == len(a)
    room = np.empty(TILE * TILE // 4 + TILE)
    high = max(1, TILE // 4)
    for s in range(0, len(a), high):
        for t in range(s // TILE * TILE if one else 0, len(b), TILE):
            left, right = slice(s, s + high), slice(t, t + TILE)
            shape = len(a[left]), len(b[right])
            cosines = np.matmul(u[left], w[right].T, out=room[: shape[0] * shape[1]].reshape(shape))
            which = None
            if one and t < s + high:
                which = np.arange(s, s + shape[0])[:, None] < np.arange(t, t + shape[1])[None, :]
            if one and not unique:
                apart = a[left, None] != b[None, right]
                which = apart if which is None else which & apart
            yield a[left], b[right], x[left], y[right], cosines, which


def _by_kind(x: np.ndarray, y: np.ndarray, s: np.ndarray, which: np.ndarray | None) -> Iterator[tuple[bool, np.ndarray]]:
    """The cosines of a tile under different labels and under the same; where labels are in order most tiles have one kind and aren't copied."""
    if x[-1] < y[0] or y[-1] < x[0]:
        kinds = [(False, None)]
    elif x[0] == x[-1] == y[0] == y[-1]:
        kinds = [(True, None)]
    else:
        same = x[:, None] == y[None, :]
        kinds = [(False, ~same), (True, same)]
    for k, of in kinds:
        of = which if of is None else of if which is None else of & which
        values = s.ravel() if of is None else s[of]
        if len(values):
            yield k, values


# Thresholds and percentiles of a similarity report.
THRESHOLDS = (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.92, 0.94, 0.95, 0.97, 0.98, 0.99)
PERCENTILES = (0, 1, 5, 10, 25, 50, 75, 90, 95, 97.5, 99, 99.5, 100)


def threshold_counts(pairs: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    sums = pairs.agg(F.count("*").alias("n"), *(F.count_if(F.col("cosine") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("n"), (F.col(f"t{i}") / F.col("n")).alias("fraction")) for i, t in enumerate(thresholds)))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def percentiles(df: DataFrame, column: str, at: Sequence[float] = PERCENTILES) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    rows = list(zip([float(x) for x in at], quantiles(df, column, [x / 100 for x in at]), strict=True))
    return df.sparkSession.createDataFrame(rows, "percentile double, value double")


def describe(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    c = F.col(column)
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.percentile(c, F.lit(0.25)).alias("q25"), F.median(c).alias("median"), F.percentile(c, F.lit(0.75)).alias("q75"), F.max(c).alias("max"))


def scale(df: DataFrame, columns: Sequence[str], how: str = "standard") -> DataFrame:
    """Columns scaled as standard (population deviation), minmax or maxabs by statistics of one aggregate over df; l1, l2, max per row. Constant columns: 0 spread counts as 1."""
    cols = [F.col(c) for c in columns]
    if how in ("l1", "l2", "max"):
        norm = {"l1": sum((F.abs(c) for c in cols), F.lit(0.0)), "l2": F.sqrt(sum((c * c for c in cols), F.lit(0.0))), "max": F.greatest(*(F.abs(c) for c in cols), F.lit(0.0))}[how]
        return df.withColumns({c: F.coalesce(F.try_divide(F.col(c).cast("double"), norm), F.lit(0.0)) for c in columns})
    one = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), ("abs", lambda c: F.max(F.abs(c)))))).first()
    shift = {"standard": "avg", "minmax": "min"}
    spread = lambda c: {"standard": one[f"std_{c}"], "minmax": (one[f"max_{c}"] or 0) - (one[f"min_{c}"] or 0), "maxabs": one[f"abs_{c}"]}[how] or 1.0
    return df.withColumns({c: (F.col(c) - F.lit(float(one[f"{shift[how]}_{c}"] or 0) if how in shift else 0.0)) / F.lit(float(spread(c))) for c in columns})


def fit_scale(df: DataFrame, columns: Sequence[str], how: str = "standard") -> dict[str, tuple[float, float]]:
    """For each column (shift, spread) by one aggregate over df: standard, minmax or maxabs, for use on other rows."""
    one = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), ("abs", lambda c: F.max(F.abs(c)))))).first()
    n = lambda k, c: float(one[f"{k}_{c}"] or 0.0)
    kinds = {"standard": lambda c: (n("avg", c), n("std", c)), "minmax": lambda c: (n("min", c), n("max", c) - n("min", c)), "maxabs": lambda c: (0.0, n("abs", c))}
    return {c: (shift, spread or 1.0) for c in columns for shift, spread in [kinds[how](c)]}


def transform_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(shift)) / F.lit(spread) for c, (shift, spread) in fitted.items()})


def yeo_johnson(x: Column, power: float) -> Column:
    """The Yeo-Johnson transform: a Box-Cox power of x + 1 for x >= 0, of 1 - x with 2 - power and the sign turned below; logarithms where the power is 0."""

    def one(size: Column, p: float) -> Column:
        log = F.log1p(size)
        return log if abs(p) < 1e-12 else F.expm1(log * F.lit(p)) / F.lit(p)

    x = x.cast("double")
    return F.when(x >= 0, one(x, power)).when(x < 0, -one(-x, 2.0 - power))


def _likelihoods(df: DataFrame, tried: dict[str, list[float]]) -> dict[str, list[float]]:
    """For each column the log-likelihood, by row, of a normal distribution after each of its powers: one aggregate for all columns and powers."""
    sums = [F.avg(F.signum(F.col(c)) * F.log1p(F.abs(F.col(c).cast("double")))).alias(f"shift_{i}") for i, c in enumerate(tried)]
    sums += [F.var_pop(yeo_johnson(F.col(c), p)).alias(f"v_{i}_{j}") for i, (c, powers) in enumerate(tried.items()) for j, p in enumerate(powers)]
    one = df.agg(*sums).first()
    least = float("-inf")
    of = lambda i, j, p: least if not (v := one[f"v_{i}_{j}"]) or v != v else -0.5 * math.log(v) + (p - 1) * one[f"shift_{i}"]
    return {c: [of(i, j, p) for j, p in enumerate(powers)] for i, (c, powers) in enumerate(tried.items())}


def fit_power(df: DataFrame, columns: Sequence[str], width: float = 2.0, candidates: int = 9, precision: float = 1e-6) -> dict[str, tuple[float, float, float]]:
    """For each column (power, mean, deviation) of the Yeo-Johnson transform with the largest likelihood, for use on other rows; nulls don't count.

    The maximum is bracketed: each step tries `candidates` powers around the best so far, in one aggregate for all columns; where the best is at an end the
    bracket moves on, else it closes to the best one's neighbours, until it is narrower than `precision`. A column without spread has power 1 and deviation 1.
    """
    ends = df.agg(*(f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max)))).first()
    flat = {c for i, c in enumerate(columns) if ends[f"low_{i}"] == ends[f"high_{i}"]}
    best, reach = dict.fromkeys(columns, 1.0), {c: 0.0 if c in flat else width for c in columns}
    while open_ := [c for c in columns if reach[c] > precision]:
        steps = {c: [best[c] + reach[c] * (2 * j / (candidates - 1) - 1) for j in range(candidates)] for c in open_}
        for c, values in _likelihoods(df, steps).items():
            at = max(range(candidates), key=lambda j, values=values: (values[j], -abs(j - candidates // 2)))
            if values[at] == float("-inf"):
                reach[c] = 0.0
                continue
            best[c] = steps[c][at]
            if 0 < at < candidates - 1 or abs(best[c]) > 64:
                reach[c] *= 2 / (candidates - 1)
    one = df.agg(*(f(yeo_johnson(F.col(c), best[c])).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("avg", F.avg), ("std", F.stddev_pop)))).first()
    return {c: (best[c], float(one[f"avg_{i}"] or 0.0), 1.0 if c in flat else float(one[f"std_{i}"] or 0.0) or 1.0) for i, c in enumerate(columns)}


def transform_power(df: DataFrame, fitted: dict[str, tuple[float, float, float]]) -> DataFrame:
    return df.withColumns({c: (yeo_johnson(F.col(c), power) - F.lit(mean)) / F.lit(deviation) for c, (power, mean, deviation) in fitted.items()})


def fit_quantile(df: DataFrame, column: str, quantiles: int = 1000) -> list[float]:
    """The column's values at evenly spaced ranks, linear between neighbours: the landmarks of a map to uniform quantiles; fewer where there are fewer rows.

    Equal values are counted first and ranges of values summed up, so no task sorts the column.
    """
    counted = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    m = max(2, min(quantiles, total))
    wanted = [i * (total - 1) / (m - 1) for i in range(m)]
    ranks = sorted({r for w in wanted for r in (math.floor(w), math.ceil(w))})
    held = running_total(counted, [], "v", F.col("n")).where(F.size(F.filter(F.array(*(F.lit(r) for r in ranks)), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))) > 0)
    at = sorted((row["before"], row["n"], row["v"]) for row in held.collect())
    starts = [b for b, _, _ in at]
    value = lambda r: at[bisect.bisect_right(starts, r) - 1][2]
    return [value(math.floor(w)) + (w - math.floor(w)) * (value(math.ceil(w)) - value(math.floor(w))) for w in wanted]


def transform_quantile(df: DataFrame, column: str, landmarks: Sequence[float]) -> DataFrame:
    """The column mapped to [0, 1] through fit_quantile()'s landmarks: the mean of what its place from below and from above give, as equal landmarks make steps; nulls stay."""
    x, n = F.col(column).cast("double"), len(landmarks)
    marks = F.array(*(F.lit(float(v)) for v in landmarks))
    below, under = F.size(F.filter(marks, lambda v: v < x)), F.size(F.filter(marks, lambda v: v <= x))
    between = lambda i: (i - 1 + (x - F.get(marks, i - 1)) / (F.get(marks, i) - F.get(marks, i - 1))) / F.lit(max(n - 1, 1))
    place = F.when(below != under, (below + under - 1) / F.lit(2.0 * max(n - 1, 1))).when(below == 0, 0.0).when(below == n, 1.0).otherwise(between(below))
    return df.withColumn(column, F.when(x.isNotNull(), place))


def cosine_summary(df: DataFrame, key: str, vector: str, label: str, block: int = BLOCK) -> DataFrame:
    """(same_label, n, total, squares, least, most, at_least) over all pairs: counts, sums and the numbers at and over each of THRESHOLDS.

    As cosine_pairs(), but each pair of tiles gives two rows and no pair leaves its task.
    """

    def one(pair: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, x, y, s, which in _tiles(pair, parts, ["l", "k"]):
            rows = [(k, len(v), v.sum(), v @ v, v.min(), v.max(), [int((v >= t).sum()) for t in THRESHOLDS]) for k, v in _by_kind(x, y, s, which)]
            if not rows:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["same_label", "n", "total", "squares", "least", "most", "at_least"])

    each = _blocks(df, key, vector, label, block).applyInArrow(_grouped(one), "same_label boolean, n long, total double, squares double, least double, most double, at_least array<long>")
    sums = [F.sum(F.col("at_least")[i]) for i in range(len(THRESHOLDS))]
    return each.groupBy("same_label").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"), F.array(*sums).alias("at_least"))


#: Rows that the first ranges of pair_quantiles() are taken from; they change only how much its passes have to look into.
TRIED = 2048


def pair_quantiles(df: DataFrame, key: str, vector: str, label: str, at: Sequence[float] = (0.25, 0.5, 0.75), block: int = BLOCK, bins: int = 1 << 16, most: int = 1 << 20) -> DataFrame:
    """(same_label, n, mean, std, min, q<percent> .., max) of the cosines of all pairs, exact, without a table of pairs.

    TRIED rows tell a range in which a quantile should lie. One pass over all pairs counts those below it and those in `bins` even bins of it, beside sums and extremes; a
    quantile that isn't there after all is counted again over all cosines. The last pass gives out the different cosines, with their numbers, of the bins that hold the ranks. While
    these hold over `most`, a pass between divides them in as many bins again. All passes take the rows in one order, so a cosine has one value.
    """
    grouped = _blocks(df, key, vector, label, block)
    Cell = tuple[bool, float, float, tuple[int, ...]]  # kind, range, and bins in it, each of the one before

    def count(cells: list[Cell]) -> pd.DataFrame:
        """Of each cell the number below its range (bin -1) and in each of its bins; cells -2 and -1: of all cosines under different labels and the same."""

        def one(pair: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, all_, sums, ends = np.zeros((len(cells), bins + 1), np.int64), [0, 0], np.zeros((2, 2)), np.array([[np.inf, -np.inf]] * 2)
            for _, _, x, y, s, which in _tiles(pair, parts, ["l", "k"]):
                for same, v in _by_kind(x, y, s, which):
                    k = int(same)
                    all_[k] += len(v)
                    sums[k] += v.sum(), v @ v
                    ends[k] = min(ends[k][0], v.min()), max(ends[k][1], v.max())
                    for i, cell in enumerate(cells):
                        if cell[0] == same:
                            below, _, held = _inside(v, cell, bins)
                            n[i][-1] += below
                            if len(held):
                                n[i][:-1] += np.bincount(held, minlength=bins)
            rows = [(k - 2, 0, all_[k], *sums[k], *ends[k]) for k in (0, 1) if all_[k]]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
            for i, of in enumerate(n):
                b = np.flatnonzero(of)
                no = pa.array(np.zeros(len(b)))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(b), pa.int64()), pa.array(np.where(b == bins, -1, b)), pa.array(of[b]), no, no, no, no], schema=schema)

        names = ["cell", "bin", "n", "total", "squares", "least", "most"]
        schema = pa.schema(list(zip(names, [pa.int64()] * 3 + [pa.float64()] * 4, strict=True)))
        each = grouped.applyInArrow(_grouped(one), "cell long, bin long, n long, total double, squares double, least double, most double")
        return each.groupBy("cell", "bin").agg(*(f(c).alias(c) for c, f in zip(names[2:], (F.sum, F.sum, F.sum, F.min, F.max), strict=True))).toPandas()

    def kept(cells: list[Cell]) -> pd.DataFrame:
        """The different cosines in each cell and their numbers."""

        def one(pair: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[np.ndarray]] = [[] for _ in cells]

            def out(i: int) -> pa.RecordBatch:
                v, n = np.unique(np.concatenate(held[i]), return_counts=True)
                held[i] = []
                return pa.RecordBatch.from_arrays([pa.array([i] * len(v), pa.int64()), pa.array(v), pa.array(n)], names=["cell", "cosine", "n"])

            for _, _, x, y, s, which in _tiles(pair, parts, ["l", "k"]):
                for same, v in _by_kind(x, y, s, which):
                    for i, cell in enumerate(cells):
                        if cell[0] == same and len(found := _inside(v, cell, bins)[1]):
                            held[i].append(found)
                            if sum(map(len, held[i])) >= 1 << 20:
                                yield out(i)
            yield from (out(i) for i in range(len(cells)) if held[i])

        return grouped.applyInArrow(_grouped(one), "cell long, cosine double, n long").groupBy("cell", "cosine").agg(F.sum("n").alias("n")).toPandas()

    ranges = _likely(df, key, vector, label, at)
    left: dict[tuple[bool, float], Cell] = {kq: (kq[0], *r, ()) for kq, r in ranges.items()}
    told: dict[bool, tuple] = {}
    asked: list[tuple[bool, float, float, Cell, int]] = []
    inside: dict[Cell, int] = {}

    def descend(cell: Cell, rank: int, p: pd.DataFrame) -> tuple[Cell, int] | None:
        """The cell of the bin that holds a rank of a cell, and the rank in it."""
        p = p.sort_values("bin")
        before = p.n.cumsum() - p.n
        i = int(np.searchsorted(before, rank, side="right")) - 1
        if p.bin.iloc[i] < 0 or rank >= before.iloc[-1] + p.n.iloc[-1]:
            return None
        inner = (*cell[:3], (*cell[3], int(p.bin.iloc[i])))
        inside[inner] = int(p.n.iloc[i])
        return inner, rank - int(before.iloc[i])

    while left:
        cells = sorted(set(left.values()))
        found = count(cells)
        for p in found[found.cell < 0].itertuples():
            mean = p.total / p.n
            told[p.cell == -1] = (p.cell == -1, int(p.n), mean, math.sqrt(max(p.squares - p.n * mean * mean, 0.0) / (p.n - 1)) if p.n > 1 else None, p.least, p.most)
        of, again = dict(list(found.groupby("cell"))), {}
        for (k, q), cell in left.items():
            place = q * (told[k][1] - 1) if k in told else 0
            ends = sorted({math.floor(place), math.ceil(place)}) if k in told else []
            hits = [descend(cell, rank, of[cells.index(cell)]) if cells.index(cell) in of else None for rank in ends]
            if None in hits:
                again[k, q] = (k, -1.0, 2.0, ())
            else:
                asked += [(k, q, 1 - abs(place - rank), *hit) for rank, hit in zip(ends, hits, strict=True)]
        left = again
    depth = 1
    inside = {cell: inside[cell] for *_, cell, _ in asked}
    while sum(inside.values()) > most and depth < 3:  # then a bin is about as narrow as the rounding of its values
        cells, depth = sorted(inside), depth + 1
        of, inside = dict(list((found := count(cells))[(found.cell >= 0) & (found.bin >= 0)].groupby("cell"))), {}
        asked = [(k, q, share, *descend(cell, rank, of[cells.index(cell)])) for k, q, share, cell, rank in asked]
    cells = sorted(inside)
    values = {cells[i]: p.sort_values("cosine") for i, p in kept(cells).groupby("cell")} if cells else {}
    quantile = dict.fromkeys(((k, q) for k, q, *_ in asked), 0.0)
    for k, q, share, cell, rank in asked:
        p = values[cell]
        quantile[k, q] += share * float(p.cosine.iloc[int(np.searchsorted(p.n.cumsum(), rank, side="right"))])
    names = ["same_label", "n", "mean", "std", "min", *(f"q{q * 100:g}" for q in at), "max"]
    rows = [(*told[k][:5], *(quantile[k, q] for q in at), told[k][5]) for k in sorted(told)]
    made = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([pa.field(c, t) for c, t in zip(names, [pa.bool_(), pa.int64(), *[pa.float64()] * (len(names) - 2)], strict=True)]))
    return df.sparkSession.createDataFrame(made)


def _likely(df: DataFrame, key: str, vector: str, label: str, at: Sequence[float]) -> dict[tuple[bool, float], tuple[float, float]]:
    """For each kind of pairs and quantile a range (low, width) that holds it but for bad luck, from the pairs of rows that a hash draws."""
    out = {(k, q): (-1.0, 2.0) for k in (False, True) for q in at}
    some = df.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(label).cast("int").alias("l")).orderBy(F.xxhash64("k"), "k").limit(TRIED).toArrow()
    if not len(some):
        return out
    _, labels, u = _side(some, ["k"])
    cosines, same = u @ u.T, labels[:, None] == labels[None, :]
    np.fill_diagonal(cosines, np.nan)
    for k in (False, True):
        of = (same == k) & ~np.isnan(cosines)
        n, values = of.sum(1), np.sort(cosines[of])
        if len(values) < 1024:
            continue
        for q in at:
            # a row's pairs move together: the spread of the rows' shares below the quantile tells how far the share of a sample strays
            off = n * q - (of & (cosines <= np.quantile(values, q))).sum(1)
            err = 10 * math.sqrt(float((off * off).sum())) / len(values) + 5 * math.sqrt(q * (1 - q) / len(values))
            low, high = (float(np.quantile(values, x)) if 0 < x < 1 else e for x, e in ((q - err, -1.0), (q + err, 1.0)))
            if -1.0 <= low < high <= 1.0:
                out[k, q] = low, high - low
    return out


def _bin(x: np.ndarray, bins: int, low: float = -1.0, width: float = 2.0) -> np.ndarray:
    """The bin of each cosine, even ones from low on."""
    place = x - low
    place *= bins / width
    return np.clip(place, 0, bins - 1, out=place).astype(np.intp)


def _inside(x: np.ndarray, cell: tuple, bins: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many cosines are below a cell's range, which lie in its bin, of a bin and so on, and their bins in that one."""
    _, low, width, path = cell
    below = 0
    if (low, width) != (-1.0, 2.0):  # else rounding may put cosines outside, and these are in the outer bins
        near = x >= low
        if not path:
            below = len(x) - int(np.count_nonzero(near))
        near &= x < low + width
        x = x[near]
    elif path and 0 < path[0] < bins - 1:  # the bin and its neighbours, so that few places are worked out
        inner = width / bins
        x = x[(x >= low + (path[0] - 1) * inner) & (x <= low + (path[0] + 2) * inner)]
    for b in path:
        x = x[_bin(x, bins, low, width) == b]
        low, width = low + b * (width / bins), width / bins
    return below, x, _bin(x, bins, low, width)


def summary_thresholds(summary: DataFrame) -> DataFrame:
    """threshold_counts() of a cosine_summary()."""
    one = summary.agg(F.sum("n").alias("n"), *(F.sum(F.col("at_least")[i]).alias(f"t{i}") for i in range(len(THRESHOLDS))))
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("n"), (F.col(f"t{i}") / F.col("n")).alias("fraction")) for i, t in enumerate(THRESHOLDS)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def summary_moments(summary: DataFrame) -> DataFrame:
    """(mean, std_population) of a cosine_summary()."""
    mean = F.col("total") / F.col("n")
    one = summary.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    return one.select(mean.alias("mean"), F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))).alias("std_population"))


def quantile_scale(df: DataFrame, column: str) -> DataFrame:
    """Uniform quantiles from ranks of different values, (rank - 1) / (n - 1)."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    total = counted.agg(F.sum("__n")).first()[0] or 0
    ranks = running_total(counted, [], column, F.col("__n")).select(F.col(column).alias("__v"), ((F.col("before") + (F.col("__n") + 1) / F.lit(2.0) - 1) / F.lit(max(total - 1, 1))).alias("quantile"))
    return df.join(ranks, F.col(column) == F.col("__v")).drop("__v")


def pca(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """(key, components) by the covariance of all rows, summed up in numpy for each partition; signs fixed by the largest loading."""

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, 0.0, 0.0
        for p in parts:
            m = np.array(p.v.tolist(), dtype=np.float64)
            if len(m):
                n, s, q = n + len(m), s + m.sum(0), q + m.T @ m
        if n:
            yield pd.DataFrame([(n, s.tolist(), q.ravel().tolist())], columns=["n", "s", "q"])

    got = df.select(F.col(vector).alias("v")).mapInPandas(sums, "n long, s array<double>, q array<double>")
    total = got.agg(F.sum("n").alias("n")).first()["n"]
    if not total:
        return df.select(key, F.lit(None).cast("array<double>").alias("components"))
    width = len(df.select(vector).first()[0])
    add = lambda c, m: [r["x"] for r in got.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").limit(m).collect()]
    mean = np.array(add("s", width)) / total
    cov = np.array(add("q", width * width)).reshape(width, width) / total - np.outer(mean, mean)
    w, v = np.linalg.eigh(cov)
    axes = v[:, ::-1][:, :k].T
    axes = axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(1)])[:, None]
    lit = lambda x: F.array(*(F.lit(float(y)) for y in x))
    return df.select(key, F.array(*(dot(F.col(vector), lit(a)) - float(a @ mean) for a in axes)).alias("components"))
