"""Rank statistics, tests, metrics. Ranks come from windows over one group, so an effect size needs no pair of observations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import significance_stars
from ..session import materialize


def adjust_bh(df: DataFrame, p: str = "p_value", out: str = "q_value", by: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg: the minimum of p * m / rank over this and larger ranks, 1 at most. Null p stays null and isn't counted."""
    every = Window.partitionBy(*by)
    m = F.count(p).over(every)
    up = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last())
    ranked = df.withColumn("__r", F.row_number().over(up)).withColumn("__q", F.col(p) * m / F.col("__r"))
    down = Window.partitionBy(*by).orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__q").over(down)))).drop("__r", "__q")


def running_total(counted: DataFrame, by: Sequence[str], value: str, amount: Column, parts: int = 64) -> DataFrame:
    """counted with `before`: the amounts of all smaller values of the same `by`. Values must be different within `by` and not null.

    Values fall into about even ranges by approximate cut points of their own group; the ranges' totals are summed up (`parts` rows for each `by`), and a
    window only orders one range, so no task sorts all values of a group.
    """
    counted = counted.withColumn("__one", F.lit(1))
    cuts = counted.groupBy(*by, "__one").agg(F.percentile_approx(value, F.array(*(F.lit(i / parts) for i in range(1, parts)))).alias("__cuts"))
    same = F.col("__one") == F.col("__1")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__c_{b}"))
    cut = counted.withColumn("__amount", amount).join(cuts.select(F.col("__one").alias("__1"), "__cuts", *(F.col(b).alias(f"__c_{b}") for b in by)), same)
    cut = cut.withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts", "__1", "__one", *(f"__c_{b}" for b in by))
    totals = cut.groupBy(*by, "__range").agg(F.sum("__amount").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*(F.col(b).alias(f"__{b}") for b in by), F.col("__range").alias("__of"), ahead.alias("__ahead"))
    within = F.coalesce(F.sum("__amount").over(Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on = F.col("__range") == F.col("__of")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"__{b}"))
    out = cut.withColumn("__within", within).join(totals, on)
    return out.withColumn("before", F.col("__ahead") + F.col("__within")).drop("__amount", "__range", "__within", "__of", "__ahead", *(f"__{b}" for b in by))


def quantiles(df: DataFrame, column: str | Column, at: Sequence[float]) -> list[float | None]:
    """The values at shares `at` of a numeric column's order, exact and linear between neighbours; nulls don't count, an empty column has nulls.

    Equal values are counted first and ranges of values summed up, so no task reads or sorts the column.
    """
    value = F.col(column) if isinstance(column, str) else column
    counted = materialize(df.select(value.cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")), "counted")
    total = counted.agg(F.sum("n")).first()[0] or 0
    if not total:
        return [None] * len(at)
    places = [q * (total - 1) for q in at]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    held = running_total(counted, [], "v", F.col("n")).where(F.exists(F.array(*(F.lit(r) for r in ranks)), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))))
    found = [(r["before"], r["before"] + r["n"], r["v"]) for r in held.collect()]
    value_at = {r: next(v for low, high, v in found if low <= r < high) for r in ranks}
    between = lambda p, a, b: a if a == b else a + (p - math.floor(p)) * (b - a)
    return [between(p, value_at[math.floor(p)], value_at[math.ceil(p)]) for p in places]


def rank_sums(values: DataFrame, group: str, value: str, by: Sequence[str]) -> DataFrame:
    """For each `by` and two groups 0 and 1: sizes, the rank sum and U of group 0, and the tie term of the variance.

    Equal values are counted first, so each different value is ranked once and the count of those before gives the mean rank.
    """
    counted = values.where(F.col(value).isNotNull() & F.col(group).isin(0, 1)).groupBy(*by, value).agg(F.count_if(F.col(group) == 0).alias("a"), F.count_if(F.col(group) == 1).alias("b"))
    t = F.col("a") + F.col("b")
    ranked = running_total(counted, by, value, t).withColumn("rank", F.col("before") + (t + 1) / F.lit(2.0))
    out = ranked.groupBy(*by).agg(F.sum("a").alias("n"), F.sum("b").alias("m"), F.sum(F.col("rank") * F.col("a")).alias("rank_sum"), F.sum(t.cast("double") * t * t - t).alias("ties"))
    return out.withColumn("u", F.col("rank_sum") - F.col("n") * (F.col("n") + 1) / 2.0)


def effect_sizes(ranked: DataFrame) -> DataFrame:
    """Cliff's delta and Vargha-Delaney A from U."""
    a = F.try_divide(F.col("u"), (F.col("n") * F.col("m")).cast("double"))
    return ranked.withColumns({"vargha_delaney": a, "cliffs_delta": a * 2 - 1})


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, by Abramowitz and Stegun 7.1.26 (error below 1.5e-7); fixed coefficients."""
    t = 1 / (1 + x * 0.3275911)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def mann_whitney(ranked: DataFrame) -> DataFrame:
    """Two-sided p by the normal approximation with tie and continuity correction, and the rank-biserial correlation."""
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    mean, total = n * m / 2, n + m
    variance = n * m / 12 * (total + 1 - F.try_divide(F.col("ties"), total * (total - 1)))
    z = F.greatest(F.lit(0.0), (F.abs(F.col("u") - mean) - 0.5) / F.sqrt(F.nullif(variance, F.lit(0.0))))
    return ranked.withColumns({"z": z, "p_value": _erfc(z / math.sqrt(2.0)), "rank_biserial": F.try_divide(F.col("u") * 2, n * m) - 1})


def direction_table(values: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """Median and mean of groups 0 and 1, the difference of medians (1 minus 0) and its direction."""
    pick = lambda g: F.when(F.col(group) == g, F.col(value))
    out = values.groupBy(*by).agg(F.median(pick(0)).alias("median_a"), F.median(pick(1)).alias("median_b"), F.avg(pick(0)).alias("mean_a"), F.avg(pick(1)).alias("mean_b"))
    diff = F.col("median_b") - F.col("median_a")
    return out.withColumns({"diff_median": diff, "diff_mean": F.col("mean_b") - F.col("mean_a"), "direction": F.when(diff > 0, "↑ in B").when(diff < 0, "↓ in B").otherwise("=")})


def average_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    for c in cols:
        counted = df.groupBy(c).agg(F.count("*").alias("n"))
        ranks = running_total(counted.where(F.col(c).isNotNull()), [], c, F.col("n")).select(F.col(c).alias("__v"), (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias(f"rank_{c}"))
        df = df.join(ranks, F.col(c) == F.col("__v")).drop("__v")
    return df


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """MAE, RMSE, R2, Spearman and the residuals' mean, median and sample deviation."""
    e = F.col(truth) - F.col(guess)
    ranked = average_ranks(df.select(truth, guess), [truth, guess])
    one = ranked.agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(F.var_pop(truth) * F.count(truth), F.lit(0.0))).alias("r2"),
        F.corr(f"rank_{truth}", f"rank_{guess}").alias("spearman"), F.avg(e).alias("residual_mean"), F.lit(quantiles(df, e, [0.5])[0]).cast("double").alias("residual_median"), F.stddev_samp(e).alias("residual_std"),
    )
    return one


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """tn, fp, fn, tp and what follows from them; ratios without a denominator are 0."""
    c = lambda t, g: F.count_if((F.col(truth) == t) & (F.col(guess) == g))
    out = df.agg(c(0, 0).alias("tn"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(1, 1).alias("tp"))
    r = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    mcc = r((tp * tn - fp * fn), F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn)))
    return out.withColumns({"accuracy": r(tp + tn, tp + tn + fp + fn), "balanced_accuracy": (r(tp, tp + fn) + r(tn, tn + fp)) / 2, "precision": r(tp, tp + fp), "recall": r(tp, tp + fn), "f1": r(tp * 2, tp * 2 + fp + fn), "mcc": mcc})


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by ranks, and average precision by cumulative counts over different scores."""
    ranked = effect_sizes(rank_sums(df.withColumn("__g", 1 - F.col(truth)), "__g", score, []))
    counted = df.where(F.col(score).isNotNull()).groupBy((-F.col(score)).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count("*").alias("n"))
    steps = running_total(running_total(counted, [], "s", F.col("p")).withColumnRenamed("before", "p_before"), [], "s", F.col("n"))
    steps = steps.withColumns({"tp": F.col("p_before") + F.col("p"), "all": F.col("before") + F.col("n")})
    ap = steps.agg((F.sum(F.col("p") * F.col("tp") / F.col("all")) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"))
    return ranked.select(F.col("vargha_delaney").alias("roc_auc")).join(ap)


def permutation_p(x: np.ndarray, y: np.ndarray, stat: Callable, n_perm: int, rng: np.random.Generator) -> tuple[float, float]:
    """Observed statistic and the share of permutations at least as far from zero."""
    both, n = np.concatenate([x, y]), len(x)
    observed = stat(x, y)
    far = sum(abs(stat((z := rng.permutation(both))[:n], z[n:])) >= abs(observed) for _ in range(n_perm))
    return float(observed), far / n_perm if n_perm else float("nan")


def resampled(x: np.ndarray, y: np.ndarray, stat: Callable, n_boot: int, rng: np.random.Generator, balanced: bool = True) -> list[float]:
    """The statistic over subsamples of the smaller size without replacement, or classic resamples."""
    n = min(len(x), len(y))
    draw = (lambda v: rng.choice(v, n, replace=False)) if balanced else (lambda v: rng.choice(v, len(v), replace=True))
    return [float(stat(draw(x), draw(y))) for _ in range(n_boot)]


def bootstrap_interval(x: np.ndarray, y: np.ndarray, stat: Callable, n_boot: int, rng: np.random.Generator, balanced: bool = True) -> tuple[float, float]:
    """2.5 and 97.5 percentiles of resampled()."""
    low, high = np.percentile(resampled(x, y, stat, n_boot, rng, balanced), [2.5, 97.5])
    return float(low), float(high)


def median_difference(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.median(x) - np.median(y))


def mean_difference(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(x) - np.mean(y))


def delta(x: np.ndarray, y: np.ndarray) -> float:
    """Cliff's delta through sorted positions."""
    s = np.sort(y)
    return float((np.searchsorted(s, x, "left") - (len(y) - np.searchsorted(s, x, "right"))).sum() / (len(x) * len(y)))


def _counted_median(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row of counts, the median of values that occur so often; values are sorted."""
    ends, n = counts.cumsum(1), counts.sum(1, keepdims=True)
    at = lambda place: values[np.minimum((ends <= place).sum(1), len(values) - 1)]
    return (at((n - 1) // 2) + at(n // 2)) / 2


def _counted_mean(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return counts @ values / counts.sum(1)


#: Statistics that are told from how often each of the sorted different values occurs in x and in y, a row for each draw; others get the values themselves.
COUNTED: dict[Callable, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {
    median_difference: lambda v, x, y: _counted_median(v, x) - _counted_median(v, y),
    mean_difference: lambda v, x, y: _counted_mean(v, x) - _counted_mean(v, y),
    delta: lambda v, x, y: (x * (2.0 * y.cumsum(1) - y - y.sum(1, keepdims=True))).sum(1) / (x.sum(1).astype(float) * y.sum(1)),
}


def of_counts(stat: Callable, values: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The statistic for each row of the counts x and y of sorted values."""
    if stat in COUNTED:
        return COUNTED[stat](values, x, y)
    return np.array([stat(np.repeat(values, a), np.repeat(values, b)) for a, b in zip(x, y, strict=True)], dtype=float)


def permuted_counts(a: np.ndarray, b: np.ndarray, draws: int, rng: np.random.Generator, cells: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Permutations of two groups by the counts of their values, some rows at a time: how often each value falls into the first is multivariate hypergeometric, so a
    draw costs the different values and not the rows. Up to a billion rows, numpy's limit."""
    step = max(1, cells // len(a))
    for start in range(0, draws, step):
        x = rng.multivariate_hypergeometric(a + b, int(a.sum()), size=min(step, draws - start), method="marginals")
        yield x, (a + b) - x


def subsampled_counts(a: np.ndarray, b: np.ndarray, draws: int, rng: np.random.Generator, cells: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Subsamples of the smaller group's size without replacement, as permuted_counts()."""
    n, step = int(min(a.sum(), b.sum())), max(1, cells // len(a))
    for start in range(0, draws, step):
        size = min(step, draws - start)
        x, y = (rng.multivariate_hypergeometric(c, n, size=size, method="marginals") for c in (a, b))
        yield x, y


def compare_groups(values: DataFrame, stat: Callable = median_difference, n_perm: int = 20000, n_boot: int = 5000, seed: int = 42, block: int = 500) -> DataFrame:
    """Permutation test and bootstrap interval of Cliff's delta for every descriptor of (descriptor, grp 0/1, value), then BH, stars and selection.

    Equal values are counted first and draws are made of the counts. Draws are dealt out in blocks of `block`, each with a seed of the descriptor's name and its
    number, so the result doesn't depend on the order of tasks; a task holds the counts of one descriptor's different values.
    """
    counts = values.where("value is not null and grp in (0, 1)").groupBy("descriptor", "value").agg(F.count_if(F.col("grp") == 0).alias("a"), F.count_if(F.col("grp") == 1).alias("b"))
    blocks = max(1, -(-n_perm // block), -(-n_boot // block))
    spread = counts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("value")
        v, a, b = p.value.to_numpy(), p.a.to_numpy(np.int64), p.b.to_numpy(np.int64)
        n_a, n_b = int(a.sum()), int(b.sum())
        rng = np.random.default_rng([seed, int(key[1]), *str(key[0]).encode()])
        mine = lambda n: int(min(block, max(0, n - key[1] * block)))
        if not n_a or not n_b:
            return pd.DataFrame([(key[0], n_a, n_b, None, None, None, [])], columns=cols)
        observed = float(of_counts(stat, v, a[None], b[None])[0])
        far = sum(int((np.abs(of_counts(stat, v, x, y)) >= abs(observed)).sum()) for x, y in permuted_counts(a, b, mine(n_perm), rng))
        draws = [float(d) for x, y in subsampled_counts(a, b, mine(n_boot), rng) for d in of_counts(delta, v, x, y)]
        return pd.DataFrame([(key[0], n_a, n_b, observed, far, float(of_counts(delta, v, a[None], b[None])[0]), draws)], columns=cols)

    cols = ["descriptor", "n_a", "n_b", "stat_observed", "far", "cliffs_delta", "draws"]
    drawn = spread.groupBy("descriptor", "block").applyInPandas(draw, "descriptor string, n_a long, n_b long, stat_observed double, far long, cliffs_delta double, draws array<double>")
    p = F.when(F.lit(n_perm > 0), F.sum("far") / F.lit(max(1, n_perm))).otherwise(F.lit(float("nan")))
    one = drawn.groupBy("descriptor").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.first("stat_observed").alias("stat_observed"), F.when(F.first("stat_observed").isNotNull(), p).alias("p_value"), F.first("cliffs_delta").alias("cliffs_delta"), F.flatten(F.collect_list("draws")).alias("draws"))
    # percentiles of the few thousand draws, with linear interpolation
    at = lambda q: F.transform(F.array(F.array_sort("draws")), lambda d: _between(d, (F.size(d) - 1) * F.lit(q)))[0]
    out = one.withColumns({"ci_low": at(0.025), "ci_high": at(0.975)}).drop("draws")
    out = adjust_bh(out)
    return out.withColumns({"stars": significance_stars(F.col("q_value")), "selected": F.coalesce((F.abs("cliffs_delta") >= 0.15) & (F.col("q_value") <= 0.05), F.lit(False))})


def _between(ordered: Column, place: Column) -> Column:
    """The value at a place of an ordered array, between two elements in proportion; null for an empty one."""
    low = F.floor(place).cast("int")
    a, b = F.get(ordered, F.greatest(low, F.lit(0))), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return a + (b - a) * (place - low)


def selected_directions(selected: DataFrame, diff: str = "stat_observed", out: str = "diff_B_minus_A") -> DataFrame:
    """The descriptors of a selection with the direction of their difference, by q, p and name; the difference under the name `out`."""
    d = F.col(diff)
    told = selected.withColumn("direction", F.when(d > 0, "↑ in B").when(d < 0, "↓ in B").otherwise("="))
    return told.withColumnRenamed(diff, out).orderBy(F.col("q_value").asc_nulls_last(), F.col("p_value").asc_nulls_last(), "descriptor")


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, n_missing, n_distinct, mean, std, min, median, max) of numeric columns: the tables of a data report, in one pass and one count of different values."""
    one = df.agg(*(f.alias(f"{n}_{c}") for c in columns for n, f in (("n", F.count(c)), ("miss", F.count_if(F.col(c).isNull())), ("uniq", F.approx_count_distinct(c, 0.01)), ("mean", F.avg(c)), ("std", F.stddev_samp(c)), ("min", F.min(c).cast("double")), ("median", F.lit(quantiles(df, c, [0.5])[0])), ("max", F.max(c).cast("double")))))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.col(f"miss_{c}").alias("n_missing"), F.col(f"uniq_{c}").alias("n_distinct"), *(F.col(f"{k}_{c}").cast("double").alias(k) for k in ("mean", "std", "min", "median", "max"))) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, pearson) for every two different columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("pearson")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("r")).select("r.*")
