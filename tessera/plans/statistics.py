"""Queries of statistics, similarity and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import significance_stars
from ..operators import groups, similarity, splits, stats
from .adapters import table
from .evidence import HIERARCHY, pivot
from .registry import query


def p_values(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 11 != 0, (F.col("p_partkey") * 37 % 1000) / 1000.0).alias("p_value"))


@query("""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 37 % 1000) / 1000.0::DOUBLE END AS p_value FROM part),
r AS (SELECT *, p_value * count(p_value) OVER (PARTITION BY p_brand) / row_number() OVER w AS q, row_number() OVER w AS rn FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY p_value NULLS LAST, p_partkey))
SELECT p_partkey, p_brand, p_value, CASE WHEN p_value IS NOT NULL THEN least(1.0, min(q) OVER (PARTITION BY p_brand ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) END AS q_value FROM r""")  # fmt: skip
def bh_adjust(spark, d):
    return stats.adjust_bh(p_values(spark, d), by=["p_brand"])


@query("""WITH p AS (SELECT CASE WHEN p_partkey % 11 <> 0 THEN pow(10.0, -(p_partkey % 7)) END AS p FROM part) SELECT p, CASE WHEN p IS NULL THEN '' WHEN p <= 1e-4 THEN '****' WHEN p <= 1e-3 THEN '***' WHEN p <= 1e-2 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS stars, count(*) AS n FROM p GROUP BY ALL""")
def significance(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 11 != 0, F.pow(F.lit(10.0), -(F.col("p_partkey") % 7).cast("double"))).alias("p"))
    return p.groupBy("p", significance_stars(F.col("p")).alias("stars")).agg(F.count("*").alias("n"))


GROUPS = """v AS (SELECT l_shipmode AS descriptor, grp, value FROM (SELECT 'd' || (l_linenumber % 3) AS l_shipmode, CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 1 END AS grp, l_quantity AS value FROM lineitem) WHERE grp IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY descriptor ORDER BY value) + (count(*) OVER (PARTITION BY descriptor, value) - 1) / 2.0::DOUBLE AS rk FROM v),
t AS (SELECT descriptor, sum(c * c * c - c) AS ties FROM (SELECT descriptor, value, count(*)::DOUBLE AS c FROM v GROUP BY ALL) GROUP BY descriptor),
u AS (SELECT descriptor, count(*) FILTER (grp = 0) AS n, count(*) FILTER (grp = 1) AS m, sum(rk) FILTER (grp = 0) AS rank_sum, ties FROM r JOIN t USING (descriptor) GROUP BY ALL),
e AS (SELECT *, rank_sum - n * (n + 1) / 2.0::DOUBLE AS u FROM u)"""


def group_values(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("d"), (F.col("l_linenumber") % 3).cast("string")).alias("descriptor"), F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).alias("grp"), F.col("l_quantity").alias("value")).where("grp is not null")


def ranked(spark, d):
    return stats.effect_sizes(stats.rank_sums(group_values(spark, d), "grp", "value", ["descriptor"]))


@query(f"WITH {GROUPS} SELECT descriptor, n, m, u, round(2 * u / (n * m) - 1, 9) AS cliffs_delta FROM e")
def cliffs_delta(spark, d):
    return ranked(spark, d).select("descriptor", "n", "m", "u", F.round("cliffs_delta", 9).alias("cliffs_delta"))


@query(f"WITH {GROUPS} SELECT descriptor, round(u / (n * m), 9) AS vargha_delaney FROM e")
def vargha_delaney(spark, d):
    return ranked(spark, d).select("descriptor", F.round("vargha_delaney", 9).alias("vargha_delaney"))


@query(f"""WITH {GROUPS}, z AS (SELECT *, greatest(0, (abs(u - n * m / 2.0::DOUBLE) - 0.5) / sqrt(n * m / 12.0::DOUBLE * (n + m + 1 - ties / ((n + m) * (n + m - 1.0::DOUBLE))))) AS z FROM e),
x AS (SELECT *, z / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * z / sqrt(2.0::DOUBLE)) AS t FROM z)
SELECT descriptor, u, round(z, 6) AS z, round(t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-x * x), 6) AS p_value, round(2 * u / (n * m) - 1, 9) AS rank_biserial FROM x""")  # fmt: skip
def mann_whitney(spark, d):
    return stats.mann_whitney(ranked(spark, d)).select("descriptor", "u", F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value"), F.round("rank_biserial", 9).alias("rank_biserial"))


@query(f"""WITH {GROUPS}, g AS (SELECT descriptor, median(value) FILTER (grp = 0) AS median_a, median(value) FILTER (grp = 1) AS median_b, round(avg(value) FILTER (grp = 0), 9) AS mean_a, round(avg(value) FILTER (grp = 1), 9) AS mean_b FROM v GROUP BY descriptor)
SELECT *, median_b - median_a AS diff_median, CASE WHEN median_b > median_a THEN '↑ in B' WHEN median_b < median_a THEN '↓ in B' ELSE '=' END AS direction FROM g""")  # fmt: skip
def direction_table(spark, d):
    return stats.direction_table(group_values(spark, d), ["descriptor"], "grp", "value").drop("diff_mean").withColumns({"mean_a": F.round("mean_a", 9), "mean_b": F.round("mean_b", 9)})


PREDICTED = """pr AS (SELECT (l_returnflag = 'R')::INT AS truth, (l_quantity > 25)::INT AS guess, l_quantity AS score, l_extendedprice AS price, l_quantity * 1000.0::DOUBLE AS expected FROM lineitem)"""


def predicted(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("truth"), (F.col("l_quantity") > 25).cast("int").alias("guess"), F.col("l_quantity").alias("score"), F.col("l_extendedprice").alias("price"), (F.col("l_quantity") * 1000.0).alias("expected"))


@query(f"""WITH {PREDICTED}, c AS (SELECT count(*) FILTER (truth = 0 AND guess = 0) AS tn, count(*) FILTER (truth = 0 AND guess = 1) AS fp, count(*) FILTER (truth = 1 AND guess = 0) AS fn, count(*) FILTER (truth = 1 AND guess = 1) AS tp FROM pr)
SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
  round((tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc FROM c""")  # fmt: skip
def confusion_metrics(spark, d):
    out = stats.confusion(predicted(spark, d), "truth", "guess")
    return out.select(*(c if c in ("tn", "fp", "fn", "tp") else F.round(c, 9).alias(c) for c in out.columns))


_RANKS = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"


@query(f"WITH {PREDICTED} SELECT round(corr(a, b), 9) AS spearman FROM (SELECT {_RANKS.format('price')} AS a, {_RANKS.format('expected')} AS b FROM pr)")
def spearman(spark, d):
    return stats.regression_metrics(predicted(spark, d), "price", "expected").select(F.round("spearman", 9).alias("spearman"))


@query(f"WITH {PREDICTED}, e AS (SELECT price, price - expected AS e FROM pr) SELECT round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / (var_pop(price) * count(*)), 6) AS r2, round(avg(e), 4) AS residual_mean, round(median(e), 4) AS residual_median, round(stddev_samp(e), 4) AS residual_std FROM e")
def regression_metrics(spark, d):
    m = stats.regression_metrics(predicted(spark, d), "price", "expected")
    return m.select(*(F.round(c, 6 if c == "r2" else 4).alias(c) for c in m.columns if c != "spearman"))


@query(f"""WITH {PREDICTED}, r AS (SELECT truth, score, {_RANKS.format('score')} AS rk FROM pr), s AS (SELECT score, sum(truth) AS p, count(*) AS n FROM pr GROUP BY score),
k AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS a FROM s)
SELECT round((sum(rk) FILTER (truth = 1) - count(*) FILTER (truth = 1) * (count(*) FILTER (truth = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (truth = 1)::DOUBLE * count(*) FILTER (truth = 0)), 9) AS roc_auc, (SELECT round(sum(p * tp / a) / sum(p), 9) FROM k) AS average_precision FROM r""")  # fmt: skip
def roc_auc(spark, d):
    out = stats.roc_auc(predicted(spark, d), "truth", "score")
    return out.select(*(F.round(c, 9).alias(c) for c in out.columns))


@query(None)
def permutation_test(spark, d):
    return stats.compare_groups(group_values(spark, d))


@query(None)
def bootstrap_ci(spark, d):
    return stats.compare_groups(group_values(spark, d), stat=stats.mean_difference, n_perm=0).select("descriptor", "cliffs_delta", "ci_low", "ci_high")


# ---- similarity: vectors of the embeddings table, all pairs as the reference has them
COS = """pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same_label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"""


def summed(spark, d):
    return similarity.cosine_summary(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


@query(f"WITH {COS} SELECT a, b, same_label, round(cosine, 7) AS cosine FROM pairs")
def cosine_pairs(spark, d):
    return similarity.cosine_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", "label", digits=7)


@query(f"WITH {COS} SELECT t AS threshold, count(*) FILTER (cosine >= t) AS n, count(*) FILTER (cosine >= t) / count(*) AS fraction FROM pairs, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in similarity.THRESHOLDS)}]) AS t) GROUP BY t")
def cosine_thresholds(spark, d):
    return similarity.summary_thresholds(summed(spark, d))


@query(f"WITH {COS} SELECT same_label, count(*) AS n, round(avg(cosine), 7) AS mean, round(stddev_samp(cosine), 7) AS std, round(min(cosine), 7) AS min, round(max(cosine), 7) AS max, round(median(cosine), 7) AS median FROM pairs GROUP BY same_label")
def pair_type_stats(spark, d):
    out = similarity.pair_quantiles(table(spark, d, "embeddings"), "vec_id", "embedding", "label", at=(0.5,)).withColumnRenamed("q50", "median")
    return out.select("same_label", "n", *(F.round(c, 7).alias(c) for c in ("mean", "std", "min", "max", "median")))


@query(f"WITH {COS} SELECT round(avg(cosine), 7) AS mean, round(stddev_pop(cosine), 7) AS std_population FROM pairs")
def similarity_summary(spark, d):
    return similarity.summary_moments(summed(spark, d)).select(F.round("mean", 7).alias("mean"), F.round("std_population", 7).alias("std_population"))


_P = similarity.PERCENTILES


@query(f"SELECT unnest([{', '.join(f'{float(p)}::DOUBLE' for p in _P)}]) AS percentile, unnest(quantile_cont(l_extendedprice, [{', '.join(str(p / 100) for p in _P)}])) AS value FROM lineitem")
def percentile_table(spark, d):
    return similarity.percentiles(table(spark, d, "lineitem"), "l_extendedprice")


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 9) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 9) AS p_retailprice FROM part")
def scale_standard(spark, d):
    out = similarity.scale(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return out.select("p_partkey", F.round("p_size", 9).alias("p_size"), F.round("p_retailprice", 9).alias("p_retailprice"))


@query("SELECT p_partkey, round((p_size - min(p_size) OVER ()) / (max(p_size) OVER () - min(p_size) OVER ()), 9) AS p_size FROM part")
def scale_minmax(spark, d):
    return similarity.scale(table(spark, d, "part").select("p_partkey", "p_size"), ["p_size"], "minmax").select("p_partkey", F.round("p_size", 9).alias("p_size"))


@query("SELECT p_partkey, round(p_size / max(abs(p_size)) OVER (), 9) AS p_size FROM part")
def scale_maxabs(spark, d):
    return similarity.scale(table(spark, d, "part").select("p_partkey", "p_size"), ["p_size"], "maxabs").select("p_partkey", F.round("p_size", 9).alias("p_size"))


@query("SELECT p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 9) AS p_size, round(p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice), 9) AS p_retailprice FROM part")
def normalize_l2(spark, d):
    out = similarity.scale(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], "l2")
    return out.select("p_partkey", F.round("p_size", 9).alias("p_size"), F.round("p_retailprice", 9).alias("p_retailprice"))


@query("SELECT p_partkey, round((rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER () - 1), 9) AS quantile FROM part")
def scale_quantile(spark, d):
    return similarity.quantile_scale(table(spark, d, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", F.round("quantile", 9).alias("quantile"))


@query(None)
def pca_projection(spark, d):
    out = similarity.pca(table(spark, d, "embeddings"), "vec_id", "embedding")
    return out.select("vec_id", F.round(F.col("components")[0], 6).alias("pc1"), F.round(F.col("components")[1], 6).alias("pc2"))


# ---- splits of the binary hemolytic set
SPLIT = f"""{HIERARCHY}, s AS (SELECT id, hemolytic AS label FROM pivoted WHERE hemolytic IN (0, 1))"""


def binary(spark, d):
    return pivot(spark, d).where(F.col("hemolytic").isin(0, 1)).select("id", F.col("hemolytic").alias("label"))


_VAL = "('0x' || substr(md5('val7:' || id), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < 0.1::DOUBLE"


@query(f"WITH {SPLIT} SELECT id, label, ((row_number() OVER (ORDER BY md5('7:' || id), id) - 1) % 5)::INT AS fold, {_VAL} AS in_val FROM s")
def kfold_random(spark, d):
    return splits.kfold(binary(spark, d), seed=7)


STRAT = f"{SPLIT}, f AS (SELECT id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('7:' || id), id) - 1) % 5)::INT AS fold, {_VAL} AS in_val FROM s)"
ASSIGNED = f"{STRAT}, a AS (SELECT k AS fold, CASE WHEN k = fold THEN 'test' WHEN in_val THEN 'val' ELSE 'train' END AS part, id, label FROM (SELECT f.fold, f.in_val, f.id, f.label, k FROM f, (SELECT unnest(range(5))::INT AS k)))"


def stratified(spark, d):
    return splits.kfold(binary(spark, d), seed=7, stratified=True)


@query(f"WITH {STRAT} SELECT * FROM f")
def kfold_stratified(spark, d):
    return stratified(spark, d)


@query(f"WITH {ASSIGNED} SELECT fold, part, count(*) AS n, count(DISTINCT label) AS classes, 0::BIGINT AS null_labels, count(DISTINCT label) >= 2 AS ok FROM a GROUP BY ALL")
def split_validation(spark, d):
    return splits.validate(splits.assignments(stratified(spark, d)))


@query(f"WITH {ASSIGNED} SELECT fold, part, count(*) AS n, count(*) FILTER (label = 0) AS negative, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 1) / count(*) AS positive_fraction FROM a GROUP BY ALL")
def partition_summary(spark, d):
    return splits.partition_summary(splits.assignments(stratified(spark, d)))


@query(f"WITH {SPLIT} SELECT count(*) AS n_rows, 0::BIGINT AS null_ids, 0::BIGINT AS null_labels, 0::BIGINT AS conflicting_ids FROM s")
def split_source_checks(spark, d):
    return splits.source_checks(binary(spark, d))


@query("SELECT TRUE AS ok, '' AS reason")
def split_precheck(spark, d):
    return splits.precheck(binary(spark, d), 5, stratified=True)


@query(f"WITH {ASSIGNED} SELECT id, sum((part = 'test')::INT)::BIGINT AS n_test, count(*) AS n_parts, p.sequence FROM a JOIN pivoted p USING (id) GROUP BY id, p.sequence")
def split_reconstruct(spark, d):
    """Every sequence from the folds: once tested, five times placed."""
    a = splits.assignments(stratified(spark, d)).groupBy("id").agg(F.count_if(F.col("part") == "test").alias("n_test"), F.count("*").alias("n_parts"))
    return a.join(pivot(spark, d).select("id", "sequence"), "id")


RUNS = "runs AS (SELECT o_orderpriority AS strategy, o_orderstatus AS scenario, (o_custkey % 30)::INT AS seed, CASE WHEN o_orderkey % 5 = 0 THEN 'invalid_split' ELSE 'kept' END AS status FROM orders)"


def runs(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("strategy"), F.col("o_orderstatus").alias("scenario"), (F.col("o_custkey") % 30).cast("int").alias("seed"), F.when(F.col("o_orderkey") % 5 == 0, "invalid_split").otherwise("kept").alias("status"))


@query(f"""WITH {RUNS} SELECT scenario, strategy, count(*) AS n_runs, count(*) FILTER (status = 'kept') AS n_kept, count(*) FILTER (status <> 'kept') AS n_invalid, array_to_string(list_sort(list_distinct(list(seed) FILTER (status = 'kept'))), ',') AS kept_seeds,
  count(*) FILTER (status = 'kept') / count(*) AS kept_rate, count(*) FILTER (status <> 'kept') / count(*) AS invalid_rate FROM runs GROUP BY ALL""")  # fmt: skip
def split_summary(spark, d):
    return splits.status_summary(runs(spark, d), ["scenario", "strategy"])


@query(f"WITH {RUNS} SELECT strategy, avg((status = 'kept')::INT) FILTER (scenario = 'F') AS F, avg((status = 'kept')::INT) FILTER (scenario = 'O') AS O, avg((status = 'kept')::INT) FILTER (scenario = 'P') AS P FROM runs GROUP BY strategy")
def split_heatmap(spark, d):
    return splits.heatmap(runs(spark, d), "strategy", "scenario", ["F", "O", "P"])


@query("SELECT dataset, strategy, level, seed, dataset || '__' || level || '__' || strategy AS scenario FROM (SELECT unnest(['toxic', 'hemolytic']) AS dataset), (SELECT unnest(['random_kfold', 'stratified_kfold', 'distance_aware_kfold']) AS strategy), (SELECT unnest(['no_threshold', 'p70_0']) AS level), (SELECT unnest(range(30))::INT AS seed)")
def split_registry(spark, d):
    return splits.registry(spark, ["toxic", "hemolytic"], ["random_kfold", "stratified_kfold", "distance_aware_kfold"], list(range(30)), ["no_threshold", "p70_0"])


@query("""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND 1 - list_cosine_similarity(a.v, b.v) <= 0.6),
  reach(u, r) AS (SELECT vec_id, vec_id FROM e UNION SELECT reach.u, near.b FROM reach JOIN near ON near.a = reach.r),
  g AS (SELECT u, min(r) AS g FROM reach GROUP BY u)
  SELECT u AS vec_id, g AS "group", count(*) OVER (PARTITION BY g) AS size FROM g""")  # fmt: skip
def distance_groups(spark, d):
    rows = groups.near_groups(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 0.6)
    return rows.join(rows.groupBy("group").agg(F.count("*").alias("size")), "group").select("vec_id", "group", "size")


@query(None)
def kfold_distance(spark, d):
    return splits.distance_folds(table(spark, d, "embeddings"), "embedding", 0.6, seed=7, key="vec_id")
