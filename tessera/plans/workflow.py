"""Queries of the split workflow, of checks and of report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity, splits, stats, workflow
from .adapters import table
from .registry import query
from .statistics import ASSIGNED, SPLIT, binary, stratified


@query("""SELECT p_partkey, level, nullif(regexp_extract(level, '([0-9]+(_[0-9]+)?)$', 1), '') AS x, replace(nullif(regexp_extract(level, '([0-9]+(_[0-9]+)?)$', 1), ''), '_', '.')::DOUBLE AS value
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'p' || p_size || '_5' ELSE 'threshold_' || p_size END AS level FROM part)""")  # fmt: skip
def level_values(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size").cast("string")
    level = F.when(F.col("p_partkey") % 5 == 0, "").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("p"), size, F.lit("_5"))).otherwise(F.concat(F.lit("threshold_"), size))
    p = p.select("p_partkey", level.alias("level"))
    return p.withColumns({"x": F.nullif(F.regexp_extract("level", "([0-9]+(_[0-9]+)?)$", 1), F.lit("")), "value": workflow.level_value(F.col("level"))})


@query("SELECT scenario, seed, n FROM (SELECT o_orderpriority AS scenario, o_custkey % 30 AS seed, count(*) AS n FROM orders GROUP BY ALL) WHERE n > 1")
def scenario_collisions(spark, d):
    return workflow.unique_scenarios(table(spark, d, "orders").select(F.col("o_orderpriority").alias("scenario"), (F.col("o_custkey") % 30).alias("seed")))


BASIC = """b AS (SELECT l_partkey AS id, arg_min(l_returnflag, (l_orderkey, l_linenumber, l_extendedprice)) AS label FROM lineitem GROUP BY l_partkey)"""


def basic(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("label"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return workflow.basic_dataset(li, F.struct("l_orderkey", "l_linenumber", "l_extendedprice"))


@query(f"WITH {BASIC} SELECT * FROM b")
def basic_dataset(spark, d):
    return basic(spark, d)[0]


@query(f"WITH {BASIC} SELECT label, count(*) AS n FROM b GROUP BY label")
def basic_distribution(spark, d):
    return basic(spark, d)[1]


@query("""SELECT vec_id AS id, label, row_number() OVER (ORDER BY place) AS place, len(embedding) AS width FROM embeddings JOIN (SELECT p_partkey * 2 AS vec_id, p_partkey * 3 + 7 AS place FROM part) USING (vec_id)""")
def distance_dataset(spark, d):
    """The split's labels and order, not those of the representation."""
    e = table(spark, d, "embeddings")
    split = table(spark, d, "part").select((F.col("p_partkey") * 2).alias("id"), (F.col("p_partkey") * 3 + 7).alias("place")).join(e.select(F.col("vec_id").alias("id"), "label"), "id", "left")
    out = workflow.distance_dataset(split, e.select(F.col("vec_id").alias("id"), F.size("embedding").alias("width"), F.lit(-1).alias("label")))
    return out.select("id", "label", "place", "width")


@query(f"""WITH {ASSIGNED}, p AS (SELECT fold, part, CASE WHEN fold = 3 AND md5(id) < '1' THEN NULL ELSE id END AS id, CASE WHEN fold = 4 AND md5(id) < '1' THEN NULL ELSE label END AS label FROM a WHERE fold <> 2 OR md5(id) >= '1'),
g AS (SELECT fold, part, count(*) AS n, count(*) - count(id) AS null_ids, count(*) - count(label) AS null_labels FROM p GROUP BY ALL)
SELECT fold, part, n, null_ids, null_labels, null_ids = 0 AND null_labels = 0 AND sum(n) OVER (PARTITION BY fold) = (SELECT count(*) FROM s) AS ok FROM g""")  # fmt: skip
def compact_folds(spark, d):
    """Of five folds one lacks rows, one has rows without id and one without label."""
    hit = F.md5("id") < "1"
    folds = splits.assignments(stratified(spark, d)).where((F.col("fold") != 2) | ~hit)
    folds = folds.select("fold", "part", F.when((F.col("fold") != 3) | ~hit, F.col("id")).alias("id"), F.when((F.col("fold") != 4) | ~hit, F.col("label")).alias("label"))
    return workflow.compact(folds, binary(spark, d))


@query(f"""WITH {SPLIT} SELECT 'hemolytic' AS scenario, 'stratified_kfold' AS strategy, 7 AS seed, 'p70_0' AS threshold, 70.0::DOUBLE AS parameter_value, 'p70_0' AS reduction_levels, CASE WHEN count(DISTINCT label) > 1 THEN 'kept' ELSE 'invalid_split' END AS status, '' AS reason FROM s""")
def split_run(spark, d):
    return workflow.run_split(binary(spark, d), "hemolytic", "stratified_kfold", 7, "p70_0")[0]


@query("SELECT 'one_class' AS scenario, 'stratified_kfold' AS strategy, 7 AS seed, '' AS threshold, NULL::DOUBLE AS parameter_value, 'no_threshold' AS reduction_levels, 'invalid_split' AS status, 'input dataset has only one class(es)' AS reason, 0::BIGINT AS rows_left")
def split_run_invalid(spark, d):
    status, folds = workflow.run_split(binary(spark, d).withColumn("label", F.lit(1)), "one_class", "stratified_kfold", 7)
    return status.join(folds.agg(F.count("*").alias("rows_left")))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def repeated_keys(spark, d):
    return workflow.repeated_keys(table(spark, d, "lineitem"), "l_partkey")


@query("SELECT l_returnflag, p_size, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def many_to_one_join(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_returnflag")
    return workflow.checked_join(li, table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", "many_to_one", "inner").groupBy("l_returnflag", "p_size").agg(F.count("*").alias("n"))


@query("""WITH v AS (
  SELECT 'whole' AS name, vec_id, len(embedding) AS w FROM embeddings
  UNION ALL SELECT 'faulty', CASE WHEN vec_id % 41 = 1 THEN vec_id + 1000000 ELSE vec_id END, len(embedding) - (vec_id % 43 = 3)::INT FROM embeddings WHERE vec_id % 37 <> 0
  UNION ALL SELECT 'faulty', vec_id, len(embedding) FROM embeddings WHERE vec_id % 29 = 2
),
k AS (SELECT name, vec_id, count(*) AS n FROM v GROUP BY ALL), e AS (SELECT name, vec_id FROM embeddings, (SELECT unnest(['whole', 'faulty']) AS name)),
c AS (SELECT name, count(e.vec_id) AS n_sequences, coalesce(sum(n), 0)::BIGINT AS n_vectors, count(*) FILTER (n IS NULL) AS n_missing, count(*) FILTER (e.vec_id IS NULL) AS n_foreign, count(*) FILTER (n > 1) AS n_repeated FROM e FULL JOIN k USING (name, vec_id) GROUP BY name),
x AS (SELECT name, min(w)::INT AS least_width, max(w)::INT AS most_width FROM v GROUP BY name)
SELECT *, n_missing + n_foreign + n_repeated = 0 AND least_width = most_width AS ok FROM c JOIN x USING (name)""")  # fmt: skip
def vector_ingestion(spark, d):
    """A whole representation, and one that lacks sequences, has others, repeats some and cuts some short."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    i = F.col("vec_id")
    short = F.when(i % 43 == 3, F.slice("embedding", 1, F.size("embedding") - 1)).otherwise(F.col("embedding"))
    faulty = e.where(i % 37 != 0).select(F.when(i % 41 == 1, i + 1000000).otherwise(i).alias("vec_id"), short.alias("embedding")).unionAll(e.where(i % 29 == 2))
    told = lambda name, vectors: workflow.ingested(vectors, e.select("vec_id"), "vec_id", "embedding").select(F.lit(name).alias("name"), "*")
    return told("whole", e).unionAll(told("faulty", faulty))


@query("""WITH s AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s FROM part WHERE p_brand < 'Brand#3') SELECT p_partkey, round((p_size - m) / s, 9) AS p_size FROM part, s WHERE p_brand >= 'Brand#3'""")
def scale_held_out(spark, d):
    """Fitted on some brands, used on the others."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    fitted = similarity.fit_scale(p.where("p_brand < 'Brand#3'"), ["p_size"])
    return similarity.transform_scale(p.where("p_brand >= 'Brand#3'"), fitted).select("p_partkey", F.round("p_size", 9).alias("p_size"))


_yj = lambda x, p: f"CASE WHEN {x} >= 0 THEN CASE WHEN abs({p}) < 1e-9 THEN ln({x} + 1) ELSE (pow({x} + 1, {p}) - 1) / {p} END ELSE CASE WHEN abs({p} - 2) < 1e-9 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {p}) - 1) / (2 - {p}) END END"


@query(f"""WITH v AS (SELECT 'o_totalprice' AS name, o_totalprice::DOUBLE / 1000 AS x FROM orders UNION ALL SELECT 'balance', c_acctbal::DOUBLE / 1000 FROM customer),
  g AS (SELECT (i - 200) / 100.0::DOUBLE AS p FROM (SELECT unnest(range(601)) AS i)),
  l AS (SELECT name, p, -0.5 * ln(var_pop({_yj("x", "p")})) + (p - 1) * avg(sign(x) * ln(abs(x) + 1)) AS likelihood FROM v, g GROUP BY name, p)
  SELECT name, round(max(likelihood), 4) AS likelihood, round(arg_max(p, likelihood), 1) AS power FROM l GROUP BY name""")  # fmt: skip
def fitted_powers(spark, d):
    """The bracketed maximum against a grid of 601 powers: the likelihood by row, and the power to a tenth."""
    found = []
    for name, rows in (("o_totalprice", table(spark, d, "orders").select((F.col("o_totalprice").cast("double") / 1000).alias("x"))), ("balance", table(spark, d, "customer").select((F.col("c_acctbal").cast("double") / 1000).alias("x")))):
        power, _, deviation = similarity.fit_power(rows, ["x"])["x"]
        likelihood = -F.log(F.stddev_pop(similarity.yeo_johnson(F.col("x"), power))) + (power - 1) * F.avg(F.signum("x") * F.log1p(F.abs("x")))
        found.append(rows.agg(F.round(likelihood, 4).alias("likelihood")).select(F.lit(name).alias("name"), "likelihood", F.round(F.lit(power), 1).alias("power")))
    return found[0].unionByName(found[1])


@query("""WITH n AS (SELECT p_retailprice::DOUBLE AS x FROM part WHERE p_brand < 'Brand#3'),
  m AS (SELECT list_transform(range(101), lambda i: i / 100.0::DOUBLE) AS q), l AS (SELECT quantile_cont(x, [i / 100.0::DOUBLE FOR i IN range(101)]) AS marks FROM n),
  p AS (SELECT p_partkey, p_retailprice::DOUBLE AS x, marks, len(list_filter(marks, lambda v: v < p_retailprice::DOUBLE)) AS below, len(list_filter(marks, lambda v: v <= p_retailprice::DOUBLE)) AS under FROM part, l WHERE p_brand >= 'Brand#3')
  SELECT p_partkey, round(CASE WHEN below <> under THEN (below + under - 1) / 200.0::DOUBLE WHEN below = 0 THEN 0 WHEN below = 101 THEN 1 ELSE (below - 1 + (x - marks[below]) / (marks[below + 1] - marks[below])) / 100 END, 6) AS quantile FROM p""")  # fmt: skip
def quantile_held_out(spark, d):
    """Landmarks of some brands, used on the others."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").cast("double").alias("quantile"))
    marks = similarity.fit_quantile(p.where("p_brand < 'Brand#3'"), "quantile", 101)
    return similarity.transform_quantile(p.where("p_brand >= 'Brand#3'"), "quantile", marks).select("p_partkey", F.round("quantile", 6).alias("quantile"))


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, 0::BIGINT AS n_missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, median({c}) AS median, max({c}) AS max FROM lineitem" for c in _NUMERIC))
def column_report(spark, d):
    out = stats.describe_columns(table(spark, d, "lineitem"), _NUMERIC).drop("n_distinct")
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS pearson FROM lineitem" for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]))
def correlation_report(spark, d):
    return stats.correlations(table(spark, d, "lineitem"), _NUMERIC).withColumn("pearson", F.round("pearson", 6))


@query("""SELECT p_partkey AS descriptor, p_size - 25.0 AS diff_B_minus_A, p_size / 50.0 AS q_value, CASE WHEN p_size > 25 THEN '↑ in B' WHEN p_size < 25 THEN '↓ in B' ELSE '=' END AS direction, row_number() OVER (ORDER BY p_size / 50.0, p_partkey) AS place FROM part""")
def selected_order(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("descriptor"), (F.col("p_size") - F.lit(25.0)).alias("stat_observed"), (F.col("p_size") / F.lit(50.0)).alias("q_value"), F.lit(None).cast("double").alias("p_value"))
    told = stats.selected_directions(p).withColumn("i", F.monotonically_increasing_id())
    from pyspark.sql import Window

    # a report of descriptors, whose order is the result
    return told.select("descriptor", "diff_B_minus_A", "q_value", "direction", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("i")).cast("long").alias("place"))
