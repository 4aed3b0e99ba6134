"""The split workflow: reduction levels, datasets, runs with a status, clean folds; checks of joins; ingestion of vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import splits

# How folders of reduction levels begin, and the files that hold a reduced dataset, the best first.
LEVELS = ("p", "threshold_", "minseqid_")
REDUCED = {"reduced_distance": ("data_nr_labeled.csv", "data_nr.csv"), "reduced_descriptor": ("data_nr_labeled.csv", "data_nr.csv"), "reduced_homology": ("data_nr_labeled.csv", "data_nr_mmseqs2.csv", "data_nr.csv")}


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def reduction_levels(spark: SparkSession, root: str, wanted: Sequence[str] | str | None = "auto") -> list[str]:
    """The level folders under root in order of name (`auto`), or those that are wanted; none for None."""
    if wanted is None:
        return []
    if wanted != "auto":
        return [str(w) for w in wanted]
    store, path = _folder(spark, root)
    if not store.exists(path):
        raise ValueError(f"no such folder: {root}")
    return sorted(s.getPath().getName() for s in store.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith(LEVELS))


def reduced_file(spark: SparkSession, root: str, level: str, kind: str) -> str:
    """The file of a reduced dataset: the first of its kind that is there, else the first that should be."""
    places = [f"{root}/{level}/{name}" for name in REDUCED[kind]]
    for place in places:
        store, path = _folder(spark, place)
        if store.exists(path):
            return place
    return places[0]


def level_value(level: Column) -> Column:
    """The number in a level's name (p70_0: 70, threshold_0.4 and minseqid_0.4: 0.4), null without one."""
    digits = F.regexp_extract(level, r"(?:p|threshold_|minseqid_)([0-9]+(?:[._][0-9]+)?)$", 1)
    return F.try_to_number(F.replace(digits, F.lit("_"), F.lit(".")), F.lit("999999.999999")).cast("double")


def unique_scenarios(registry: DataFrame, by: Sequence[str] = ("scenario", "seed")) -> DataFrame:
    """(by, n) of scenarios that occur more than once: none may."""
    return registry.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def basic_dataset(df: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """(id, label), for each id the first label in the order, nulls left out; and (label, n), their distribution."""
    first = df.where("id is not null and label is not null").groupBy("id").agg(F.min_by("label", order).alias("label"))
    return first, first.groupBy("label").agg(F.count("*").alias("n"))


def left_in_order(left: DataFrame, right: DataFrame, on: str, place: str = "place") -> DataFrame:
    """left joined to right with left's order kept as a column: place counts from 1 without gaps after an inner join.

    left has the order in `place` already (a number that rises); ranks are taken in ranges of it whose counts are summed up.
    """
    joined = left.join(right, on)
    n = joined.select(F.floor(F.col(place) / 65536).alias("__part"), "*")
    counts = n.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("__part").alias("__of"), before.alias("__before"))
    ranked = n.withColumn("__nth", F.row_number().over(Window.partitionBy("__part").orderBy(place)))
    out = ranked.join(counts, F.col("__part") == F.col("__of"))
    return out.withColumn(place, (F.col("__before") + F.col("__nth")).cast("long")).drop("__part", "__of", "__before", "__nth")


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, on: str, validate: str, how: str = "left") -> DataFrame:
    """A join that is `many_to_one`, `one_to_many` or `one_to_one`; a repeated key on a side that must be unique is an error."""
    for side, df, must in (("right", right, validate.endswith("_to_one")), ("left", left, validate.startswith("one_to_"))):
        if must and (bad := repeated_keys(df.where(F.col(on).isNotNull()), on).first()):
            raise ValueError(f"{validate}: {on} {bad[0]!r} occurs {bad[1]} times on the {side} side")
    return left.join(right, on, how)


def distance_dataset(split: DataFrame, representation: DataFrame) -> DataFrame:
    """The rows of split (id, label, place) that have a vector, in its order and with its labels, whatever the representation says."""
    return left_in_order(split, representation.drop("label", "place"), "id")


def compact(assigned: DataFrame, expected: DataFrame) -> DataFrame:
    """(fold, part, n, null_ids, null_labels, ok): whether every fold can be kept as (id, label): nothing null, and all of the expected rows (n) in each fold."""
    parts = assigned.groupBy("fold", "part").agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("null_ids"), F.count_if(F.col("label").isNull()).alias("null_labels"))
    whole = F.sum("n").over(Window.partitionBy("fold"))
    total = expected.agg(F.count("*").alias("__total"))
    return parts.withColumn("__whole", whole).join(total).withColumn("ok", (F.col("null_ids") == 0) & (F.col("null_labels") == 0) & (F.col("__whole") == F.col("__total"))).drop("__whole", "__total")


def clean_reason(reason: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), r"\s+", " "))


def run_split(df: DataFrame, scenario: str, strategy: str, seed: int, level: str = "", k: int = 5) -> tuple[DataFrame, DataFrame]:
    """A run's status row, and its folds (fold, part, id, label), empty unless it is kept.

    The input is checked first, then every part of every fold; one that fails makes the run `invalid_split` with the reason, and no fold of it is left.
    """
    stratified = strategy == "stratified_kfold"
    before = splits.precheck(df, k, stratified)
    assigned = splits.assignments(splits.kfold(df, k, seed, stratified), k)
    bad = splits.validate(assigned).where("not ok").agg(F.min(F.struct("fold", "part")).alias("x"))
    after = bad.select(F.when(F.col("x").isNotNull(), F.concat(F.lit("fold "), F.col("x.fold").cast("string"), F.lit(": "), F.col("x.part"), F.lit(" has no rows or fewer than two classes"))).alias("late"))
    said = before.join(after).select(clean_reason(F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.col("late"))).alias("reason"))
    status = said.select(
        F.lit(scenario).alias("scenario"), F.lit(strategy).alias("strategy"), F.lit(int(seed)).alias("seed"), F.lit(level).alias("threshold"), level_value(F.lit(level)).alias("parameter_value"),
        F.lit(level or "no_threshold").alias("reduction_levels"), F.when(F.col("reason") == "", "kept").otherwise("invalid_split").alias("status"), "reason",
    )
    return status, assigned.join(status.where("status = 'kept'").select(F.lit(1).alias("__kept"))).drop("__kept")


def status_table(status: DataFrame) -> DataFrame:
    """Status rows in the order of a report: no level first, then by its number and name."""
    return status.orderBy("scenario", "strategy", "seed", F.coalesce("parameter_value", F.lit(-1.0)), "reduction_levels")


def ingested(vectors: DataFrame, sequences: DataFrame, key: str = "id", vector: str = "vector") -> DataFrame:
    """(n_sequences, n_vectors, n_missing, n_foreign, n_repeated, n_widths, ok): whether given vectors are a representation of the sequences.

    Models that make vectors are outside; a representation is taken if each sequence has one vector and all have one width.
    """
    v = vectors.groupBy(key).agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi"))
    both = sequences.select(key).distinct().withColumn("__s", F.lit(1)).join(v, key, "full")
    one = both.agg(F.count("__s").alias("n_sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_vectors"), F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("__s").isNull()).alias("n_foreign"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    one = one.withColumn("ok", F.coalesce((F.col("n_missing") + F.col("n_foreign") + F.col("n_repeated") == 0) & (F.col("lo") == F.col("hi")), F.lit(False)))
    return one.select("n_sequences", "n_vectors", "n_missing", "n_foreign", "n_repeated", F.col("lo").alias("least_width"), F.col("hi").alias("most_width"), "ok")


def represented_again(spark: SparkSession, path: str, make, sequences: DataFrame, reuse: bool = True, **names) -> DataFrame:
    """The representation at path if it is there, may be reused and fits the sequences, else what make() gives, checked and written there."""
    store, p = _folder(spark, path)
    if reuse and store.exists(p):
        old = spark.read.parquet(path)
        if ingested(old, sequences, **names).first()["ok"]:
            return old
    new = make()
    told = ingested(new, sequences, **names).first()
    if not told["ok"]:
        raise ValueError(f"not a representation of the sequences: {told.asDict()}")
    new.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
