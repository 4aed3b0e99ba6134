"""Split datasets: validation, folds by seeded hashes, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import groups


def source_checks(df: DataFrame) -> DataFrame:
    """(n_rows, null_ids, null_labels, conflicting_ids, n_classes) of (id, label) in one job."""
    per_id = df.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("label").isNull()).alias("nulls"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return per_id.agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("null_ids"), F.sum("nulls").alias("null_labels"), F.count_if(F.col("id").isNotNull() & (F.col("lo") != F.col("hi"))).alias("conflicting_ids"))


def precheck(df: DataFrame, k: int, stratified: bool) -> DataFrame:
    """(ok, reason) for a split input."""
    s = df.groupBy("label").agg(F.count("*").alias("n")).agg(F.count("label").alias("classes"), F.sum("n").alias("n_rows"), F.min("n").alias("smallest"))
    reason = F.when(F.coalesce("n_rows", F.lit(0)) < k, f"input dataset has fewer rows than n_splits {k}").when(F.col("classes") < 2, "input dataset has only one class(es)")
    if stratified:
        reason = reason.when(F.col("smallest") < k, f"some classes have fewer samples than n_splits {k}")
    return s.select(reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def draw(key: Column, seed: Column | int) -> Column:
    """A hexadecimal rank of a key under a seed: the MD5 of "seed:key"."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), key.cast("string")))


def kfold(df: DataFrame, k: int = 5, seed: int = 0, stratified: bool = False, val_share: float = 0.1, parts: int = 256) -> DataFrame:
    """(id, label, fold, part, in_val): disjoint folds that cover all rows and differ by one row at most, in each class if stratified.

    fold is where the row is tested; in_val tells whether it validates in the fold after that. Rows are ranked by a seeded hash of id, within
    `parts` of its range whose counts are summed up, so no task ranks all rows.
    """
    by = ["label"] if stratified else []
    ranked = df.withColumn("__h", draw(F.col("id"), seed)).withColumn("part", (F.conv(F.substring("__h", 1, 4), 16, 10).cast("int") * F.lit(parts) / 65536).cast("int"))
    counts = ranked.groupBy(*by, "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(b).alias(f"__{b}") for b in by), F.col("part").alias("__part"), before.alias("__before"))
    nth = F.row_number().over(Window.partitionBy(*by, "part").orderBy("__h", "id"))
    on = (F.col("part") == F.col("__part")) if not by else (F.col("part") == F.col("__part")) & F.col("label").eqNullSafe(F.col("__label"))
    out = ranked.withColumn("__nth", nth).join(counts, on).withColumn("rank", F.col("__before") + F.col("__nth") - 1)
    fold = (F.col("rank") % k).cast("int")
    chosen = F.conv(F.substring(draw(F.col("id"), f"val{seed}"), 1, 8), 16, 10).cast("double") / float(1 << 32) < val_share
    return out.select("id", "label", fold.alias("fold"), chosen.alias("in_val"))


def assignments(folds: DataFrame, k: int = 5) -> DataFrame:
    """(fold, part, id, label): each row once in every fold, as test, validation or training."""
    each = folds.withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    part = F.when(F.col("of") == F.col("fold"), "test").when(F.col("in_val"), "val").otherwise("train")
    return each.select(F.col("of").cast("int").alias("fold"), part.alias("part"), "id", "label")


def validate(assigned: DataFrame) -> DataFrame:
    """Rows and classes of every fold and part, and whether they suffice."""
    out = assigned.groupBy("fold", "part").agg(F.count("*").alias("n"), F.count_distinct("label").alias("classes"), F.count_if(F.col("label").isNull()).alias("null_labels"))
    return out.withColumn("ok", (F.col("n") > 0) & (F.col("classes") >= 2) & (F.col("null_labels") == 0))


def partition_summary(assigned: DataFrame) -> DataFrame:
    out = assigned.groupBy("fold", "part").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("negative"), F.count_if(F.col("label") == 1).alias("positive"))
    return out.withColumn("positive_fraction", F.col("positive") / F.col("n"))


def status_summary(status: DataFrame, by: Sequence[str]) -> DataFrame:
    """Kept and invalid runs with rates and the sorted different seeds of the kept."""
    kept = F.col("status") == "kept"
    out = status.groupBy(*by).agg(F.count("*").alias("n_runs"), F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_invalid"), F.array_join(F.transform(F.sort_array(F.collect_set(F.when(kept, F.col("seed")))), lambda s: s.cast("string")), ",").alias("kept_seeds"))
    return out.withColumns({"kept_rate": F.col("n_kept") / F.col("n_runs"), "invalid_rate": F.col("n_invalid") / F.col("n_runs")})


def heatmap(status: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return status.withColumn("__k", (F.col("status") == "kept").cast("double")).groupBy(row).pivot(column, list(values)).agg(F.avg("__k"))


def registry(spark, datasets: Sequence[str], strategies: Sequence[str], seeds: Sequence[int], levels: Sequence[str]) -> DataFrame:
    """Every (dataset, strategy, level, seed) as rows, from configuration lists."""
    base = spark.range(1).select(F.explode(F.array(*(F.lit(d) for d in datasets))).alias("dataset"))
    for name, values in (("strategy", strategies), ("level", levels), ("seed", seeds)):
        base = base.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return base.withColumn("scenario", F.concat_ws("__", "dataset", "level", "strategy"))


def packed(kinds: Sequence[tuple[int, object, int]], k: int) -> list[list[int]]:
    """For each kind (size, class, how many groups are so) how many of them each of k folds takes: largest first, into folds that are not fuller than
    the emptiest by more than one largest group, among those the one with the least of the class. Groups of a kind beyond a few are dealt level by level at once.
    """
    largest = max((size for size, _, _ in kinds), default=0)
    full, of_class = [0] * k, {}
    out = [[0] * k for _ in kinds]
    for at in sorted(range(len(kinds)), key=lambda i: (-kinds[i][0], str(kinds[i][1]))):
        size, label, left = kinds[at]
        held = of_class.setdefault(label, [0] * k)
        low, high = min(full), min(full) + size * left
        while high - low > 1:  # the level up to which whole groups fill the folds, with some left
            level = (low + high) // 2
            low, high = (level, high) if sum(max(0, (level - f) // size) for f in full) <= left else (low, level)
        for fold in range(k):
            n = min(left, max(0, (low - full[fold]) // size))
            out[at][fold], full[fold], held[fold], left = n, full[fold] + n * size, held[fold] + n * size, left - n
        for _ in range(left):
            room = min(full) + largest - size
            fold = min((f for f in range(k) if full[f] <= room), key=lambda f: (held[f], full[f], f))
            out[at][fold] += 1
            full[fold] += size
            held[fold] += size
    return out


def distance_folds(df: DataFrame, vector: str, most: float, k: int = 5, seed: int = 0, metric: str = "cosine", key: str = "id", label: str = "label", val_share: float = 0.1, parts: int = 256) -> DataFrame:
    """(key, label, group, fold, in_val): no two rows within `most` of one another are in different folds, nor apart in validation.

    Chains of near rows are groups (groups.near_groups). Groups are packed by size and by the class that most of their rows have (ties: the least), so folds differ by the largest group's rows at most;
    which groups of one size and class go where is drawn by a seeded hash. The driver sees a row for each size and class, some square root of the rows.
    Rows with null vectors are groups of their own, null keys one group together; every row is in one fold.
    """
    rows = materialize(groups.near_groups(df.select(key, label, vector), key, vector, most, metric).select(key, label, "group"), "grouped")
    by_label = rows.groupBy("group", label).agg(F.count("*").alias("n"))
    sized = by_label.groupBy("group").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), F.col(label).cast("string").alias("label"))).alias("most"))
    h = draw(F.coalesce(F.col("group").cast("string"), F.lit("")), seed)
    part = (F.conv(F.substring(h, 1, 4), 16, 10).cast("int") * F.lit(parts) / 65536).cast("int")
    sized = materialize(sized.select("group", "size", F.coalesce("most.label", F.lit("")).alias("class"), h.alias("h"), part.alias("part")), "sizes")
    counts = sized.groupBy("size", "class", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size", "class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kinds = [(r["size"], r["class"], r["n"]) for r in counts.groupBy("size", "class").agg(F.sum("n").alias("n")).collect()]
    ends = [(size, name, [sum(taken[: i + 1]) for i in range(k)]) for (size, name, _), taken in zip(kinds, packed(kinds, k), strict=True)]
    quota = df.sparkSession.createDataFrame(ends, "size long, class string, ends array<long>")
    nth = F.row_number().over(Window.partitionBy("size", "class", "part").orderBy("h", "group")) - 1
    ranked = sized.withColumn("nth", nth).join(counts.select("size", "class", "part", before.alias("before")), ["size", "class", "part"]).join(quota, ["size", "class"])
    rank = F.col("before") + F.col("nth")
    chosen = F.conv(F.substring(draw(F.coalesce(F.col("group").cast("string"), F.lit("")), f"val{seed}"), 1, 8), 16, 10).cast("double") / float(1 << 32) < val_share
    folds = ranked.select(F.col("group").alias("__g"), F.size(F.filter("ends", lambda e: e <= rank)).alias("fold"), chosen.alias("in_val"))
    return rows.join(folds, F.col("group").eqNullSafe(F.col("__g"))).drop("__g")
