"""Categories from source metadata: exploded task lists, annotation matrices, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import MISSING
from ..functions.names import meaningful_targets, source_key


def source_categories(meta: DataFrame, endpoints: Sequence[str], name: str = "name_source", task: str = "task", category: str = "category") -> DataFrame:
    """(source_key, endpoint, categories) from rows with a comma- or semicolon-separated task list."""
    each = meta.select(source_key(F.col(name)).alias("source_key"), F.explode(F.split(task, "[;,]")).alias("endpoint"), category)
    each = each.withColumn("endpoint", F.lower(F.trim("endpoint"))).where(F.col("endpoint").isin(*endpoints) & F.col(category).isNotNull())
    return each.groupBy("source_key", "endpoint").agg(F.array_sort(F.collect_set(category)).alias("categories"))


def source_targets(meta: DataFrame, name: str = "name_source", targets: str = "targets") -> DataFrame:
    """(source_key, targets) with the sorted different targets of all rows of a source."""
    each = meta.select(source_key(F.col(name)).alias("source_key"), F.explode_outer(meaningful_targets(F.col(targets))).alias("t"))
    return each.groupBy("source_key").agg(F.array_sort(F.collect_set("t")).alias("targets"))


def target_matrix(votes: DataFrame, meta: DataFrame, categories: Sequence[str], label: int = 1) -> DataFrame:
    """One row for each sequence with a category, 1 where a source that voted `label` has the category and 999 elsewhere.

    (sequence, source) pairs are made different before the join, which keeps its fan-out to categories.
    """
    pairs = votes.where(F.col("label") == label).select("sequence", source_key(F.col("source")).alias("source_key")).distinct()
    known = pairs.join(meta.select(source_key(F.col("name_source")).alias("source_key"), "category").distinct(), "source_key").where(F.col("category").isNotNull())
    return known.groupBy("sequence").pivot("category", list(categories)).agg(F.lit(1)).fillna(MISSING, subset=list(categories))


def matrix_sets(matrix: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A 1/999 matrix as (key, categories)."""
    return matrix.unpivot([key], list(columns), "category", "v").where("v = 1").groupBy(key).agg(F.array_sort(F.collect_set("category")).alias("categories"))


def task_filter(meta: DataFrame, word: str, task: str = "task") -> DataFrame:
    """Rows whose task holds the word, without case, as a substring: "toxic" also finds cytotoxic."""
    return meta.where(F.lower(task).contains(word.lower()))


def lookup(votes: DataFrame, dim: DataFrame) -> DataFrame:
    """votes with the categories of (source, endpoint); empty where the dimension has none. The planner broadcasts the dimension if it is small."""
    out = votes.withColumn("source_key", source_key(F.col("source"))).join(dim, ["source_key", "endpoint"], "left")
    return out.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
