"""Families of duplicate handling. Rows without a key drop out, as null isn't a group here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_classes(df: DataFrame, keys: Sequence[str], label: str = "label", by_size: bool = False) -> DataFrame:
    """df with dup_class: `unique` (one label that isn't null, or one row with by_size), `consistent` (several, all equal) or `conflict`.

    Without by_size the labels that aren't null are counted, so a key with (1, null) is unique with both rows; among several,
    null is a label of its own. One shuffle on the keys.
    """
    w = Window.partitionBy(*keys)
    n = F.count("*" if by_size else label).over(w)
    distinct = F.size(F.collect_set(F.coalesce(F.col(label).cast("string"), F.lit("\0"))).over(w))
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.withColumn("dup_class", F.when(n == 1, "unique").when(distinct == 1, "consistent").otherwise("conflict"))


def resolve(df: DataFrame, keys: Sequence[str], label: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(collapsed, errors, unique): consistent keys as one row, conflicting keys, rows of unique keys."""
    classed = duplicate_classes(df, keys, label)
    collapsed = classed.where("dup_class = 'consistent'").groupBy(*keys).agg(F.max(label).alias(label))
    return collapsed, classed.where("dup_class = 'conflict'").select(*keys).distinct(), classed.where("dup_class = 'unique'").drop("dup_class")


def label_lists(df: DataFrame, keys: Sequence[str], label: str = "label", drop_null: bool = True) -> DataFrame:
    """One row for each key: n_duplicates and the sorted different labels, joined by "|"."""
    value = F.col(label).cast("string") if drop_null else F.coalesce(F.col(label).cast("string"), F.lit("null"))
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n_duplicates"), F.array_join(F.sort_array(F.collect_set(value)), "|").alias("labels"))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by order; keeps a partial aggregate before the shuffle, where a window would not."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def conflicting_keys(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Keys with more than one label, null counted as a label."""
    return df.groupBy(*keys).agg((F.count_distinct(label) + F.max(F.col(label).isNull().cast("int"))).alias("n_labels")).where("n_labels > 1")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on keys where null equals null."""
    r = right.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(r, on, how)
