"""Votes to direct evidence: everything is counted in long form, in one shuffle on (sequence, endpoint)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ENDPOINTS, MISSING
from ..functions.sequences import normalize_sequence, qc_reason


def passing(df: DataFrame, raw: str = "raw_sequence") -> DataFrame:
    """df with the normalised sequence, without rows that fail quality control.

    A filter on the normalised column would be pushed below it and evaluate it once for each check; the generator does so once.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != "sequence"]
    return df.select(F.explode(F.filter(F.array(normalize_sequence(F.col(raw))), lambda s: qc_reason(s) == "pass")).alias("sequence"), *rest)


def clean_votes(votes: DataFrame) -> DataFrame:
    """(sequence, endpoint, source, label) of (raw_sequence, ..) rows that pass quality control, by votes 0, 1 and 2."""
    return passing(votes).select("sequence", "endpoint", "source", "label")


def source_status(labels: Column) -> Column:
    """State of a source by its sorted different labels."""
    is_ = lambda *x: labels == F.array(*(F.lit(v) for v in x))
    return F.when(is_(1), "positive").when(is_(0), "negative").when(is_(2), "unlabeled").when(F.size(labels) == 0, "no_information").otherwise("conflicting")


def resolve_sources(votes: DataFrame) -> DataFrame:
    """(sequence, endpoint, source, observed_labels, source_status)."""
    valid = F.when(F.col("label").isin(0, 1, 2), F.col("label"))
    out = votes.groupBy("sequence", "endpoint", "source").agg(F.sort_array(F.collect_set(valid)).alias("observed_labels"))
    return out.withColumn("source_status", source_status(F.col("observed_labels")))


def status_counts(resolved: DataFrame) -> DataFrame:
    """Sources of each state for every (sequence, endpoint)."""
    count = lambda s: F.count_if(F.col("source_status") == s)
    return resolved.groupBy("sequence", "endpoint").agg(
        count("positive").alias("n_positive_sources"), count("negative").alias("n_negative_sources"), count("unlabeled").alias("n_unlabeled_sources"), count("conflicting").alias("n_conflicting_sources")
    )


def row_membership(rows: DataFrame) -> DataFrame:
    """(sequence, endpoint) with the states of its rows: any ambiguous or several different is ambiguous, then positive, negative, unlabeled."""
    has = lambda s: F.max(F.col("row_status") == s)
    out = rows.groupBy("sequence", "endpoint").agg(*(F.coalesce(has(s), F.lit(False)).alias(f"has_{s}") for s in ("ambiguous", "positive", "negative", "unlabeled")))
    many = sum((F.col(f"has_{s}").cast("int") for s in ("ambiguous", "positive", "negative", "unlabeled")), F.lit(0)) > 1
    status = F.when(F.col("has_ambiguous") | many, "ambiguous").when(F.col("has_positive"), "positive").when(F.col("has_negative"), "negative").when(F.col("has_unlabeled"), "unlabeled").otherwise("no_information")
    return out.withColumn("membership_conflict", many).withColumn("membership_status", status)


def reported_support(rows: DataFrame) -> DataFrame:
    """Largest fraction, first category that isn't null by pos, sorted different files, any mismatch of declared and inferred state."""
    keys, told = ["sequence", "endpoint"], F.col("category").isNotNull()
    slim = rows.select(*keys, "fraction", "category", F.when(told, F.col("pos")).alias("pos"), "input_file", (F.col("row_status") != F.col("declared_status")).alias("differs"))
    # few rows share a key, so combining before the shuffle would sort every row a second time and save little: rows are dealt out first
    return slim.repartition(*keys).groupBy(*keys).agg(
        F.max("fraction").alias("positive_fraction_reported"),
        F.min_by("category", "pos").alias("support_category"),
        F.array_join(F.sort_array(F.collect_set("input_file")), "|").alias("input_files"),
        F.coalesce(F.max("differs"), F.lit(False)).alias("status_file_mismatch"),
    )


def direct_evidence(counts: DataFrame, membership: DataFrame | None = None, support: DataFrame | None = None) -> DataFrame:
    """State and positive fraction of every (sequence, endpoint) that has any evidence.

    Without membership the state comes from the sources: positive, negative, unlabeled in this order. Ambiguity overwrites it: an ambiguous
    or conflicting membership, sources on both sides, or a source in conflict with itself.
    """
    keys = ["sequence", "endpoint"]
    out = counts
    for extra in (membership, support):
        if extra is not None:
            out = out.join(extra, keys, "full" if extra is membership else "left")
    zero = {c: 0 for c in ("n_positive_sources", "n_negative_sources", "n_unlabeled_sources", "n_conflicting_sources")}
    out = out.fillna(zero)
    share = F.try_divide(F.col("n_positive_sources").cast("double"), F.col("n_positive_sources") + F.col("n_negative_sources"))
    fraction = F.coalesce(share, F.col("positive_fraction_reported")) if support is not None else share
    both = ((F.col("n_positive_sources") > 0) & (F.col("n_negative_sources") > 0)) | (F.col("n_conflicting_sources") > 0)
    by_source = F.when(F.col("n_positive_sources") > 0, "positive").when(F.col("n_negative_sources") > 0, "negative").when(F.col("n_unlabeled_sources") > 0, "unlabeled").otherwise("no_information")
    if membership is None:
        ambiguous, state = both, by_source
    else:
        ambiguous = both | F.coalesce(F.col("membership_status") == "ambiguous", F.lit(False))
        state = F.coalesce(F.col("membership_status"), by_source)
    return out.withColumn("positive_fraction", fraction).withColumn("is_ambiguous", ambiguous).withColumn("status_before_hierarchy", F.when(ambiguous, "ambiguous").otherwise(state))


def complete_grid(direct: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    """Every sequence at every endpoint: an explode of eight constants for each sequence, then a left join on keys that are already grouped."""
    grid = direct.select("sequence").distinct().select("sequence", F.explode(F.array(*(F.lit(e) for e in endpoints))).alias("endpoint"))
    return grid.join(direct, ["sequence", "endpoint"], "left").withColumn("has_direct_evidence", F.col("status_before_hierarchy").isNotNull() & (F.col("status_before_hierarchy") != "no_information")).fillna({"status_before_hierarchy": "no_information", "is_ambiguous": False})


def vote_matrix(votes: DataFrame, sources: Sequence[str], pos: str = "pos") -> DataFrame:
    """One row for each sequence, one column for each source with its first vote by pos; 999 where the source lacks the sequence. One shuffle, not a join for each source."""
    return votes.groupBy("sequence").pivot("source", list(sources)).agg(F.min_by("label", pos)).fillna(MISSING, subset=list(sources))


def label_votes(matrix: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Counts of each vote over the source columns, flags and percentages (0 without votes)."""
    n = lambda v: sum((F.coalesce((F.col(f"`{s}`") == v).cast("int"), F.lit(0)) for s in sources), F.lit(0))
    out = matrix.withColumns({"counts_1": n(1), "counts_0": n(0), "counts_unlabel": n(2), "counts_unknown": n(MISSING)})
    votes = F.col("counts_1") + F.col("counts_0")
    return out.withColumns(
        {
            "positive": (F.col("counts_1") > 0) & (F.col("counts_0") == 0),
            "negative": (F.col("counts_0") > 0) & (F.col("counts_1") == 0),
            "exclusive_1": (F.col("counts_1") > 0) & (F.col("counts_0") == 0) & (F.col("counts_unlabel") == 0),
            "exclusive_0": (F.col("counts_0") > 0) & (F.col("counts_1") == 0) & (F.col("counts_unlabel") == 0),
            "only_unlabel": (F.col("counts_unlabel") > 0) & (votes == 0),
            "percentage_1": F.coalesce(F.try_divide(F.col("counts_1") * 100.0, votes), F.lit(0.0)),
            "percentage_0": F.coalesce(F.try_divide(F.col("counts_0") * 100.0, votes), F.lit(0.0)),
        }
    )


def source_columns(df: DataFrame, auxiliary: Sequence[str]) -> list[str]:
    """Columns that hold votes only: not auxiliary, at least one number, all numbers among 0, 1, 2 and 999. One aggregate over all candidates."""
    candidates = [c for c in df.columns if c not in auxiliary]
    if not candidates:
        return []
    v = lambda c: F.col(f"`{c}`").cast("string").try_cast("double")
    row = df.agg(*(F.count(v(c)).alias(f"n{i}") for i, c in enumerate(candidates)), *(F.coalesce(F.min(v(c).isin(0.0, 1.0, 2.0, 999.0)), F.lit(False)).alias(f"ok{i}") for i, c in enumerate(candidates))).first()
    return [c for i, c in enumerate(candidates) if row[f"n{i}"] and row[f"ok{i}"]]
