"""Summaries, audits and checks over states and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ENDPOINTS, MISSING, STATE_CODES, SUPPORT_ENDPOINTS, decode_state, support_bin
from ..functions.sequences import is_sequence_id, sequence_id


def unpivot_codes(pivot: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    return pivot.unpivot([c for c in pivot.columns if c not in endpoints], list(endpoints), "endpoint", "code")


def ambiguous_support(states: DataFrame, direct: DataFrame, endpoints: Sequence[str] = SUPPORT_ENDPOINTS) -> DataFrame:
    """Sequences ambiguous in at least one of the endpoints: the bin of the positive fraction for each that is, else 999."""
    amb = states.where(F.col("is_ambiguous") & F.col("endpoint").isin(*endpoints)).select("sequence", "endpoint")
    amb = amb.join(direct.select("sequence", "endpoint", support_bin(F.col("positive_fraction")).alias("bin")), ["sequence", "endpoint"], "left")
    out = amb.groupBy("sequence").pivot("endpoint", list(endpoints)).agg(F.max("bin")).fillna(str(MISSING), subset=list(endpoints))
    return out.select(sequence_id(F.col("sequence")).alias("id"), "sequence", *endpoints)


def endpoint_summary(states: DataFrame, five: bool = False) -> DataFrame:
    names = ["positive", "negative", "ambiguous", "unlabeled"] + ["no_information"] * five
    return states.groupBy("endpoint").agg(*(F.count_if(F.col("status") == s).alias(s) for s in names))


def processing_audit(states: DataFrame) -> DataFrame:
    n = lambda c, a: F.count_if(c).alias(a)
    return states.groupBy("endpoint").agg(
        F.count("*").alias("n_rows"),
        n(F.col("has_direct_evidence"), "n_direct"),
        n(F.col("has_hierarchical_positive_evidence"), "n_hierarchical"),
        n(F.col("is_hierarchy_inferred"), "n_inferred"),
        n(F.col("hierarchy_blocked_by_ambiguity"), "n_blocked"),
        n(F.col("has_hierarchical_conflict"), "n_conflict"),
        n(F.col("is_ambiguous"), "n_ambiguous"),
        *(n(F.col("status") == s, f"n_{s}") for s in ("positive", "negative", "unlabeled", "no_information")),
    )


def hierarchy_statistics(audit: DataFrame) -> DataFrame:
    """Totals and per-endpoint sums in one pass: rollup."""
    s = lambda c: F.sum(F.col(c).cast("long")).alias(f"n_{c}")
    out = audit.rollup("endpoint").agg(F.count("*").alias("n_rows"), s("is_hierarchy_inferred"), s("hierarchy_blocked_by_ambiguity"), s("has_hierarchical_conflict"), s("is_ambiguous"))
    return out.withColumn("endpoint", F.coalesce("endpoint", F.lit("ALL")))


def support_summary(support: DataFrame, endpoints: Sequence[str] = SUPPORT_ENDPOINTS) -> DataFrame:
    return support.unpivot(["id"], list(endpoints), "endpoint", "bin").where(F.col("bin") != str(MISSING)).groupBy("endpoint", "bin").agg(F.count("*").alias("n"))


def state_counts(pivot: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    """endpoint, state, count, fraction; only states that occur."""
    total = pivot.count()
    out = unpivot_codes(pivot.select(*endpoints), endpoints).groupBy("endpoint", "code").agg(F.count("*").alias("n"))
    return out.select("endpoint", decode_state(F.col("code")).alias("state"), "n", (F.col("n") / F.lit(total)).alias("fraction"))


def binary_reuse(pivot: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    total = F.count("*")
    out = unpivot_codes(pivot.select(*endpoints), endpoints).groupBy("endpoint").agg(F.count_if(F.col("code") == 0).alias("negative"), F.count_if(F.col("code") == 1).alias("positive"), total.alias("n"))
    both = F.col("negative") + F.col("positive")
    return out.select("endpoint", "negative", "positive", (both / F.col("n")).alias("coverage"), F.try_divide(F.col("positive").cast("double"), both).alias("positive_fraction"))


def cooccurrence(pivot: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    """For every pair of endpoints, how many rows are positive in both, in either and in the first, and Jaccard. One aggregate of a constant number of sums."""
    pairs = [(a, b) for a in endpoints for b in endpoints]
    on = {e: F.coalesce(F.col(e) == 1, F.lit(False)) for e in endpoints}
    sums = pivot.agg(*(F.count_if(on[a] & on[b]).alias(f"b{i}") for i, (a, b) in enumerate(pairs)), *(F.count_if(on[a] | on[b]).alias(f"e{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"b{i}").alias("n_both"), F.col(f"e{i}").alias("n_either"), F.col(f"b{pairs.index((a, a))}").alias("n_own")) for i, (a, b) in enumerate(pairs)))
    out = sums.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("jaccard", F.coalesce(F.try_divide(F.col("n_both").cast("double"), F.col("n_either")), F.lit(0.0)))


def overlap_percent(pairs: DataFrame) -> DataFrame:
    """Co-occurrence over the row's own positives, as a percentage."""
    return pairs.select("a", "b", F.coalesce(F.try_divide(F.col("n_both") * 100.0, F.col("n_own")), F.lit(0.0)).alias("percent"))


def burden(pivot: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    n = sum(((F.col(e) == 1).cast("int") for e in endpoints), F.lit(0))
    out = pivot.groupBy(n.alias("n_positive")).agg(F.count("*").alias("n"))
    total = pivot.count()
    return out.withColumn("fraction", F.col("n") / F.lit(total))


def top_level_combinations(pivot: DataFrame) -> DataFrame:
    """Counts of the four top-level flags together. Cytotoxic takes hemolytic and cytolysis in, not anti-mammalian cells."""
    on = lambda *cs: F.greatest(*((F.col(c) == 1) for c in cs)) if len(cs) > 1 else F.col(cs[0]) == 1
    flags = {"cytotoxic": on("cytotoxic", "hemolytic", "cytolysis"), "neurotoxic": on("neurotoxic"), "embryotoxic": on("embryotoxic"), "ichthyotoxic": on("ichthyotoxic")}
    out = pivot.groupBy(*(f.alias(f"is_{n}") for n, f in flags.items())).agg(F.count("*").alias("n"))
    return out.withColumn("degree", sum((F.col(f"is_{n}").cast("int") for n in flags), F.lit(0)))


def composition(pivot: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    """Shares in percent of the known states in each endpoint."""
    known = unpivot_codes(pivot.select(*endpoints), endpoints).where(F.col("code") != MISSING)
    out = known.groupBy("endpoint").agg(*(F.count_if(F.col("code") == c).alias(f"n_{s}") for s, c in STATE_CODES.items() if c != MISSING), F.count("*").alias("n"))
    return out.select("endpoint", *(F.try_divide(F.col(f"n_{s}") * 100.0, F.col("n")).alias(f"{s}_percent") for s, c in STATE_CODES.items() if c != MISSING))


def sequence_statistics(pivot: DataFrame) -> DataFrame:
    n = F.char_length("sequence")
    return pivot.agg(F.count_distinct("sequence").alias("n_unique"), F.min(n).cast("long").alias("min_length"), F.max(n).cast("long").alias("max_length"), F.avg(n).alias("mean_length"), F.median(n).alias("median_length"))


def assertions(pivot: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    """(check_name, passed, detail) from one aggregate over the pivot."""
    valid = F.lit(True)
    for e in endpoints:
        valid = valid & F.coalesce(F.col(e).isin(*STATE_CODES.values()), F.lit(False))
    known = F.greatest(*(F.col(e) != MISSING for e in endpoints))
    sums = pivot.agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("sequence").alias("sequences"), F.count_if(is_sequence_id(F.col("id"))).alias("well_formed"),
        F.count_if(F.col("id") == sequence_id(F.col("sequence"))).alias("derived"), F.count_if(valid).alias("valid"), F.count_if(known).alias("informed"), F.count_if(F.col("sequence").isNull()).alias("missing"),
    )
    checks = [("ids_unique", F.col("ids")), ("sequences_unique", F.col("sequences")), ("ids_well_formed", F.col("well_formed")), ("ids_derived_from_sequence", F.col("derived")), ("codes_valid", F.col("valid")), ("rows_informed", F.col("informed")), ("no_missing_sequence", F.col("n") - F.col("missing"))]
    rows = F.array(*(F.struct(F.lit(name).alias("check_name"), (v == F.col("n")).alias("passed"), F.concat_ws("/", v.cast("string"), F.col("n").cast("string")).alias("detail")) for name, v in checks))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def rule_changes(before: DataFrame, after: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    """(endpoint, code_before, code_after, n) of the cells that differ; a full join on sequence, null-safe."""
    b = unpivot_codes(before.select("sequence", *endpoints), endpoints).withColumnRenamed("code", "code_before")
    a = unpivot_codes(after.select("sequence", *endpoints), endpoints).withColumnRenamed("code", "code_after")
    both = b.join(a, ["sequence", "endpoint"], "full").where(~F.col("code_before").eqNullSafe(F.col("code_after")))
    return both.groupBy("endpoint", "code_before", "code_after").agg(F.count("*").alias("n"))


def equal_frames(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
