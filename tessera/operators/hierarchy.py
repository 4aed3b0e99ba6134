"""Positive-only propagation over the two-level ontology, in wide form: one shuffle on sequence, no recursion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ENDPOINTS, MISSING, PARENT_CHILDREN, encode_state
from ..functions.sequences import sequence_id


def wide_states(direct: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    """One row for each sequence with the direct state of each endpoint; missing ones have no information."""
    return direct.groupBy("sequence").pivot("endpoint", list(endpoints)).agg(F.max("status_before_hierarchy")).fillna("no_information", subset=list(endpoints))


def propagate(wide: DataFrame, tree: Mapping[str, Sequence[str]] = PARENT_CHILDREN) -> DataFrame:
    """For every endpoint e of wide: e (final state), before_e and source_e, the children that support it.

    Support passes through an ambiguous parent, whose own state stays. Parents come in the order of the tree, children before their parents' parents.
    """
    ends = [c for c in wide.columns if c != "sequence"]
    support = {e: F.col(e) == "positive" for e in ends}
    final, source = {e: F.col(e) for e in ends}, {e: F.lit("") for e in ends}
    for parent, children in tree.items():
        backed = reduce(or_, (support[c] for c in children))
        source[parent] = F.concat_ws("|", *(F.when(support[c], F.lit(c)) for c in children))
        final[parent] = F.when(backed & (F.col(parent) != "ambiguous"), "positive").otherwise(F.col(parent))
        support[parent] = support[parent] | backed
    return wide.select("sequence", *(final[e].alias(e) for e in ends), *(F.col(e).alias(f"before_{e}") for e in ends), *(source[e].alias(f"source_{e}") for e in ends))


def long_states(propagated: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    """(sequence, endpoint, ..) with flags and origin, by one explode of a constant number of structs."""
    rows = F.array(*(F.struct(F.lit(e).alias("endpoint"), F.col(f"before_{e}").alias("status_before_hierarchy"), F.col(e).alias("status"), F.col(f"source_{e}").alias("hierarchy_source")) for e in endpoints))
    out = propagated.select("sequence", F.explode(rows).alias("r")).select("sequence", "r.*")
    before, status = F.col("status_before_hierarchy"), F.col("status")
    out = out.withColumn("has_hierarchical_positive_evidence", F.col("hierarchy_source") != "")
    backed = F.col("has_hierarchical_positive_evidence")
    out = out.withColumns(
        {
            "hierarchy_blocked_by_ambiguity": backed & (before == "ambiguous"),
            "is_hierarchy_inferred": backed & ~before.isin("positive", "ambiguous") & (status == "positive"),
            "has_hierarchical_conflict": backed & before.isin("negative", "ambiguous"),
            "is_ambiguous": status == "ambiguous",
            "label": F.when(status == "positive", 1).when(status == "negative", 0),
            "has_direct_evidence": before != "no_information",
        }
    )
    origin = F.when(F.col("hierarchy_blocked_by_ambiguity"), "direct_ambiguous_hierarchy_blocked").when(F.col("is_hierarchy_inferred") & F.col("has_direct_evidence"), "direct_and_hierarchy")
    origin = origin.when(F.col("is_hierarchy_inferred"), "hierarchy").when((status == "positive") & backed, "direct_and_hierarchy").when(F.col("has_direct_evidence"), "direct").otherwise("no_information")
    return out.withColumn("status_origin", origin)


def audit(states: DataFrame) -> DataFrame:
    cols = ["sequence", "endpoint", "status_before_hierarchy", "status", "hierarchy_source", "is_hierarchy_inferred", "hierarchy_blocked_by_ambiguity", "has_hierarchical_conflict", "is_ambiguous"]
    return states.where("has_hierarchical_positive_evidence").select(sequence_id(F.col("sequence")).alias("id"), *cols)


def master_pivot(propagated: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    """id, sequence and a code for each endpoint."""
    return propagated.select(sequence_id(F.col("sequence")).alias("id"), "sequence", *(encode_state(F.col(e)).alias(e) for e in endpoints))


def legacy_rules(pivot: DataFrame) -> DataFrame:
    """The older rule set over vote codes, kept apart: toxic from its children before cytotoxic from its own, overwriting what was there; of cytolysis only positives stay."""
    any_of = lambda *cs: reduce(or_, (F.col(c) == 1 for c in cs))
    out = pivot.withColumn("toxic", F.when(any_of("cytolysis", "cytotoxic", "embryotoxic", "hemolytic", "ichthyotoxic", "neurotoxic"), 1).otherwise(F.col("toxic")))
    out = out.withColumn("cytotoxic", F.when(any_of("cytolysis", "hemolytic"), 1).otherwise(F.col("cytotoxic")))
    return out.withColumn("cytolysis", F.when(F.col("cytolysis") == 1, 1).otherwise(MISSING))


def violations(pivot: DataFrame, tree: Mapping[str, Sequence[str]] = PARENT_CHILDREN) -> DataFrame:
    """For every child and parent: positives of the child, those whose parent isn't positive, and their share. One pass over the pivot."""
    pairs = [(c, p) for p, children in tree.items() for c in children]
    sums = pivot.agg(*(F.count_if(F.col(c) == 1).alias(f"n_{c}__{p}") for c, p in pairs), *(F.count_if((F.col(c) == 1) & (F.col(p) != 1)).alias(f"v_{c}__{p}") for c, p in pairs))
    rows = F.array(*(F.struct(F.lit(c).alias("child"), F.lit(p).alias("parent"), F.col(f"n_{c}__{p}").alias("n_child_positive"), F.col(f"v_{c}__{p}").alias("n_violations")) for c, p in pairs))
    return sums.select(F.explode(rows).alias("r")).select("r.*").withColumn("fraction", F.coalesce(F.try_divide(F.col("n_violations").cast("double"), F.col("n_child_positive")), F.lit(0.0)))
