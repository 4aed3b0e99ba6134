"""Metadata of a resource: summaries as tables, and documents put together from their few rows on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ENDPOINTS, MISSING, PARENT_CHILDREN, STATE_CODES
from . import pivots


def long_annotation_summary(df: DataFrame, task: str = "endpoint", key: str = "sequence", label: str = "label") -> DataFrame:
    """Rows, different keys, positives and negatives of every task of a long table; the columns must be there."""
    missing = {task, key, label} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return df.groupBy(task).agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_unique"), F.count_if(F.col(label) == 1).alias("n_positive"), F.count_if(F.col(label) == 0).alias("n_negative"))


def wide_annotation_summary(pivot: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    """Positive, negative and missing codes of every endpoint column."""
    n = lambda c: F.count_if(F.col("code") == c)
    return pivots.unpivot_codes(pivot.select(*endpoints), endpoints).groupBy("endpoint").agg(n(1).alias("n_positive"), n(0).alias("n_negative"), n(MISSING).alias("n_missing"), F.count("*").alias("n"))


def support_hits(tables: Mapping[str, DataFrame], identifier: str) -> DataFrame:
    """The rows of one id in every table, with the table's name; each scan is filtered before the union."""
    from functools import reduce

    parts = [df.where(F.col("id") == identifier).withColumn("table_name", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pre_hierarchy_pivot(audit: DataFrame, pivot: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    """The pivot before propagation: audited cells take their code from the audit, others stay."""
    from ..functions.labels import encode_state

    before = audit.groupBy("sequence").pivot("endpoint", list(endpoints)).agg(F.max(encode_state(F.col("status_before_hierarchy"))))
    renamed = before.select("sequence", *(F.col(e).alias(f"__{e}") for e in endpoints))
    joined = pivot.join(renamed, "sequence", "left")
    return joined.select("id", "sequence", *(F.coalesce(f"__{e}", e).alias(e) for e in endpoints))


def rule_description(rule_id: str, parent: str, children: Sequence[str] | None = None) -> dict:
    """What one propagation rule does, as a record."""
    return {"rule_id": rule_id, "target": parent, "sources": list(children or PARENT_CHILDREN[parent]), "condition": "any source is positive", "action": f"{parent} becomes positive unless it is ambiguous", "negatives_propagate": False}


def reduction_record(log: list[dict], name: str, before: int, after: int, **parameters) -> list[dict]:
    """The log with one more reduction; the given list stays as it is."""
    return [*log, {"name": name, "n_before": before, "n_after": after, "n_removed": before - after, "parameters": parameters}]


def document(pivot: DataFrame, states: DataFrame, support: DataFrame, version: str = "1.0", stamp: bool = True) -> dict:
    """The resource's metadata: sizes, state counts, hierarchy statistics, support bins, rules. Only summary rows reach the driver."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    from .hierarchy import audit

    return {
        "version": version,
        "generated_at": datetime.now(UTC).isoformat() if stamp else None,
        "codes": STATE_CODES,
        "sequences": rows(pivots.sequence_statistics(pivot))[0],
        "endpoints": {r.pop("endpoint"): r for r in rows(pivots.endpoint_summary(states, five=True))},
        "hierarchy": {r.pop("endpoint"): r for r in rows(pivots.hierarchy_statistics(audit(states)))},
        "ambiguous_support": sorted(rows(pivots.support_summary(support)), key=lambda r: (r["endpoint"], r["bin"])),
        "rules": [rule_description(f"R{i}", p) for i, p in enumerate(PARENT_CHILDREN, 1)],
    }
