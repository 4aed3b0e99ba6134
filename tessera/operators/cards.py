"""One nested document for each sequence, assembled by aggregates on id; lookups and exports."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ENDPOINTS, PARENT_CHILDREN
from ..functions.names import meaningful_targets
from ..functions.sequences import normalize_sequence, sequence_id
from .annotations import lookup

SCHEMA_VERSION = "1.0"


def activity_summary(states: DataFrame, endpoints: Sequence[str] = ENDPOINTS) -> DataFrame:
    """(sequence, activity_summary): state to its endpoints in declared order, without states that no endpoint has."""
    place = F.array_position(F.array(*(F.lit(e) for e in endpoints)), F.col("endpoint"))
    per = states.where("status <> 'no_information'").groupBy("sequence", "status").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "endpoint"))), lambda x: x["endpoint"]).alias("endpoints"))
    return per.groupBy("sequence").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "endpoints")))).alias("activity_summary"))


def evidence_counts(counts: DataFrame) -> DataFrame:
    """(sequence, evidence_counts): endpoint to the source states that occur, with their numbers."""
    m = F.create_map(*(x for s in ("positive", "negative", "unlabeled", "conflicting") for x in (F.lit(s), F.col(f"n_{s}_sources"))))
    per = counts.select("sequence", "endpoint", F.map_filter(m, lambda _, v: v > 0).alias("m"))
    return per.groupBy("sequence").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("endpoint", F.map_entries("m").alias("m"))))).alias("e")).select("sequence", F.transform_values("e", lambda _, v: F.map_from_entries(v)).alias("evidence_counts"))


def ontology(states: DataFrame) -> DataFrame:
    """(sequence, ontology): for supported parents, what supports them and the states before and after."""
    parents = list(PARENT_CHILDREN)
    per = states.where(F.col("endpoint").isin(*parents) & F.col("has_hierarchical_positive_evidence"))
    doc = F.struct(F.split("hierarchy_source", r"\|").alias("support_from"), F.col("status_before_hierarchy").alias("direct_status"), F.col("status").alias("final_status"))
    return per.groupBy("sequence").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("endpoint", doc.alias("d"))))).alias("ontology"))


def measurement_records(measurements: DataFrame, master: DataFrame) -> DataFrame:
    """(sequence, toxicity_properties): sorted records of sequences in master."""
    known = measurements.join(master.select("sequence"), "sequence", "left_semi").where("value is not null")
    rec = F.struct("type", "relation", "value", "unit", "error", F.col("label").alias("reported_value"), "source")
    return known.groupBy("sequence").agg(F.array_sort(F.collect_list(rec)).alias("toxicity_properties"))


def _by_endpoint(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(sequence, name): endpoint to value."""
    return rows.groupBy("sequence").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("endpoint", value.alias("v"))))).alias(name))


def negative_sources(resolved: DataFrame, states: DataFrame, categories: DataFrame) -> DataFrame:
    """(sequence, endpoint, status, sources): the sources that say negative where the final state is negative or ambiguous, with their categories."""
    told = lookup(resolved.where("source_status = 'negative'"), categories)
    final = states.where(F.col("status").isin("negative", "ambiguous")).select("sequence", "endpoint", "status")
    return told.join(final, ["sequence", "endpoint"]).groupBy("sequence", "endpoint", "status").agg(F.array_sort(F.collect_set(F.struct("source", "categories"))).alias("sources"))


def negative_evidence(found: DataFrame) -> DataFrame:
    """(sequence, negative_evidence) of negative_sources(): what the sources do to the state, then endpoint, then sources."""
    part = F.when(F.col("status") == "negative", "supports_negative_status").otherwise("contributes_to_ambiguity").alias("part")
    per = found.groupBy("sequence", part).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("endpoint", F.struct("sources").alias("v"))))).alias("m"))
    return per.groupBy("sequence").agg(F.map_from_entries(F.collect_list(F.struct("part", "m"))).alias("negative_evidence"))


def positive_targets(resolved: DataFrame, states: DataFrame, targets: DataFrame) -> DataFrame:
    """(sequence, endpoint, targets): what the sources that say positive report as affected, where the final state is positive."""
    told = lookup(resolved.where("source_status = 'positive'"), targets).join(states.where("status = 'positive'").select("sequence", "endpoint"), ["sequence", "endpoint"])
    each = told.select("sequence", "endpoint", F.explode(F.flatten(F.transform("categories", lambda c: meaningful_targets(F.lower(c))))).alias("t"))
    return each.groupBy("sequence", "endpoint").agg(F.array_sort(F.collect_set("t")).alias("targets"))


def activity_table(states: DataFrame, counts: DataFrame, negative: DataFrame, targets: DataFrame) -> DataFrame:
    """The evidence of every (sequence, endpoint) with a state, in 16 columns; categories and targets are joined by bars."""
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(c)), "|"), F.lit(""))
    out = states.where("status <> 'no_information'").join(counts, ["sequence", "endpoint"], "left").join(negative.drop("status"), ["sequence", "endpoint"], "left").join(targets, ["sequence", "endpoint"], "left")
    n = [f"n_{s}_sources" for s in ("positive", "negative", "unlabeled", "conflicting")]
    return out.select(
        sequence_id(F.col("sequence")).alias("id"), "sequence", "endpoint", "status", "status_before_hierarchy", "status_origin", *(F.coalesce(c, F.lit(0)).alias(c) for c in n),
        "hierarchy_source", "is_hierarchy_inferred", "hierarchy_blocked_by_ambiguity", "has_hierarchical_conflict",
        joined(F.flatten(F.transform("sources", lambda s: s["categories"]))).alias("negative_evidence_categories"), joined(F.col("targets")).alias("toxicity_target_categories"),
    )


def source_table(resolved: DataFrame, categories: DataFrame, targets: DataFrame) -> DataFrame:
    """What every source says of every (sequence, endpoint), in 8 columns."""
    named = lookup(lookup(resolved, categories).withColumnRenamed("categories", "negative"), targets)
    said = F.array_distinct(F.array_sort(F.flatten(F.transform("categories", lambda c: meaningful_targets(F.lower(c))))))
    return named.select(
        sequence_id(F.col("sequence")).alias("id"), "sequence", "endpoint", "source", "source_status", F.array_join(F.transform("observed_labels", lambda v: v.cast("string")), "|").alias("observed_labels"),
        F.when(F.col("source_status") == "negative", F.array_join(F.array_sort("negative"), "|")).otherwise("").alias("negative_evidence_categories"), F.array_join(said, "|").alias("toxicity_target_categories"),
    )


def build(master: DataFrame, states: DataFrame, counts: DataFrame, measurements: DataFrame | None = None, descriptors: DataFrame | None = None, negative: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Cards. All parts are keyed by sequence, so the joins share one partitioning; negative and targets come from negative_sources() and positive_targets()."""
    out = master.select("id", "sequence")
    if negative is not None:
        out = out.join(negative_evidence(negative), "sequence", "left")
    if targets is not None:
        out = out.join(_by_endpoint(targets, F.col("targets"), "toxicity_targets"), "sequence", "left")
    for part in (activity_summary(states), evidence_counts(counts), ontology(states)):
        out = out.join(part, "sequence", "left")
    if measurements is not None:
        out = out.join(measurement_records(measurements, master), "sequence", "left")
    if descriptors is not None:
        names = [c for c in descriptors.columns if c != "sequence"]
        packed = descriptors.select("sequence", F.create_map(*(x for c in names for x in (F.lit(c), F.bround(F.col(c).cast("double"), 6)))).alias("physicochemical_summary"))
        out = out.join(packed, "sequence", "left")
    empty = F.map_from_entries(F.from_json(F.lit("[]"), "array<struct<k:string,v:array<string>>>"))
    out = out.withColumn("activity_summary", F.coalesce("activity_summary", empty))
    return out.select(F.lit(SCHEMA_VERSION).alias("schema_version"), "id", "sequence", F.char_length("sequence").alias("length"), *(c for c in out.columns if c not in ("id", "sequence")))


def as_json(cards: DataFrame) -> DataFrame:
    return cards.select("id", F.to_json(F.struct(*cards.columns)).alias("card"))


def write_jsonl(cards: DataFrame, path: str) -> None:
    """Gzipped JSON lines; the commit protocol makes the write atomic."""
    as_json(cards).select("card").write.mode("overwrite").text(path, compression="gzip")


def find(cards: DataFrame, identifier: str | None = None, sequence: str | None = None) -> DataFrame:
    """The card of an id or of a raw sequence; exactly one of them."""
    if (identifier is None) == (sequence is None):
        raise ValueError("give an id or a sequence")
    wanted: Column = F.lit(identifier) if identifier is not None else sequence_id(normalize_sequence(F.lit(sequence)))
    return cards.where(F.col("id") == wanted).limit(1)


def with_activity(cards: DataFrame, status: str, endpoint: str, most: int | None = 10) -> DataFrame:
    out = cards.where(F.array_contains(F.try_element_at("activity_summary", F.lit(status)), endpoint))
    return out if most is None else out.limit(most)


def example(cards: DataFrame) -> DataFrame:
    """The card with most states and measurements; of equals, the smallest id."""
    score = F.size(F.coalesce(F.map_keys("activity_summary"), F.array())) * 10 + (F.size(F.coalesce("toxicity_properties", F.array())) if "toxicity_properties" in cards.columns else 0)
    return cards.withColumn("score", score).orderBy(F.desc("score"), "id").limit(1)


def json_schema(endpoints: Sequence[str] = ENDPOINTS) -> dict:
    """JSON Schema of a card."""
    names = {"type": "array", "items": {"enum": list(endpoints)}}
    return {
        "$schema": "https://json-schema.org/draft/2020-12/schema",
        "type": "object",
        "required": ["schema_version", "id", "sequence", "length", "activity_summary"],
        "properties": {
            "schema_version": {"const": SCHEMA_VERSION},
            "id": {"type": "string", "pattern": "^sha256_[0-9a-f]{64}$"},
            "sequence": {"type": "string"},
            "length": {"type": "integer", "minimum": 5, "maximum": 70},
            "activity_summary": {"type": "object", "additionalProperties": names},
            "evidence_counts": {"type": "object"},
            "ontology": {"type": "object"},
            "negative_evidence": {"type": "object", "propertyNames": {"enum": ["contributes_to_ambiguity", "supports_negative_status"]}},
            "toxicity_targets": {"type": "object", "propertyNames": {"enum": list(endpoints)}, "additionalProperties": {"type": "array", "items": {"type": "string"}}},
            "toxicity_properties": {"type": "array"},
            "physicochemical_summary": {"type": "object", "additionalProperties": {"type": ["number", "null"]}},
        },
    }


def export_html(card: dict) -> str:
    """One card as a page."""
    rows = "".join(f"<tr><th>{html.escape(str(k))}</th><td><pre>{html.escape(json.dumps(v, ensure_ascii=False, indent=1))}</pre></td></tr>" for k, v in card.items())
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(str(card.get("id")))}</title></head><body><table>{rows}</table></body></html>'
