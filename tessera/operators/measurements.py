"""Quantitative measurements: parsing, cross-reference, audits and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.activity import TYPES, measurement_label, parse_activity
from ..functions.labels import MISSING
from ..functions.sequences import MAX_LENGTH, MIN_LENGTH, is_canonical, sequence_id
from ..session import materialize


def parse(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds type, relation, value, error, unit and label. Each different text is parsed once, into a table that its rows are joined to: small enough to be broadcast
    where texts repeat. A null text has nulls. The one-row generator keeps later filters from repeating the expressions."""
    made = texts.select(F.col(text).alias("__text")).where("__text is not null").distinct().select("__text", F.inline(F.array(parse_activity(F.col("__text")))))
    made = made.withColumn("label", F.when(F.col("value").isNotNull(), measurement_label(F.col("relation"), F.col("value"), F.col("error"))))
    return texts.join(materialize(made, "parsed"), F.col(text) == F.col("__text"), "left").drop("__text")


def valid_split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a type, a positive finite value and a unit, and the others."""
    ok = F.coalesce(F.col("type").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")) & (F.col("value") > 0) & (F.trim(F.coalesce("unit", F.lit(""))) != "") & (F.lower("unit") != "nan"), F.lit(False))
    return parsed.where(ok), parsed.where(~ok)


def regression_dataset(parsed: DataFrame, kind: str) -> DataFrame:
    """Different (sequence, source, label, unit) of one measurement type."""
    return valid_split(parsed)[0].where(F.col("type") == kind).select("sequence", "source", "label", "unit").distinct()


def cross_reference(measurements: DataFrame, master: DataFrame) -> DataFrame:
    """Adds id, sequence_length, is_canonical, in_master and cross_reference_status. The lookup side has one row for each sequence."""
    known = master.select("sequence", F.lit(True).alias("__in"))
    out = measurements.join(known, "sequence", "left").withColumn("in_master", F.coalesce("__in", F.lit(False))).drop("__in")
    n = F.char_length("sequence")
    status = F.when(n > MAX_LENGTH, "above_max_length").when(n < MIN_LENGTH, "below_min_length").when(~is_canonical(F.col("sequence")), "non_canonical").when(F.col("in_master"), "matched_master").otherwise("eligible_not_in_master")
    return out.withColumns({"id": sequence_id(F.col("sequence")), "sequence_length": n, "is_canonical": is_canonical(F.col("sequence")), "cross_reference_status": status})


def audit(measurements: DataFrame) -> DataFrame:
    """Counts for each type and for all: grouping sets over one pre-aggregate on (type, sequence, unit)."""
    pre = measurements.groupBy("type", "sequence", "unit").agg(F.count("*").alias("n"), F.count_if("in_master").alias("matched"))
    pre = pre.withColumn("key", F.struct("sequence", "unit"))
    out = pre.groupingSets([["type"], []], "type").agg(
        F.sum("n").alias("n_records"),
        F.count_distinct("sequence").alias("n_sequences"),
        F.sum("matched").alias("n_matched"),
        F.sum(F.col("n") - F.col("matched")).alias("n_unmatched"),
        F.count_if(F.col("n") > 1).alias("n_repeated_groups"),
        F.array_join(F.sort_array(F.collect_set("unit")), "|").alias("units"),
        F.grouping("type").alias("g"),
    )
    return out.withColumn("type", F.when(F.col("g") == 1, "ALL").otherwise(F.col("type"))).drop("g")


def property_pivot(measurements: DataFrame, kinds: Sequence[str] = TYPES) -> DataFrame:
    """One row for each sequence: the different "label unit" texts of each type in input order, joined by "; "; missing "999"."""
    v = F.struct(F.col("pos"), F.concat_ws(" ", "label", "unit").alias("v"))
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(v)), lambda x: x["v"]))
    wide = measurements.groupBy("sequence").pivot("type", list(kinds)).agg(F.array_join(ordered, "; "))
    return wide.select("sequence", *(F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit(str(MISSING))).alias(k.lower()) for k in kinds))


def characterization(master: DataFrame, properties: DataFrame, kinds: Sequence[str] = TYPES) -> DataFrame:
    return master.join(properties, "sequence", "left").fillna(str(MISSING), subset=[k.lower() for k in kinds])


def groups(measurements: DataFrame) -> DataFrame:
    """(type, unit) with sequences, measurements, min, median and max of the value."""
    return measurements.groupBy("type", "unit").agg(F.count_distinct("sequence").alias("n_sequences"), F.count("*").alias("n"), F.min("value").alias("min_value"), F.median("value").alias("median_value"), F.max("value").alias("max_value"))


def best_group(measurements: DataFrame, least: int = 20) -> DataFrame:
    """The (type, unit) with most sequences, then most measurements, of those with `least` sequences."""
    return groups(measurements).where(F.col("n_sequences") >= least).orderBy(F.desc("n_sequences"), F.desc("n"), "type", "unit").limit(1)


def per_sequence(measurements: DataFrame, kind: str, unit: str) -> DataFrame:
    """Median, count, different values, min, max and log10 of the median for each sequence."""
    one = measurements.where((F.col("type") == kind) & (F.col("unit") == unit))
    out = one.groupBy("sequence").agg(F.median("value").alias("median_value"), F.count("*").alias("n"), F.count_distinct("value").alias("n_different"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return out.withColumn("log10_median", F.log10("median_value"))
