"""Keys, parameter names, natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_key(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def endpoint_key(name: Column) -> Column:
    return F.replace(source_key(F.replace(name, F.lit("-"), F.lit(" "))), F.lit(" "), F.lit("_"))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_"))


def meaningful_targets(targets: Column) -> Column:
    """Sorted different comma-separated targets, without empty ones, 999 and "no information"."""
    each = F.transform(F.split(targets, ","), lambda t: F.trim(t))
    return F.array_sort(F.array_distinct(F.filter(each, lambda t: ~F.lower(t).isin("", "999", "no information"))))


def threshold_parameter(level: Column) -> Column:
    """p70_0: 70.0, threshold_0.7 and minseqid_0_7: 0.7, plain numbers themselves; else null."""
    text = F.trim(level)
    number = F.when(text.startswith("p"), F.replace(F.substring(text, 2, 99), F.lit("_"), F.lit(".")))
    number = number.when(text.startswith("threshold_"), F.replace(text, F.lit("threshold_"), F.lit("")))
    number = number.when(text.startswith("minseqid_"), F.replace(F.replace(text, F.lit("minseqid_"), F.lit("")), F.lit("_"), F.lit(".")))
    return number.otherwise(text).try_cast("double")


def parameter_type(level: Column) -> Column:
    text = F.trim(F.coalesce(level, F.lit("")))
    return F.when(text == "no_threshold", "no_threshold").when(text.startswith("p"), "percentile").when(text.startswith("threshold_") | text.startswith("minseqid_"), "min_seq_id").otherwise("parameter")


# Prefixes of reasons that are explained already, and what explains others by what they contain.
EXPLAINED = ("Distance-aware split failed because", "Invalid stratified k-fold:", "Invalid split input:", "Invalid split: at least one train/val/test fold contains fewer than two classes.")
EXPLAIN = (
    (r"(?:S|s)ome classes have fewer samples than n_splits", "Invalid stratified k-fold: at least one class has fewer samples than n_splits. "),
    (r"has only.*class\(es\)|class\(es\).*has only", "Invalid split: at least one train/val/test fold contains fewer than two classes. "),
    (r"input dataset has fewer rows than n_splits", "Invalid split input: the dataset has fewer rows than n_splits. "),
)


def split_reason(reason: Column) -> Column:
    """White space collapsed, what follows the first ERROR:, and an explanation before it unless it has one. Null: empty."""
    flat = F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), r"\s+", " "))
    flat = F.trim(F.regexp_replace(flat, r"^.*?ERROR:", ""))
    out = F.when(F.lit(False), "")
    for p in EXPLAINED:
        out = out.when(flat.startswith(p), flat)
    for pattern, text in EXPLAIN:
        out = out.when(flat.rlike(pattern), F.concat(F.lit(text), flat))
    return out.otherwise(flat)


def natural_key(text: Column, width: int = 12) -> Column:
    """Sorts like the text with runs of digits compared as numbers."""
    parts = F.regexp_extract_all(text, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def path_part(path: Column, nth: int) -> Column:
    """nth part of a path, negative from the end."""
    return F.split_part(path, F.lit("/"), F.lit(nth))
