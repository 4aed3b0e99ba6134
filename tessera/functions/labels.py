"""Votes, states, bins and label rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endpoints, the two-level ontology, states and codes.
ENDPOINTS = ("toxic", "cytotoxic", "hemolytic", "cytolysis", "anti_mammalian_cells", "neurotoxic", "embryotoxic", "ichthyotoxic")
PARENT_CHILDREN = {"cytotoxic": ("hemolytic", "cytolysis", "anti_mammalian_cells"), "toxic": ("cytotoxic", "neurotoxic", "embryotoxic", "ichthyotoxic")}
STATE_CODES = {"negative": 0, "positive": 1, "ambiguous": 2, "unlabeled": 3, "no_information": 999}
MISSING = 999
SUPPORT_ENDPOINTS = ("toxic", "cytotoxic", "hemolytic", "cytolysis", "neurotoxic")
ENDPOINT_ALIASES = {"cytolytic": "cytolysis"}


def parse_boolean(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def row_status(positive: Column, negative: Column, only_unlabel: Column, counts_1: Column, counts_0: Column, declared: Column) -> Column:
    """Flags before counts before the declared status."""
    mixed = (F.coalesce(counts_1, F.lit(0)) > 0) & (F.coalesce(counts_0, F.lit(0)) > 0)
    return F.when(positive & negative, "ambiguous").when(positive, "positive").when(negative, "negative").when(only_unlabel, "unlabeled").when(mixed, "ambiguous").otherwise(declared)


def positive_fraction(percentage_1: Column, counts_1: Column, counts_0: Column) -> Column:
    """Percentage over 100 within 0 and 1, else the share of positive counts, else null."""
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), percentage_1 / 100))
    return F.coalesce(F.when(percentage_1.isNotNull(), clipped), F.try_divide(counts_1.cast("double"), counts_1 + counts_0))


def encode_state(status: Column) -> Column:
    """The code of a state; another word is an error."""
    code = reduce(lambda c, kv: c.when(status == kv[0], kv[1]), STATE_CODES.items(), F.when(F.lit(False), 0))
    return code.otherwise(F.raise_error(F.concat(F.lit("unknown state: "), F.coalesce(status, F.lit("null"))))).cast("int")


def decode_state(code: Column) -> Column:
    return reduce(lambda c, kv: c.when(code == kv[1], kv[0]), STATE_CODES.items(), F.when(F.lit(False), ""))


def support_bin(fraction: Column) -> Column:
    """Ten-point bins from 0-10 to 90-100, the last with 1.0; null: "999"."""
    low = F.least(F.lit(90), F.greatest(F.lit(0), (F.floor(fraction * 100 / 10) * 10).cast("int")))
    return F.when(fraction.isNull() | F.isnan(fraction), str(MISSING)).otherwise(F.concat_ws("-", low.cast("string"), (low + 10).cast("string")))


def consensus_bin(percentage: Column) -> Column:
    """Bins open below and closed above: >90, 80-90 .. 10-20, and >0 for all else."""
    out = F.when(percentage > 90, ">90")
    for low in range(80, 0, -10):
        out = out.when(percentage > low, f"{low}-{low + 10}")
    return out.otherwise(">0")


def is_support_bin(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\A[0-9]{1,2}-[0-9]{2,3}\z"), F.lit(False))


def harmonise_endpoint(name: Column, aliases: Mapping[str, str] = ENDPOINT_ALIASES) -> Column:
    known = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.try_element_at(known, name), name)


def label_in_id(text: Column) -> Column:
    """POS: 1, else NEG: 0, else -1."""
    return F.when(text.contains("POS"), 1).when(text.contains("NEG"), 0).otherwise(-1)


def delimited_label(text: Column, delimiter: str, field: int) -> Column:
    """Field (from 1, or -1 the last) as an integer; null if it isn't one."""
    return F.split_part(text, F.lit(delimiter), F.lit(field)).try_cast("int")


def filename_label(path: Column) -> Column:
    return F.when(F.lower(path).contains("neg"), 0).otherwise(1)


def ordered_rules(text: Column, rules: Sequence[tuple[str, int]], overwrite: bool = True) -> Column:
    """Labels by case-insensitive expressions: with overwrite the last that matches counts, else the first. No match: null."""
    out = F.when(F.lit(False), 0)
    for pattern, label in reversed(rules) if overwrite else rules:
        out = out.when(text.rlike(f"(?i){pattern}"), label)
    return out


def collapse_classes(value: Column, positive: Sequence[int]) -> Column:
    return F.when(value.isin(*positive), 1).otherwise(value)


def significance_stars(p: Column) -> Column:
    """NaN and null: empty."""
    return F.when(p.isNull() | F.isnan(p), "").when(p <= 1e-4, "****").when(p <= 1e-3, "***").when(p <= 1e-2, "**").when(p <= 0.05, "*").otherwise("ns")
