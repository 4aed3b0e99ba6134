"""Free-text activities and measurement labels."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Measurement types, and units by their spellings without spaces, lower-cased.
TYPES = ("HC50", "LC50", "LD50", "MHC")
UNITS = {
    "um": "µM", "µm": "µM", "μm": "µM", "nm": "nM", "mm": "mM", "m": "M",
    "ug/ml": "µg/mL", "µg/ml": "µg/mL", "μg/ml": "µg/mL", "mg/ml": "mg/mL", "ng/ml": "ng/mL", "mg/l": "mg/L", "mg/kg": "mg/kg", "ug/kg": "µg/kg",
}
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def parse_activity(text: Column) -> Column:
    """(type, relation, value, error, unit) of a text such as "HC50 >= 2,5 x 10^-3 ± 0.1 mg/ml". What isn't there is null; the relation defaults to "=".

    A number after ± or in brackets is the error.
    """
    named = rf"(?i)\b({'|'.join(TYPES)})\b"
    units = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))

    def of_rest(rest: Column, kind: Column) -> Column:
        relation = F.replace(F.replace(F.coalesce(_found(rest, r"(>=|<=|≥|≤|>|<|=)"), F.lit("=")), F.lit("≥"), F.lit(">=")), F.lit("≤"), F.lit("<="))
        error = _number(F.coalesce(_found(rest, rf"±\s*({NUMBER})"), _found(rest, rf"\[\s*({NUMBER})\s*\]")))
        spelled = F.lower(F.regexp_replace(_found(rest, r"(?i)((?:[uµμnm]?g\s*/\s*(?:m?l|kg))|(?:[uµμnm]?M\b))"), r"\s+", ""))

        def of_plain(plain: Column) -> Column:
            base = _number(_found(plain, rf"({NUMBER})"))
            power = _found(plain, rf"{NUMBER}\s*[x×*]\s*10\^?(-?[0-9]+)").try_cast("int")
            value = F.when(power.isNull(), base).otherwise(base * F.pow(F.lit(10.0), power.cast("double")))
            return F.struct(kind.alias("type"), F.when(base.isNotNull(), relation).alias("relation"), value.alias("value"), error.alias("error"), F.try_element_at(units, spelled).alias("unit"))

        return let(F.regexp_replace(rest, rf"\[[^\]]*\]|±\s*{NUMBER}", " "), of_plain)

    return let(text, lambda t: let(F.regexp_replace(t, named, " "), lambda rest: of_rest(rest, F.upper(_found(t, named)))))


@F.arrow_udf(StringType())
def general_format(x: pa.Array) -> pa.Array:
    """A number as C's %g does: six significant digits, no trailing zeros, an exponent below 1e-4 and from 1e6. The number's exact binary value is rounded, ties to even;
    the JVM's formats round its shortest decimal text up instead, which differs where that ends in a five at the seventh digit.
    """
    return pa.array([None if v is None else f"{v:g}" for v in x.cast(pa.float64()).to_pylist()], pa.string())


def measurement_label(relation: Column, value: Column, error: Column) -> Column:
    """Value, optional " ± error", with the relation before unless it is "="."""
    body = F.concat(general_format(value), F.coalesce(F.concat(F.lit(" ± "), general_format(error)), F.lit("")))
    return F.when(F.coalesce(relation, F.lit("=")) == "=", body).otherwise(F.concat(relation, F.lit(" "), body))


def parse_label(label: Column) -> Column:
    """(relation, value, error) of a measurement label; >= and <= are read too. No match: nulls."""
    number = r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    pattern = rf"^\s*(>=|<=|<|>)?\s*({number})(?:\s*±\s*({number}))?\s*$"
    ok = label.rlike(pattern)
    return F.struct(F.when(ok, F.coalesce(_found(label, pattern, 1), F.lit("="))).alias("relation"), _found(label, pattern, 2).cast("double").alias("value"), _found(label, pattern, 3).cast("double").alias("error"))


def has_annotation(value: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(value)).isin("", "none", "na", "n/a", "null"), F.lit(False))


def describe_modifications(n_term: Column, c_term: Column, cyclic: Column, stereo: Column, unnatural: Column) -> Column:
    """The modifications that there are, joined by "; "."""
    parts = (("N-terminal", n_term, "Free"), ("C-terminal", c_term, "Free"), ("Topology", cyclic, "Linear"), ("Stereochemistry", stereo, "L"), ("Non-natural", unnatural, None))
    listed = F.concat_ws("; ", *(F.when(has_annotation(c) & (F.lit(True) if plain is None else F.trim(c) != plain), F.concat(F.lit(f"{name}: "), F.trim(c))) for name, c, plain in parts))
    return F.coalesce(F.nullif(listed, F.lit("")), F.lit("Unspecified modification"))


def is_unmodified(n_term: Column, c_term: Column, cyclic: Column, stereo: Column, unnatural: Column) -> Column:
    return F.coalesce((F.trim(n_term) == "Free") & (F.trim(c_term) == "Free") & (F.trim(cyclic) == "Linear") & (F.trim(stereo) == "L"), F.lit(False)) & ~has_annotation(unnatural)


def hemolytic_label(value: Column) -> Column:
    """Null and "Low hemolytic": 1, "Non-hemolytic": 0, else an error."""
    return F.when(value.isNull() | (F.trim(value) == "Low hemolytic"), 1).when(F.trim(value) == "Non-hemolytic", 0).otherwise(F.raise_error(F.concat(F.lit("unknown activity: "), value)))
