"""Profiles of tables: lengths, coverage, value counts, metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def length_quantiles(df: DataFrame, column: str = "sequence") -> DataFrame:
    n = F.char_length(column)
    return df.agg(F.count("*").alias("n"), F.count_distinct(column).alias("n_unique"), F.avg(n).alias("mean"), F.median(n).alias("median"), *(F.percentile(n, F.lit(q / 100)).alias(f"p{q}") for q in (5, 25, 50, 75, 95)))


def field_coverage(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(field, available, missing, percent): empty texts count as missing. One aggregate."""
    cols = list(columns or df.columns)
    ok = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    sums = df.agg(F.count("*").alias("n"), *(F.count_if(ok(c)).alias(f"c{i}") for i, c in enumerate(cols)))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"c{i}").alias("available"), (F.col("n") - F.col(f"c{i}")).alias("missing"), F.try_divide(F.col(f"c{i}") * 100.0, F.col("n")).alias("percent")) for i, c in enumerate(cols)))
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of every value, null included."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("value")).agg(F.count("*").alias("n"))


def label_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).unpivot([], list(columns), "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def dataset_metadata(df: DataFrame, source: str, key: str, label: str) -> DataFrame:
    """Rows, different keys and class counts for each source."""
    return df.groupBy(source).agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_unique"), F.count_if(F.col(label) == 1).alias("n_positive"), F.count_if(F.col(label) == 0).alias("n_negative"), F.array_join(F.transform(F.sort_array(F.collect_set(label)), lambda x: x.cast("string")), ",").alias("label_space"))


def first_seen_join(df: DataFrame, by: str, column: str, order: Sequence[str]) -> DataFrame:
    """The different values of a column in order of first sight, joined by ";"."""
    seen = df.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.min(F.struct(*order)).alias("o"))
    return seen.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", column))), lambda x: x[column]), ";").alias(column))


def residue_composition(df: DataFrame, label: str, sequence: str = "sequence") -> DataFrame:
    """Mean share of every residue by label, in long form."""
    from ..functions.sequences import CANONICAL

    n = F.char_length(sequence)
    share = lambda r: F.avg(F.try_divide((n - F.char_length(F.replace(F.col(sequence), F.lit(r), F.lit("")))).cast("double"), n)).alias(r)
    return df.groupBy(label).agg(*(share(r) for r in CANONICAL)).unpivot([label], list(CANONICAL), "residue", "mean_share")


def id_coverage(master: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows and different keys of other, how many of them master has, and their share of master."""
    keys = other.groupBy(key).agg(F.count("*").alias("n"))
    m = master.select(F.col(key).alias("__k")).distinct()
    joined = keys.join(m, F.col(key) == F.col("__k"), "left")
    total = m.count()
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_ids"), F.count("__k").alias("n_shared")).withColumn("fraction", F.col("n_shared") / F.lit(max(total, 1)))


def compare_cells(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """For each column, cells of a and b that differ, null-safe over a full join on key."""
    bb = b.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in columns))
    sums = a.select(key, *columns).join(bb, key, "full").agg(*(F.count_if(~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(c) for c in columns))
    return sums.unpivot([], list(columns), "column", "n_different")


def gene_map(headers: DataFrame, text: str, order: Sequence[str], sequence: str) -> DataFrame:
    """(gene, sequence): GN= of headers, lower-cased and trimmed; the last by order wins."""
    gene = F.lower(F.trim(F.nullif(F.regexp_extract(F.col(text), r"GN=(\S+)", 1), F.lit(""))))
    return headers.withColumn("gene", gene).where("gene is not null").groupBy("gene").agg(F.max_by(sequence, F.struct(*order)).alias("sequence"))
