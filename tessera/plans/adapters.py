"""Adapters from the driver's tables to the library's inputs, in Spark and in SQL. They hold no query logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import ENDPOINTS
from ..functions.sequences import normalize_sequence

# Fixed values of the adapters.
HEX, LETTERS = "0123456789abcdef", "ACDEFGHIKLMNPQRS"
SOURCES = tuple(f"src{i}" for i in range(12))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a fact table that lies in fewer splits than there are cores is dealt out once, which a large one never is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(df) if name in ("lineitem", "documents") else df


def dealt(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it has fewer: for tables of small rows with much work a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _core(key: Column) -> Column:
    return F.translate(F.substring(F.sha2(key.cast("string"), 256), F.lit(1), (4 + key % 60).cast("int")), HEX, LETTERS)


def raw_sequence(key: Column) -> Column:
    core = _core(key)
    return F.when(key % 97 == 0, F.concat(core, F.lit("X"))).when(key % 50 == 0, F.concat(core, core, core)).when(key % 3 == 1, F.concat(F.lit(" "), F.lower(core))).otherwise(core)


RAW_SQL = """CASE WHEN l_partkey % 97 = 0 THEN core || 'X' WHEN l_partkey % 50 = 0 THEN core || core || core WHEN l_partkey % 3 = 1 THEN ' ' || lower(core) ELSE core END"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_sequence, endpoint, source, label, pos) from lineitem."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus")
    e = F.when((F.col("l_linenumber") == 7) & (F.col("l_linestatus") == "O"), 8).otherwise(F.col("l_linenumber"))
    flag = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).otherwise(2)
    agreed = F.try_element_at(F.array(*(F.lit(v) for v in (0, 1, 2, 0))), ((F.col("l_partkey") * 31 + F.col("e") * 17) % 4 + 1).cast("int"))
    li = li.withColumn("e", e).where((F.col("l_partkey") + F.col("e")) % 3 != 0)
    return li.select(
        raw_sequence(F.col("l_partkey")).alias("raw_sequence"),
        F.try_element_at(F.array(*(F.lit(x) for x in ENDPOINTS)), F.col("e")).alias("endpoint"),
        F.concat(F.lit("src"), (F.col("l_suppkey") % 12).cast("string")).alias("source"),
        F.when(F.col("l_tax") < 0.07, agreed).otherwise(flag).alias("label"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
    )


ENDPOINT_LIST = ", ".join(f"'{e}'" for e in ENDPOINTS)

VOTES = f"""
raw_li AS (
  SELECT *, CASE WHEN l_linenumber = 7 AND l_linestatus = 'O' THEN 8 ELSE l_linenumber END AS e,
    translate(substr(sha256(l_partkey::VARCHAR), 1, 4 + (l_partkey % 60)::INT), '{HEX}', '{LETTERS}') AS core FROM lineitem
),
votes AS (
  SELECT {RAW_SQL} AS raw_sequence, [{ENDPOINT_LIST}][e] AS endpoint, 'src' || (l_suppkey % 12) AS source,
    CASE WHEN l_tax < 0.07::DOUBLE THEN [0, 1, 2, 0][((l_partkey * 31 + e * 17) % 4 + 1)::INT] WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 ELSE 2 END AS label,
    (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos
  FROM raw_li WHERE (l_partkey + e) % 3 <> 0
),
norm AS (SELECT nullif(upper(regexp_replace(raw_sequence, '\\s+', '', 'g')), '') AS sequence, * FROM votes),
clean AS (
  SELECT sequence, endpoint, source, label, pos FROM norm
  WHERE length(sequence) BETWEEN 5 AND 70 AND regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWY]+')
)"""

RESOLVED = (
    VOTES
    + """,
resolved AS (
  SELECT sequence, endpoint, source, list_sort(list_distinct(list(label))) AS labels,
    CASE WHEN count(DISTINCT label) > 1 THEN 'conflicting' WHEN min(label) = 1 THEN 'positive' WHEN min(label) = 0 THEN 'negative' WHEN min(label) = 2 THEN 'unlabeled' ELSE 'no_information' END AS source_status
  FROM clean GROUP BY ALL
),
counts AS (
  SELECT sequence, endpoint, count(*) FILTER (source_status = 'positive') AS n_positive_sources, count(*) FILTER (source_status = 'negative') AS n_negative_sources,
    count(*) FILTER (source_status = 'unlabeled') AS n_unlabeled_sources, count(*) FILTER (source_status = 'conflicting') AS n_conflicting_sources
  FROM resolved GROUP BY ALL
),
direct AS (
  SELECT *, (n_positive_sources > 0 AND n_negative_sources > 0) OR n_conflicting_sources > 0 AS is_ambiguous,
    CASE WHEN n_positive_sources + n_negative_sources > 0 THEN n_positive_sources::DOUBLE / (n_positive_sources + n_negative_sources) END AS positive_fraction,
    CASE WHEN (n_positive_sources > 0 AND n_negative_sources > 0) OR n_conflicting_sources > 0 THEN 'ambiguous' WHEN n_positive_sources > 0 THEN 'positive'
      WHEN n_negative_sources > 0 THEN 'negative' WHEN n_unlabeled_sources > 0 THEN 'unlabeled' ELSE 'no_information' END AS status_before
  FROM counts
)"""
)

_before = ", ".join(f"coalesce(max(status_before) FILTER (endpoint = '{e}'), 'no_information') AS b_{e}" for e in ENDPOINTS)
_cyto = ("hemolytic", "cytolysis", "anti_mammalian_cells")
_tox = ("cytotoxic", "neurotoxic", "embryotoxic", "ichthyotoxic")
HIERARCHY = (
    RESOLVED
    + f""",
wide AS (SELECT sequence, {_before} FROM direct GROUP BY sequence),
cy AS (
  SELECT *, concat_ws('|', {", ".join(f"CASE WHEN b_{c} = 'positive' THEN '{c}' END" for c in _cyto)}) AS s_cytotoxic FROM wide
),
tx AS (
  SELECT *, concat_ws('|', CASE WHEN b_cytotoxic = 'positive' OR s_cytotoxic <> '' THEN 'cytotoxic' END, {", ".join(f"CASE WHEN b_{c} = 'positive' THEN '{c}' END" for c in _tox[1:])}) AS s_toxic FROM cy
),
states AS (
  SELECT sequence, endpoint, before, source AS hierarchy_source, CASE WHEN source <> '' AND before <> 'ambiguous' THEN 'positive' ELSE before END AS status
  FROM (
    {" UNION ALL ".join(f"SELECT sequence, '{e}' AS endpoint, b_{e} AS before, {'s_' + e if e in ('toxic', 'cytotoxic') else chr(39) * 2} AS source FROM tx" for e in ENDPOINTS)}
  )
),
flags AS (
  SELECT *, source_ok AS has_hierarchical_positive_evidence, source_ok AND before = 'ambiguous' AS hierarchy_blocked_by_ambiguity,
    source_ok AND before NOT IN ('positive', 'ambiguous') AND status = 'positive' AS is_hierarchy_inferred, source_ok AND before IN ('negative', 'ambiguous') AS has_hierarchical_conflict,
    status = 'ambiguous' AS is_ambiguous, before <> 'no_information' AS has_direct_evidence
  FROM (SELECT *, hierarchy_source <> '' AS source_ok FROM states)
),
codes AS (
  SELECT sequence, endpoint, CASE status WHEN 'negative' THEN 0 WHEN 'positive' THEN 1 WHEN 'ambiguous' THEN 2 WHEN 'unlabeled' THEN 3 ELSE 999 END AS code FROM states
),
pivoted AS (
  SELECT 'sha256_' || sha256(sequence) AS id, sequence, {", ".join(f"max(code) FILTER (endpoint = '{e}') AS {e}" for e in ENDPOINTS)} FROM codes GROUP BY sequence
)"""
)


def status_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of status files from lineitem: (sequence, endpoint, declared_status, positive, negative, only_unlabel, percentage_1, counts_1, counts_0, category, input_file, pos)."""
    li = table(spark, sf_dir, "lineitem")
    text = lambda b: F.when(b, "True").otherwise(F.when(F.col("l_linenumber") > 4, "no"))
    state = F.try_element_at(F.array(*(F.lit(s) for s in ("positive", "negative", "ambiguous", "unlabeled"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    return li.select(
        normalize_sequence(raw_sequence(F.col("l_partkey"))).alias("sequence"),
        F.try_element_at(F.array(*(F.lit(x) for x in ENDPOINTS)), F.col("l_linenumber")).alias("endpoint"),
        state.alias("declared_status"),
        text(F.col("l_suppkey") % 7 == 0).alias("positive"),
        text(F.col("l_suppkey") % 11 == 0).alias("negative"),
        text(F.col("l_suppkey") % 13 == 0).alias("only_unlabel"),
        F.when(F.col("l_suppkey") % 3 == 0, F.col("l_quantity") * 2.5).alias("percentage_1"),
        (F.col("l_quantity") % 4).cast("int").alias("counts_1"),
        (F.col("l_suppkey") % 3).cast("int").alias("counts_0"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("c"), F.col("l_linestatus"))).alias("category"),
        F.concat(F.lit("file"), (F.col("l_suppkey") % 3).cast("string"), F.lit(".csv")).alias("input_file"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"),
    )


STATUS_ROWS = f"""
raw_rows AS (
  SELECT *, translate(substr(sha256(l_partkey::VARCHAR), 1, 4 + (l_partkey % 60)::INT), '{HEX}', '{LETTERS}') AS core FROM lineitem
),
status_rows AS (
  SELECT nullif(upper(regexp_replace({RAW_SQL}, '\\s+', '', 'g')), '') AS sequence, [{ENDPOINT_LIST}][l_linenumber] AS endpoint,
    ['positive', 'negative', 'ambiguous', 'unlabeled'][(l_partkey % 4 + 1)::INT] AS declared_status,
    l_suppkey % 7 = 0 AS positive, l_suppkey % 11 = 0 AS negative, l_suppkey % 13 = 0 AS only_unlabel,
    CASE WHEN l_suppkey % 3 = 0 THEN l_quantity * 2.5::DOUBLE END AS percentage_1, (l_quantity::INT % 4) AS counts_1, (l_suppkey % 3)::INT AS counts_0,
    CASE WHEN l_returnflag = 'R' THEN 'c' || l_linestatus END AS category, 'file' || (l_suppkey % 3) || '.csv' AS input_file, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos
  FROM raw_rows
),
status_inferred AS (
  SELECT *, CASE WHEN positive AND negative THEN 'ambiguous' WHEN positive THEN 'positive' WHEN negative THEN 'negative' WHEN only_unlabel THEN 'unlabeled'
    WHEN counts_1 > 0 AND counts_0 > 0 THEN 'ambiguous' ELSE declared_status END AS row_status,
    coalesce(CASE WHEN percentage_1 IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, percentage_1 / 100)) END, CASE WHEN counts_1 + counts_0 > 0 THEN counts_1::DOUBLE / (counts_1 + counts_0) END) AS fraction
  FROM status_rows
)"""


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequence, text, pos) with free-text activities from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.try_element_at(F.array(*(F.lit(x) for x in ("HC50", "lc50", "LD50", "MHC"))), (F.col("l_linenumber") - 1) % 4 + 1)
    relation = F.try_element_at(F.array(*(F.lit(x) for x in ("=", ">", "≥", "<=", ""))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    unit = F.try_element_at(F.array(*(F.lit(x) for x in ("uM", "ug/ml", "mg / mL", "mg/kg"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    q = F.col("l_quantity").cast("int").cast("string")
    value = F.when(F.col("l_partkey") % 7 == 0, F.concat(q, F.lit(",5 x 10^-2"))).when(F.col("l_partkey") % 7 == 1, F.lit("unknown")).otherwise(F.concat(q, F.lit("."), (F.col("l_suppkey") % 10).cast("string")))
    error = F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit(" ± "), (F.col("l_suppkey") % 9 + 1).cast("string"))).when(F.col("l_suppkey") % 4 == 1, F.concat(F.lit(" ["), (F.col("l_suppkey") % 9 + 1).cast("string"), F.lit("]"))).otherwise("")
    text = F.concat(kind, F.lit(" "), relation, F.lit(" "), value, error, F.lit(" "), unit)
    # as a generated column, so that filters on the sequence don't work it out again
    return li.select(F.explode(F.array(normalize_sequence(raw_sequence(F.col("l_partkey"))))).alias("sequence"), F.when(F.col("l_partkey") % 101 == 0, None).otherwise(text).alias("text"), F.concat(F.lit("src"), (F.col("l_suppkey") % 12).cast("string")).alias("source"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"))


ACTIVITIES = f"""
raw_act AS (
  SELECT *, translate(substr(sha256(l_partkey::VARCHAR), 1, 4 + (l_partkey % 60)::INT), '{HEX}', '{LETTERS}') AS core, l_quantity::INT AS q FROM lineitem
),
parsed AS (
  SELECT nullif(upper(regexp_replace({RAW_SQL}, '\\s+', '', 'g')), '') AS sequence, 'src' || (l_suppkey % 12) AS source, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
    l_partkey % 101 = 0 AS no_text,
    CASE WHEN l_partkey % 101 <> 0 THEN ['HC50', 'LC50', 'LD50', 'MHC'][(l_linenumber - 1) % 4 + 1] END AS type,
    CASE WHEN l_partkey % 101 <> 0 AND l_partkey % 7 = 0 THEN (q + 0.5::DOUBLE) * pow(10.0::DOUBLE, -2.0::DOUBLE) WHEN l_partkey % 101 <> 0 AND l_partkey % 7 <> 1 THEN (q || '.' || (l_suppkey % 10))::DOUBLE END AS value,
    CASE WHEN l_partkey % 101 <> 0 AND l_partkey % 7 <> 1 THEN ['=', '>', '>=', '<=', '='][(l_suppkey % 5 + 1)::INT] END AS relation,
    CASE WHEN l_partkey % 101 <> 0 AND l_suppkey % 4 < 2 THEN (l_suppkey % 9 + 1)::DOUBLE END AS error,
    CASE WHEN l_partkey % 101 <> 0 THEN ['µM', 'µg/mL', 'mg/mL', 'mg/kg'][(l_partkey % 4 + 1)::INT] END AS unit
  FROM raw_act
)"""
