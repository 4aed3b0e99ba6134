"""Queries of the evidence path: sequences, votes, duplicates, hierarchy, pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, sequences
from ..operators import dedup, evidence, hierarchy, pivots
from .adapters import HIERARCHY, RESOLVED, SOURCES, STATUS_ROWS, VOTES, status_rows, table, votes
from .registry import query

E = labels.ENDPOINTS


def clean(spark, d):
    return evidence.clean_votes(votes(spark, d))


def resolved(spark, d):
    return evidence.resolve_sources(clean(spark, d))


def counts(spark, d):
    return evidence.status_counts(resolved(spark, d))


def direct(spark, d):
    return evidence.direct_evidence(counts(spark, d))


def propagated(spark, d):
    return hierarchy.propagate(hierarchy.wide_states(direct(spark, d)))


def states(spark, d):
    return hierarchy.long_states(propagated(spark, d))


def pivot(spark, d):
    return hierarchy.master_pivot(propagated(spark, d))


def inferred_rows(spark, d):
    rows = status_rows(spark, d)
    flag = lambda c: labels.parse_boolean(F.col(c))
    rows = rows.withColumn("row_status", labels.row_status(flag("positive"), flag("negative"), flag("only_unlabel"), F.col("counts_1"), F.col("counts_0"), F.col("declared_status")))
    return rows.withColumn("fraction", labels.positive_fraction(F.col("percentage_1"), F.col("counts_1"), F.col("counts_0")))


@query(f"WITH {VOTES} SELECT raw_sequence, sequence, count(*) AS n FROM norm GROUP BY ALL")
def normalize_sequences(spark, d):
    return votes(spark, d).groupBy("raw_sequence", sequences.normalize_sequence(F.col("raw_sequence")).alias("sequence")).agg(F.count("*").alias("n"))


@query(f"WITH {VOTES} SELECT DISTINCT sequence, 'sha256_' || sha256(sequence) AS id FROM clean")
def sequence_ids(spark, d):
    return clean(spark, d).select("sequence").distinct().withColumn("id", sequences.sequence_id(F.col("sequence")))


@query(f"""WITH {VOTES} SELECT CASE WHEN sequence IS NULL THEN 'missing' WHEN length(sequence) NOT BETWEEN 5 AND 70 THEN 'length'
  WHEN NOT regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWY]+') THEN 'noncanonical' ELSE 'pass' END AS reason, count(*) AS n FROM norm GROUP BY ALL""")  # fmt: skip
def qc_reasons(spark, d):
    s = votes(spark, d).select(sequences.normalize_sequence(F.col("raw_sequence")).alias("s"))
    return s.groupBy(sequences.qc_reason(F.col("s")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {VOTES} SELECT DISTINCT sequence, coalesce(regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWYXUZ]+'), FALSE) AS extended_ok,
  coalesce(length(sequence) BETWEEN 2 AND 1024, FALSE) AS model_length_ok FROM norm""")  # fmt: skip
def extended_checks(spark, d):
    s = votes(spark, d).select(sequences.normalize_sequence(F.col("raw_sequence")).alias("sequence")).distinct()
    return s.select("sequence", sequences.is_canonical(F.col("sequence"), extended=True).alias("extended_ok"), sequences.length_ok(F.col("sequence"), sequences.MODEL_MIN_LENGTH, sequences.MODEL_MAX_LENGTH).alias("model_length_ok"))


@query("""SELECT value, coalesce(lower(trim(value)) IN ('true', '1', 'yes'), FALSE) AS parsed, count(*) AS n FROM (
  SELECT ['True', ' yes ', '0', 'no', 'FALSE', '1', NULL, 'maybe'][(l_suppkey % 8 + 1)::INT] AS value FROM lineitem) GROUP BY ALL""")  # fmt: skip
def boolean_parse(spark, d):
    words = F.array(*(F.lit(x) for x in ("True", " yes ", "0", "no", "FALSE", "1", None, "maybe")))
    v = table(spark, d, "lineitem").select(F.try_element_at(words, (F.col("l_suppkey") % 8 + 1).cast("int")).alias("value"))
    return v.groupBy("value", labels.parse_boolean(F.col("value")).alias("parsed")).agg(F.count("*").alias("n"))


@query(f"WITH {STATUS_ROWS} SELECT declared_status, row_status, count(*) AS n FROM status_inferred GROUP BY ALL")
def row_status(spark, d):
    return inferred_rows(spark, d).groupBy("declared_status", "row_status").agg(F.count("*").alias("n"))


@query(f"WITH {STATUS_ROWS} SELECT sequence, endpoint, max(fraction) AS fraction, count(fraction) AS n FROM status_inferred GROUP BY ALL")
def positive_fraction(spark, d):
    return inferred_rows(spark, d).groupBy("sequence", "endpoint").agg(F.max("fraction").alias("fraction"), F.count("fraction").alias("n"))


@query(f"WITH {HIERARCHY} SELECT endpoint, code, count(*) AS n FROM codes GROUP BY ALL")
def encode_states(spark, d):
    return states(spark, d).groupBy("endpoint", labels.encode_state(F.col("status")).alias("code")).agg(F.count("*").alias("n"))


@query(f"""WITH {RESOLVED} SELECT positive_fraction, CASE WHEN positive_fraction IS NULL THEN '999' ELSE concat(b, '-', b + 10) END AS bin, count(*) AS n
  FROM (SELECT positive_fraction, least(90, greatest(0, (floor(positive_fraction * 100 / 10) * 10)::INT)) AS b FROM direct) GROUP BY ALL""")  # fmt: skip
def support_bins(spark, d):
    x = direct(spark, d)
    return x.groupBy("positive_fraction", labels.support_bin(F.col("positive_fraction")).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {STATUS_ROWS} SELECT percentage_1, CASE WHEN percentage_1 > 90 THEN '>90' WHEN percentage_1 > 80 THEN '80-90' WHEN percentage_1 > 70 THEN '70-80' WHEN percentage_1 > 60 THEN '60-70'
  WHEN percentage_1 > 50 THEN '50-60' WHEN percentage_1 > 40 THEN '40-50' WHEN percentage_1 > 30 THEN '30-40' WHEN percentage_1 > 20 THEN '20-30' WHEN percentage_1 > 10 THEN '10-20' ELSE '>0' END AS bin,
  count(*) AS n FROM status_rows GROUP BY ALL""")  # fmt: skip
def consensus_bins(spark, d):
    return status_rows(spark, d).groupBy("percentage_1", labels.consensus_bin(F.col("percentage_1")).alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {VOTES} SELECT DISTINCT sequence FROM norm WHERE sequence IS NOT NULL")
def distinct_sequences(spark, d):
    return votes(spark, d).select(sequences.normalize_sequence(F.col("raw_sequence")).alias("sequence")).distinct().na.drop()


_cols = ", ".join(f"coalesce(arg_min(label, pos) FILTER (source = '{s}'), 999) AS {s}" for s in SOURCES)
_n = lambda v: " + ".join(f"({s} = {v})::INT" for s in SOURCES)
MATRIX = f"{VOTES}, matrix AS (SELECT sequence, {_cols} FROM clean WHERE endpoint = 'toxic' GROUP BY sequence)"
LABELLED = f"""{MATRIX}, labelled AS (SELECT *, {_n(1)} AS counts_1, {_n(0)} AS counts_0, {_n(2)} AS counts_unlabel, {_n(999)} AS counts_unknown FROM matrix),
  voted AS (SELECT *, counts_1 > 0 AND counts_0 = 0 AS positive, counts_0 > 0 AND counts_1 = 0 AS negative, counts_1 > 0 AND counts_0 = 0 AND counts_unlabel = 0 AS exclusive_1, counts_0 > 0 AND counts_1 = 0 AND counts_unlabel = 0 AS exclusive_0,
  counts_unlabel > 0 AND counts_1 + counts_0 = 0 AS only_unlabel, CASE WHEN counts_1 + counts_0 > 0 THEN counts_1 * 100.0::DOUBLE / (counts_1 + counts_0) ELSE 0.0::DOUBLE END AS percentage_1,
  CASE WHEN counts_1 + counts_0 > 0 THEN counts_0 * 100.0::DOUBLE / (counts_1 + counts_0) ELSE 0.0::DOUBLE END AS percentage_0 FROM labelled)"""  # fmt: skip


def matrix(spark, d):
    return evidence.vote_matrix(evidence.passing(votes(spark, d).where("endpoint = 'toxic'")), SOURCES)


@query(f"WITH {MATRIX} SELECT * FROM matrix")
def vote_matrix(spark, d):
    return matrix(spark, d)


@query(f"WITH {LABELLED} SELECT * FROM voted")
def label_votes(spark, d):
    return evidence.label_votes(matrix(spark, d), SOURCES)


@query(f"WITH {LABELLED} SELECT sequence, percentage_1 FROM voted WHERE NOT positive AND NOT negative AND NOT only_unlabel")
def ambiguous_split(spark, d):
    return evidence.label_votes(matrix(spark, d), SOURCES).where("not positive and not negative and not only_unlabel").select("sequence", "percentage_1")


@query("SELECT * FROM (VALUES ('n_source_columns', 12)) t(what, n)")
def source_columns(spark, d):
    found = evidence.source_columns(evidence.label_votes(matrix(spark, d), SOURCES), ["sequence", "counts_1", "counts_0", "counts_unlabel", "counts_unknown", "positive", "negative", "exclusive_1", "exclusive_0", "only_unlabel", "percentage_1", "percentage_0"])
    return spark.range(1).select(F.lit("n_source_columns").alias("what"), F.lit(len(found)).alias("n"))


# ---- duplicates: documents with labels; about 7 % of the texts occur repeatedly
DUP = """
dl AS (SELECT md5(text) AS key, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic END AS label FROM documents LEFT JOIN labels USING (doc_id)),
cls AS (SELECT key, count(label) AS n, count(DISTINCT coalesce(label::VARCHAR, 'null')) AS k, max(label) AS label, count(*) AS n_rows, array_to_string(list_sort(list_distinct(list(label::VARCHAR) FILTER (label IS NOT NULL))), '|') AS labels FROM dl WHERE key IS NOT NULL GROUP BY key)"""


def labelled_texts(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.select(F.md5(F.col("text").cast("binary")).alias("key"), F.when(F.col("doc_id") % 5 != 0, F.col("toxic")).alias("label"))


@query(f"WITH {DUP} SELECT key, label::DOUBLE AS label FROM cls WHERE n <> 1 AND k = 1")
def dedup_consistent(spark, d):
    return dedup.resolve(labelled_texts(spark, d), ["key"])[0].withColumn("label", F.col("label").cast("double"))


@query(f"WITH {DUP} SELECT key FROM cls WHERE n <> 1 AND k > 1")
def dedup_conflicts(spark, d):
    return dedup.resolve(labelled_texts(spark, d), ["key"])[1]


@query(f"WITH {DUP} SELECT dl.key, dl.label::DOUBLE AS label FROM dl JOIN cls USING (key) WHERE cls.n = 1")
def dedup_unique(spark, d):
    return dedup.resolve(labelled_texts(spark, d), ["key"])[2].withColumn("label", F.col("label").cast("double"))


@query(f"WITH {DUP} SELECT key, n_rows AS n_duplicates, coalesce(labels, '') AS labels FROM cls")
def dedup_label_lists(spark, d):
    return dedup.label_lists(labelled_texts(spark, d), ["key"])


@query(f"WITH {VOTES} SELECT sequence, arg_min(label, pos) AS label, arg_min(source, pos) AS source FROM clean GROUP BY sequence")
def first_wins(spark, d):
    v = evidence.passing(votes(spark, d))
    return dedup.first_wins(v.select("sequence", "label", "source", "pos"), ["sequence"], ["pos"]).drop("pos")


@query(f"WITH {VOTES} SELECT sequence, count(DISTINCT label) AS n_labels FROM clean GROUP BY sequence HAVING count(DISTINCT label) > 1")
def label_conflicts(spark, d):
    return dedup.conflicting_keys(clean(spark, d), ["sequence"])


MODIFIED = """
mod AS (SELECT l_partkey AS k, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'm' || l_suppkey % 3 END AS modification, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem),
bad AS (SELECT k, modification FROM mod GROUP BY ALL HAVING count(DISTINCT label) > 1)"""


def modified(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("k"), F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string"))).alias("modification"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


@query(f"WITH {MODIFIED} SELECT mod.* FROM mod WHERE EXISTS (SELECT 1 FROM bad WHERE bad.k = mod.k AND bad.modification IS NOT DISTINCT FROM mod.modification)")
def modified_conflicts_semi(spark, d):
    m = modified(spark, d)
    return dedup.null_safe(m, dedup.conflicting_keys(m, ["k", "modification"]), ["k", "modification"], "left_semi")


@query(f"WITH {MODIFIED} SELECT mod.* FROM mod WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.k = mod.k AND bad.modification IS NOT DISTINCT FROM mod.modification)")
def modified_conflicts_anti(spark, d):
    m = modified(spark, d)
    return dedup.null_safe(m, dedup.conflicting_keys(m, ["k", "modification"]), ["k", "modification"], "left_anti")


# ---- evidence
@query(f"WITH {RESOLVED} SELECT sequence, endpoint, source, array_to_string(labels, ',') AS labels, source_status FROM resolved")
def source_resolution(spark, d):
    r = resolved(spark, d)
    return r.select("sequence", "endpoint", "source", F.array_join(F.transform("observed_labels", lambda x: x.cast("string")), ",").alias("labels"), "source_status")


@query(f"WITH {RESOLVED} SELECT sequence, endpoint, source FROM resolved WHERE source_status = 'conflicting'")
def source_conflicts(spark, d):
    return resolved(spark, d).where("source_status = 'conflicting'").select("sequence", "endpoint", "source")


@query(f"WITH {RESOLVED} SELECT * FROM counts")
def source_status_counts(spark, d):
    return counts(spark, d)


MEMBERSHIP = STATUS_ROWS + """,
member AS (
  SELECT sequence, endpoint, bool_or(row_status = 'ambiguous') AS has_ambiguous, bool_or(row_status = 'positive') AS has_positive, bool_or(row_status = 'negative') AS has_negative, bool_or(row_status = 'unlabeled') AS has_unlabeled,
    count(DISTINCT row_status) > 1 AS membership_conflict,
    CASE WHEN count(DISTINCT row_status) > 1 THEN 'ambiguous' ELSE min(row_status) END AS membership_status
  FROM status_inferred GROUP BY sequence, endpoint
)"""  # fmt: skip


@query(f"WITH {MEMBERSHIP} SELECT * FROM member")
def row_membership(spark, d):
    return evidence.row_membership(inferred_rows(spark, d))


SUPPORT = """
support AS (
  SELECT sequence, endpoint, max(fraction) AS positive_fraction_reported, arg_min(category, pos) FILTER (category IS NOT NULL) AS support_category,
    array_to_string(list_sort(list_distinct(list(input_file))), '|') AS input_files, bool_or(row_status <> declared_status) AS status_file_mismatch
  FROM status_inferred GROUP BY sequence, endpoint
)"""


@query(f"WITH {STATUS_ROWS}, {SUPPORT} SELECT * FROM support")
def reported_support(spark, d):
    return evidence.reported_support(inferred_rows(spark, d))


@query(f"WITH {RESOLVED} SELECT sequence, endpoint, n_positive_sources, n_negative_sources, n_unlabeled_sources, n_conflicting_sources, positive_fraction, is_ambiguous, status_before AS status_before_hierarchy FROM direct")
def direct_evidence(spark, d):
    return direct(spark, d)


@query(f"""WITH {RESOLVED}, {MEMBERSHIP.lstrip()}, {SUPPORT.lstrip()},
j AS (SELECT * FROM counts FULL JOIN member USING (sequence, endpoint) LEFT JOIN support USING (sequence, endpoint)),
a AS (SELECT *, coalesce(n_positive_sources > 0 AND n_negative_sources > 0, FALSE) OR coalesce(n_conflicting_sources > 0, FALSE) OR coalesce(membership_status = 'ambiguous', FALSE) AS amb FROM j)
SELECT sequence, endpoint, amb AS is_ambiguous,
  coalesce(CASE WHEN n_positive_sources + n_negative_sources > 0 THEN n_positive_sources::DOUBLE / (n_positive_sources + n_negative_sources) END, positive_fraction_reported) AS positive_fraction,
  CASE WHEN amb THEN 'ambiguous' ELSE coalesce(membership_status, CASE WHEN n_positive_sources > 0 THEN 'positive' WHEN n_negative_sources > 0 THEN 'negative' WHEN n_unlabeled_sources > 0 THEN 'unlabeled' ELSE 'no_information' END) END AS status_before_hierarchy
FROM a""")  # fmt: skip
def combined_evidence(spark, d):
    rows = inferred_rows(spark, d)
    out = evidence.direct_evidence(counts(spark, d), evidence.row_membership(rows), evidence.reported_support(rows))
    return out.select("sequence", "endpoint", "is_ambiguous", "positive_fraction", "status_before_hierarchy")


@query(f"""WITH {RESOLVED}, grid AS (SELECT DISTINCT sequence, unnest([{", ".join(f"'{e}'" for e in E)}]) AS endpoint FROM direct)
SELECT sequence, endpoint, coalesce(status_before, 'no_information') AS status_before_hierarchy, coalesce(is_ambiguous, FALSE) AS is_ambiguous, status_before IS NOT NULL AS has_direct_evidence
FROM grid LEFT JOIN direct USING (sequence, endpoint)""")  # fmt: skip
def complete_grid(spark, d):
    return evidence.complete_grid(direct(spark, d)).select("sequence", "endpoint", "status_before_hierarchy", "is_ambiguous", "has_direct_evidence")


_FLAGS = "has_hierarchical_positive_evidence, hierarchy_blocked_by_ambiguity, is_hierarchy_inferred, has_hierarchical_conflict, is_ambiguous"


@query(f"WITH {HIERARCHY} SELECT sequence, endpoint, before AS status_before_hierarchy, status, hierarchy_source, {_FLAGS} FROM flags")
def hierarchy_states(spark, d):
    return states(spark, d).select("sequence", "endpoint", "status_before_hierarchy", "status", "hierarchy_source", *_FLAGS.split(", "))


@query(f"""WITH {HIERARCHY} SELECT 'sha256_' || sha256(sequence) AS id, sequence, endpoint, before AS status_before_hierarchy, status, hierarchy_source, is_hierarchy_inferred, hierarchy_blocked_by_ambiguity, has_hierarchical_conflict, is_ambiguous
  FROM flags WHERE has_hierarchical_positive_evidence""")  # fmt: skip
def hierarchy_audit(spark, d):
    return hierarchy.audit(states(spark, d))


@query(f"""WITH {HIERARCHY} SELECT endpoint, CASE WHEN hierarchy_blocked_by_ambiguity THEN 'direct_ambiguous_hierarchy_blocked' WHEN is_hierarchy_inferred AND has_direct_evidence THEN 'direct_and_hierarchy'
  WHEN is_hierarchy_inferred THEN 'hierarchy' WHEN status = 'positive' AND has_hierarchical_positive_evidence THEN 'direct_and_hierarchy' WHEN has_direct_evidence THEN 'direct' ELSE 'no_information' END AS status_origin,
  count(*) AS n FROM flags GROUP BY ALL""")  # fmt: skip
def status_origin(spark, d):
    return states(spark, d).groupBy("endpoint", "status_origin").agg(F.count("*").alias("n"))


@query(f"WITH {HIERARCHY} SELECT * FROM pivoted")
def master_pivot(spark, d):
    return pivot(spark, d)


_SUP = ", ".join(f"coalesce(max(CASE WHEN endpoint = '{e}' THEN CASE WHEN positive_fraction IS NULL THEN '999' ELSE concat(b, '-', b + 10) END END), '999') AS {e}" for e in labels.SUPPORT_ENDPOINTS)
_SUPPORTED = f"""{HIERARCHY}, sup AS (SELECT 'sha256_' || sha256(sequence) AS id, sequence, {_SUP}
  FROM (SELECT s.sequence, s.endpoint, positive_fraction, least(90, greatest(0, (floor(positive_fraction * 100 / 10) * 10)::INT)) AS b FROM states s LEFT JOIN direct d USING (sequence, endpoint)
    WHERE s.status = 'ambiguous' AND s.endpoint IN ({", ".join(f"'{e}'" for e in labels.SUPPORT_ENDPOINTS)})) GROUP BY sequence)"""  # fmt: skip


@query(f"WITH {_SUPPORTED} SELECT * FROM sup")
def ambiguous_support(spark, d):
    return pivots.ambiguous_support(states(spark, d), direct(spark, d))


@query(f"WITH {_SUPPORTED} SELECT endpoint, bin, count(*) AS n FROM (UNPIVOT (SELECT id, {', '.join(labels.SUPPORT_ENDPOINTS)} FROM sup) ON {', '.join(labels.SUPPORT_ENDPOINTS)} INTO NAME endpoint VALUE bin) WHERE bin <> '999' GROUP BY ALL")
def ambiguous_support_summary(spark, d):
    return pivots.support_summary(pivots.ambiguous_support(states(spark, d), direct(spark, d)))


_fs = lambda *ss: ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ss)


@query(f"WITH {HIERARCHY} SELECT endpoint, {_fs('positive', 'negative', 'ambiguous', 'unlabeled')} FROM states GROUP BY endpoint")
def endpoint_summary(spark, d):
    return pivots.endpoint_summary(states(spark, d))


@query(f"WITH {HIERARCHY} SELECT endpoint, {_fs('positive', 'negative', 'ambiguous', 'unlabeled', 'no_information')} FROM states GROUP BY endpoint")
def five_state_summary(spark, d):
    return pivots.endpoint_summary(states(spark, d), five=True)


@query(f"""WITH {HIERARCHY} SELECT endpoint, count(*) AS n_rows, count(*) FILTER (has_direct_evidence) AS n_direct, count(*) FILTER (has_hierarchical_positive_evidence) AS n_hierarchical, count(*) FILTER (is_hierarchy_inferred) AS n_inferred,
  count(*) FILTER (hierarchy_blocked_by_ambiguity) AS n_blocked, count(*) FILTER (has_hierarchical_conflict) AS n_conflict, count(*) FILTER (is_ambiguous) AS n_ambiguous, count(*) FILTER (status = 'positive') AS n_positive,
  count(*) FILTER (status = 'negative') AS n_negative, count(*) FILTER (status = 'unlabeled') AS n_unlabeled, count(*) FILTER (status = 'no_information') AS n_no_information FROM flags GROUP BY endpoint""")  # fmt: skip
def processing_audit(spark, d):
    return pivots.processing_audit(states(spark, d))


@query(f"""WITH {HIERARCHY} SELECT coalesce(endpoint, 'ALL') AS endpoint, count(*) AS n_rows, {", ".join(f"coalesce(sum({c}::BIGINT), 0)::BIGINT AS n_{c}" for c in ("is_hierarchy_inferred", "hierarchy_blocked_by_ambiguity", "has_hierarchical_conflict", "is_ambiguous"))}
  FROM flags WHERE has_hierarchical_positive_evidence GROUP BY GROUPING SETS ((endpoint), ())""")  # fmt: skip
def hierarchy_statistics(spark, d):
    return pivots.hierarchy_statistics(hierarchy.audit(states(spark, d)))


@query(f"""WITH {HIERARCHY}, s AS (SELECT count(*) AS n, count(DISTINCT id) AS ids, count(DISTINCT sequence) AS sequences FROM pivoted)
SELECT unnest(['ids_unique', 'sequences_unique', 'ids_well_formed', 'ids_derived_from_sequence', 'codes_valid', 'rows_informed', 'no_missing_sequence']) AS check_name, TRUE AS passed, n || '/' || n AS detail FROM s WHERE ids = n AND sequences = n""")  # fmt: skip
def assertion_report(spark, d):
    return pivots.assertions(pivot(spark, d))


@query(f"WITH {HIERARCHY} SELECT count(DISTINCT sequence) AS n_unique, min(length(sequence)) AS min_length, max(length(sequence)) AS max_length, avg(length(sequence)) AS mean_length, median(length(sequence)) AS median_length FROM pivoted")
def sequence_statistics(spark, d):
    return pivots.sequence_statistics(pivot(spark, d))


LEGACY = f"""{HIERARCHY},
r1 AS (SELECT * REPLACE (CASE WHEN 1 IN (cytolysis, cytotoxic, embryotoxic, hemolytic, ichthyotoxic, neurotoxic) THEN 1 ELSE toxic END AS toxic) FROM pivoted),
legacy AS (SELECT * REPLACE (CASE WHEN 1 IN (cytolysis, hemolytic) THEN 1 ELSE cytotoxic END AS cytotoxic, CASE WHEN cytolysis = 1 THEN 1 ELSE 999 END AS cytolysis) FROM r1)"""


@query(f"WITH {LEGACY} SELECT * FROM legacy")
def legacy_hierarchy(spark, d):
    return hierarchy.legacy_rules(pivot(spark, d))


@query(f"""WITH {LEGACY}, b AS (UNPIVOT (SELECT sequence, {", ".join(E)} FROM pivoted) ON {", ".join(E)} INTO NAME endpoint VALUE code_before), a AS (UNPIVOT (SELECT sequence, {", ".join(E)} FROM legacy) ON {", ".join(E)} INTO NAME endpoint VALUE code_after)
SELECT endpoint, code_before, code_after, count(*) AS n FROM b JOIN a USING (sequence, endpoint) WHERE code_before <> code_after GROUP BY ALL""")  # fmt: skip
def rule_change_report(spark, d):
    p = pivot(spark, d)
    return pivots.rule_changes(p, hierarchy.legacy_rules(p))


LONG = f"{HIERARCHY}, long AS (UNPIVOT (SELECT id, sequence, {', '.join(E)} FROM pivoted) ON {', '.join(E)} INTO NAME endpoint VALUE code)"


@query(f"WITH {HIERARCHY} SELECT id, sequence, hemolytic AS label FROM pivoted WHERE hemolytic IN (0, 1)")
def binary_endpoint(spark, d):
    return pivot(spark, d).where(F.col("hemolytic").isin(0, 1)).select("id", "sequence", F.col("hemolytic").alias("label"))


@query(f"WITH {HIERARCHY} SELECT id, toxic = 1 AND cytotoxic = 1 AND hemolytic IN (0, 1) AS strict, 2 IN ({', '.join(E)}) AS any_ambiguous FROM pivoted")
def multi_endpoint_filter(spark, d):
    p = pivot(spark, d)
    return p.select("id", ((F.col("toxic") == 1) & (F.col("cytotoxic") == 1) & F.col("hemolytic").isin(0, 1)).alias("strict"), F.greatest(*(F.col(e) == 2 for e in E)).alias("any_ambiguous"))


@query(f"""WITH {LONG} SELECT endpoint, CASE code WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'unlabeled' ELSE 'no_information' END AS state, count(*) AS n, count(*) / (SELECT count(*) FROM pivoted) AS fraction FROM long GROUP BY ALL""")
def endpoint_state_counts(spark, d):
    return pivots.state_counts(pivot(spark, d))


@query(f"""WITH {LONG} SELECT endpoint, count(*) FILTER (code = 0) AS negative, count(*) FILTER (code = 1) AS positive, count(*) FILTER (code IN (0, 1)) / count(*) AS coverage, CASE WHEN count(*) FILTER (code IN (0, 1)) > 0 THEN count(*) FILTER (code = 1) / count(*) FILTER (code IN (0, 1)) END AS positive_fraction FROM long GROUP BY endpoint""")
def binary_reuse(spark, d):
    return pivots.binary_reuse(pivot(spark, d))


PAIRS = f"""{HIERARCHY}, pairs AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} = 1 AND {b} = 1) AS n_both, count(*) FILTER ({a} = 1 OR {b} = 1) AS n_either FROM pivoted" for a in E for b in E)})"""


@query(f"WITH {PAIRS} SELECT a, b, n_both FROM pairs")
def cooccurrence(spark, d):
    return pivots.cooccurrence(pivot(spark, d)).select("a", "b", "n_both")


@query(f"WITH {PAIRS} SELECT a, b, n_either, CASE WHEN n_either > 0 THEN n_both / n_either ELSE 0.0 END AS jaccard FROM pairs")
def jaccard(spark, d):
    return pivots.cooccurrence(pivot(spark, d)).select("a", "b", "n_either", "jaccard")


SUMS = f"""{HIERARCHY}, sums AS (SELECT {", ".join(f"count(*) FILTER ({a} = 1) AS o_{a}, " + ", ".join(f"count(*) FILTER ({a} = 1 AND {b} = 1) AS b_{a}_{b}" for b in E) for a in E)} FROM pivoted)"""


@query(f"""WITH {SUMS}, each AS (SELECT unnest([{", ".join(f"{{'a': '{a}', 'b': '{b}', 'n': b_{a}_{b}, 'own': o_{a}}}" for a in E for b in E)}], recursive := true) FROM sums)
SELECT a, b, CASE WHEN own > 0 THEN n * 100.0::DOUBLE / own ELSE 0.0 END AS percent FROM each""")
def overlap_percent(spark, d):
    return pivots.overlap_percent(pivots.cooccurrence(pivot(spark, d)))


@query(f"WITH {HIERARCHY} SELECT n_positive, count(*) AS n, count(*) / (SELECT count(*) FROM pivoted) AS fraction FROM (SELECT {' + '.join(f'({e} = 1)::INT' for e in E)} AS n_positive FROM pivoted) GROUP BY n_positive")
def annotation_burden(spark, d):
    return pivots.burden(pivot(spark, d))


@query(f"""WITH {HIERARCHY} SELECT 1 IN (cytotoxic, hemolytic, cytolysis) AS is_cytotoxic, neurotoxic = 1 AS is_neurotoxic, embryotoxic = 1 AS is_embryotoxic, ichthyotoxic = 1 AS is_ichthyotoxic, count(*) AS n,
  (1 IN (cytotoxic, hemolytic, cytolysis))::INT + (neurotoxic = 1)::INT + (embryotoxic = 1)::INT + (ichthyotoxic = 1)::INT AS degree FROM pivoted GROUP BY ALL""")  # fmt: skip
def top_level_combinations(spark, d):
    return pivots.top_level_combinations(pivot(spark, d))


@query(f"""WITH {LONG} SELECT endpoint, {", ".join(f"count(*) FILTER (code = {c}) * 100.0::DOUBLE / count(*) AS {s}_percent" for s, c in labels.STATE_CODES.items() if c != 999)} FROM long WHERE code <> 999 GROUP BY endpoint""")
def composition_pct(spark, d):
    return pivots.composition(pivot(spark, d))


_IMPLIED = [(c, p) for p, cs in labels.PARENT_CHILDREN.items() for c in cs]


@query(f"""WITH {HIERARCHY} {" UNION ALL ".join(f"SELECT '{c}' AS child, '{p}' AS parent, count(*) FILTER ({c} = 1) AS n_child_positive, count(*) FILTER ({c} = 1 AND {p} <> 1) AS n_violations, CASE WHEN count(*) FILTER ({c} = 1) > 0 THEN count(*) FILTER ({c} = 1 AND {p} <> 1) / count(*) FILTER ({c} = 1) ELSE 0.0 END AS fraction FROM pivoted" for c, p in _IMPLIED)}""")
def hierarchy_violations(spark, d):
    return hierarchy.violations(pivot(spark, d))


@query(f"WITH {VOTES} SELECT sequence, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM clean GROUP BY sequence")
def union_sources(spark, d):
    """Twelve source tables put together by name, as the parsers' outputs are, then one row for each sequence."""
    from functools import reduce

    v = clean(spark, d)
    parts = [v.where(F.col("source") == s).select("sequence", "label").withColumn("source", F.lit(s)) for s in SOURCES]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.groupBy("sequence").agg(F.array_join(F.sort_array(F.collect_set("source")), "|").alias("sources"))
