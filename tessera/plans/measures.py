"""Queries of measurements, annotations and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotations, cards, evidence, free_json, hierarchy, measurements, profile
from ..session import materialize
from .adapters import SOURCES, dealt, table
from .evidence import E, HIERARCHY, clean, counts, pivot, resolved, states
from .registry import query
from .texts import LABELLED, parsed

KINDS = measurements.TYPES


def crossed(spark, d):
    return measurements.cross_reference(parsed(spark, d).where("sequence is not null"), pivot(spark, d))


MEASURED = (
    HIERARCHY
    + ", "
    + LABELLED.strip()
    + """,
xref AS (
  SELECT lab.*, p.sequence IS NOT NULL AS in_master, CASE WHEN length(lab.sequence) > 70 THEN 'above_max_length' WHEN length(lab.sequence) < 5 THEN 'below_min_length'
    WHEN NOT regexp_full_match(lab.sequence, '[ACDEFGHIKLMNPQRSTVWY]+') THEN 'non_canonical' WHEN p.sequence IS NOT NULL THEN 'matched_master' ELSE 'eligible_not_in_master' END AS status
  FROM lab LEFT JOIN pivoted p ON p.sequence = lab.sequence WHERE lab.sequence IS NOT NULL
)"""
)
VALID = MEASURED + ", good AS (SELECT * FROM xref WHERE type IS NOT NULL AND value > 0 AND unit IS NOT NULL)"


@query(f"WITH {MEASURED} SELECT status AS cross_reference_status, type, count(*) AS n, count(DISTINCT sequence) AS n_sequences FROM xref GROUP BY ALL")
def measurement_crossref(spark, d):
    return crossed(spark, d).groupBy("cross_reference_status", "type").agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("n_sequences"))


@query(f"""WITH {VALID}, pre AS (SELECT type, sequence, unit, count(*) AS n, count(*) FILTER (in_master) AS matched FROM good GROUP BY ALL)
SELECT coalesce(type, 'ALL') AS type, sum(n)::BIGINT AS n_records, count(DISTINCT sequence) AS n_sequences, sum(matched)::BIGINT AS n_matched, sum(n - matched)::BIGINT AS n_unmatched, count(*) FILTER (n > 1) AS n_repeated_groups,
  array_to_string(list_sort(list_distinct(list(unit))), '|') AS units FROM pre GROUP BY GROUPING SETS ((type), ())""")  # fmt: skip
def measurement_audit_rollup(spark, d):
    return measurements.audit(measurements.valid_split(crossed(spark, d))[0])


@query(f"WITH {MEASURED} SELECT coalesce(type IS NOT NULL AND value > 0 AND unit IS NOT NULL, FALSE) AS valid, count(*) AS n FROM xref GROUP BY ALL")
def measurement_valid(spark, d):
    good, bad = measurements.valid_split(crossed(spark, d))
    return good.select(F.lit(True).alias("valid")).unionAll(bad.select(F.lit(False).alias("valid"))).groupBy("valid").agg(F.count("*").alias("n"))


@query(f"WITH {VALID} SELECT DISTINCT sequence, source, label, unit FROM good WHERE type = 'HC50'")
def regression_dataset(spark, d):
    return measurements.regression_dataset(parsed(spark, d), "HC50").where("sequence is not null")


_piv = ", ".join(f"coalesce(max(v) FILTER (type = '{k}'), '999') AS {k.lower()}" for k in KINDS)
PROPERTY = f"""{VALID}, firsts AS (SELECT sequence, type, label || ' ' || unit AS v, min(pos) AS pos FROM good GROUP BY ALL),
joined AS (SELECT sequence, type, string_agg(v, '; ' ORDER BY pos) AS v FROM firsts GROUP BY ALL), prop AS (SELECT sequence, {_piv} FROM joined GROUP BY sequence)"""


def properties(spark, d):
    return measurements.property_pivot(measurements.valid_split(parsed(spark, d).where("sequence is not null"))[0])


@query(f"WITH {PROPERTY} SELECT * FROM prop")
def property_pivot(spark, d):
    return properties(spark, d)


@query(f"WITH {PROPERTY} SELECT p.*, {', '.join(f'coalesce({k.lower()}, {chr(39)}999{chr(39)}) AS {k.lower()}' for k in KINDS)} FROM pivoted p LEFT JOIN prop USING (sequence)")
def characterization(spark, d):
    return measurements.characterization(pivot(spark, d), properties(spark, d))


@query(f"WITH {VALID} SELECT type, unit, count(DISTINCT sequence) AS n_sequences, count(*) AS n, min(value) AS min_value, median(value) AS median_value, max(value) AS max_value FROM good GROUP BY ALL")
def measurement_groups(spark, d):
    return measurements.groups(measurements.valid_split(crossed(spark, d))[0])


@query(f"WITH {VALID} SELECT type, unit, count(DISTINCT sequence) AS n_sequences, count(*) AS n, min(value) AS min_value, median(value) AS median_value, max(value) AS max_value FROM good GROUP BY ALL HAVING count(DISTINCT sequence) >= 20 ORDER BY n_sequences DESC, n DESC, type, unit LIMIT 1")
def measurement_group_topk(spark, d):
    return measurements.best_group(measurements.valid_split(crossed(spark, d))[0])


@query(f"""WITH {VALID} SELECT sequence, median(value) AS median_value, count(*) AS n, count(DISTINCT value) AS n_different, min(value) AS min_value, max(value) AS max_value, round(log10(median(value)), 9) AS log10_median FROM good WHERE type = 'HC50' AND unit = 'mg/mL' GROUP BY sequence""")
def measurement_median(spark, d):
    return measurements.per_sequence(measurements.valid_split(crossed(spark, d))[0], "HC50", "mg/mL").withColumn("log10_median", F.round("log10_median", 9))


# ---- annotations: suppliers are source metadata
META = f"""meta AS (SELECT 'SRC' || (s_suppkey % 12) AS name_source, ['toxic, hemolytic', 'cytotoxic;neurotoxic', 'Cytolysis', 'other'][(s_nationkey % 4 + 1)::INT] AS task, 'cat' || (s_nationkey % 5) AS category,
  'Human, ' || CASE WHEN s_nationkey % 3 = 0 THEN 'no information' ELSE 'Mouse' END || ',T' || (s_suppkey % 3) AS targets FROM supplier)"""
CATEGORIES = tuple(f"cat{i}" for i in range(5))


def meta(spark, d):
    tasks = F.array(*(F.lit(x) for x in ("toxic, hemolytic", "cytotoxic;neurotoxic", "Cytolysis", "other")))
    return table(spark, d, "supplier").select(
        F.concat(F.lit("SRC"), (F.col("s_suppkey") % 12).cast("string")).alias("name_source"),
        F.try_element_at(tasks, (F.col("s_nationkey") % 4 + 1).cast("int")).alias("task"),
        F.concat(F.lit("cat"), (F.col("s_nationkey") % 5).cast("string")).alias("category"),
        F.concat(F.lit("Human, "), F.when(F.col("s_nationkey") % 3 == 0, "no information").otherwise("Mouse"), F.lit(",T"), (F.col("s_suppkey") % 3).cast("string")).alias("targets"),
    )


_EP = ", ".join(f"'{e}'" for e in E)
CATS = f"""{META}, cats AS (SELECT lower(name_source) AS source_key, endpoint, array_to_string(list_sort(list_distinct(list(category))), '|') AS categories
  FROM (SELECT name_source, category, lower(trim(unnest(string_split_regex(task, '[;,]')))) AS endpoint FROM meta) WHERE endpoint IN ({_EP}) GROUP BY ALL)"""


def categories(spark, d):
    return annotations.source_categories(meta(spark, d), E)


@query(f"WITH {CATS} SELECT * FROM cats")
def source_categories(spark, d):
    return categories(spark, d).withColumn("categories", F.array_join("categories", "|"))


@query(f"""WITH {META} SELECT lower(name_source) AS source_key, array_to_string(list_sort(list_distinct(list(t))), '|') AS targets FROM (SELECT name_source, trim(unnest(string_split(targets, ','))) AS t FROM meta) WHERE lower(t) NOT IN ('', '999', 'no information') GROUP BY ALL""")
def source_targets(spark, d):
    return annotations.source_targets(meta(spark, d)).withColumn("targets", F.array_join("targets", "|"))


@query(f"WITH {META} SELECT task, count(*) AS n FROM meta WHERE lower(task) LIKE '%toxic%' GROUP BY task")
def task_substring(spark, d):
    return annotations.task_filter(meta(spark, d), "toxic").groupBy("task").agg(F.count("*").alias("n"))


def _matrix(label: int) -> str:
    cols = ", ".join(f"CASE WHEN bool_or(category = '{c}') THEN 1 ELSE 999 END AS {c}" for c in CATEGORIES)
    return f"{HIERARCHY}, {META}, mat AS (SELECT sequence, {cols} FROM (SELECT DISTINCT sequence, lower(source) AS k FROM clean WHERE label = {label}) JOIN (SELECT DISTINCT lower(name_source) AS k, category FROM meta) USING (k) GROUP BY sequence)"


@query(f"WITH {_matrix(1)} SELECT * FROM mat")
def target_matrix(spark, d):
    return annotations.target_matrix(clean(spark, d), meta(spark, d), CATEGORIES)


@query(f"WITH {_matrix(0)} SELECT * FROM mat")
def negative_evidence_matrix(spark, d):
    return annotations.target_matrix(clean(spark, d), meta(spark, d), CATEGORIES, label=0)


@query(f"WITH {_matrix(1)} SELECT sequence, concat_ws('|', {', '.join(f'CASE WHEN {c} = 1 THEN {chr(39)}{c}{chr(39)} END' for c in CATEGORIES)}) AS categories FROM mat")
def matrix_sets(spark, d):
    return annotations.matrix_sets(annotations.target_matrix(clean(spark, d), meta(spark, d), CATEGORIES), "sequence", CATEGORIES).withColumn("categories", F.array_join("categories", "|"))


@query(f"WITH {HIERARCHY}, {CATS} SELECT endpoint, source, coalesce(categories, '') AS categories, count(*) AS n FROM clean c LEFT JOIN cats ON cats.source_key = lower(source) AND cats.endpoint = c.endpoint GROUP BY ALL".replace("SELECT endpoint,", "SELECT c.endpoint,"))
def category_lookup(spark, d):
    return annotations.lookup(clean(spark, d), categories(spark, d)).groupBy("endpoint", "source", F.array_join("categories", "|").alias("categories")).agg(F.count("*").alias("n"))


# ---- profiles and set operations
@query(f"""WITH {HIERARCHY} SELECT count(*) AS n, count(DISTINCT sequence) AS n_unique, avg(length(sequence)) AS mean, median(length(sequence)) AS median, {", ".join(f"quantile_cont(length(sequence), {q / 100}) AS p{q}" for q in (5, 25, 50, 75, 95))} FROM pivoted""")
def length_quantiles(spark, d):
    return profile.length_quantiles(pivot(spark, d))


_FIELDS = ("c_name", "c_mktsegment", "odd")


@query("""WITH c AS (SELECT c_name, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN ' ' ELSE 'x' END AS odd FROM customer) """ + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (trim({f}) <> '') AS available, count(*) - count(*) FILTER (trim({f}) <> '') AS missing, count(*) FILTER (trim({f}) <> '') * 100.0::DOUBLE / count(*) AS percent FROM c" for f in _FIELDS))
def field_coverage(spark, d):
    c = table(spark, d, "customer").select("c_name", "c_mktsegment", F.when(F.col("c_custkey") % 3 == 1, " ").when(F.col("c_custkey") % 3 == 2, "x").alias("odd"))
    return profile.field_coverage(c)


# Metadata of each customer: objects in lists in objects, as deep as the customer's number says.
_DEEP = """repeat('{"Inner  part": [0, ', (c_custkey % 5)::INT) || '{"Deep-Key": true, "empty": {}, "list ": []}' || repeat(']}', (c_custkey % 5)::INT)"""
META = f"""meta AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'no JSON' WHEN c_custkey % 13 = 0 THEN NULL ELSE '{{"Source Name": "' || c_name || '", "Year of publication": ' || (1990 + c_custkey % 30) || ', "TYPE source": null, "nested (part)": ' || {_DEEP} || '}}' END AS text FROM customer)"""


def source_texts(spark, d):
    return dealt(table(spark, d, "customer")).select("c_custkey", F.expr(META.split("SELECT c_custkey, ")[1].removesuffix(" AS text FROM customer)")).alias("text"))


@query(f"""WITH RECURSIVE {META}, t AS (SELECT c_custkey, unnest(json_extract(text, '$')::JSON[]) AS v FROM (SELECT c_custkey, '[' || text || ']' AS text FROM meta WHERE json_valid(text))),
n AS (
  SELECT c_custkey, '' AS path, v FROM t
  UNION ALL SELECT c_custkey, path || CASE json_type(v) WHEN 'ARRAY' THEN '[' || k || ']' ELSE CASE WHEN path = '' THEN '' ELSE '.' END || coalesce(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in free_json.SOURCE_ALIASES.items())}}}[{{name}}], {{name}}) END, part FROM (
    SELECT c_custkey, path, v, unnest(CASE json_type(v) WHEN 'ARRAY' THEN range(json_array_length(v)::BIGINT)::VARCHAR[] ELSE json_keys(v) END) AS k, unnest(CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') ELSE json_extract(v, '$.*') END) AS part FROM n WHERE json_type(v) IN ('ARRAY', 'OBJECT')))
SELECT c_custkey, path, v::VARCHAR AS value FROM n WHERE json_type(v) NOT IN ('ARRAY', 'OBJECT') OR v::VARCHAR IN ('{{}}', '[]')""".replace("{name}", "lower(trim(regexp_replace(k, '[^0-9A-Za-z]+', '_', 'g'), '_'))").replace("'{{}}'", "'{}'"))  # fmt: skip
def source_fields(spark, d):
    """Every field at any depth under its normalised path."""
    return free_json.leaves(free_json.nodes(source_texts(spark, d), "c_custkey", "text")).select(F.col("key").alias("c_custkey"), "path", "value")


@query("SELECT coalesce(quality::VARCHAR, 'null') AS value, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def value_counts(spark, d):
    return profile.value_counts(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), "quality")


@query("SELECT 'quality' AS \"column\", quality AS value, count(*) AS n FROM labels GROUP BY ALL UNION ALL SELECT 'toxic', toxic, count(*) FROM labels GROUP BY ALL")
def label_distribution(spark, d):
    return profile.label_distribution(table(spark, d, "labels"), ["quality", "toxic"])


@query(f"WITH {HIERARCHY} SELECT source, count(*) AS n_rows, count(DISTINCT sequence) AS n_unique, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative, string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR) AS label_space FROM clean GROUP BY source")
def dataset_metadata(spark, d):
    return profile.dataset_metadata(clean(spark, d), "source", "sequence", "label")


@query("SELECT c_nationkey, string_agg(c_mktsegment, ';' ORDER BY k) AS c_mktsegment FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def first_seen_values(spark, d):
    return profile.first_seen_join(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", ["c_custkey"])


@query("SELECT count(*) AS n_rows, count(DISTINCT l_partkey) AS n_ids, count(DISTINCT p_partkey) AS n_shared, count(DISTINCT p_partkey) / (SELECT count(*) FROM part WHERE p_size < 20) AS fraction FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 20) ON l_partkey = p_partkey")
def id_coverage(spark, d):
    master = table(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("k"))
    return profile.id_coverage(master, table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), "k")


@query(f"WITH {HIERARCHY}, b AS (SELECT sequence, toxic, CASE WHEN cytotoxic = 2 THEN 1 ELSE cytotoxic END AS cytotoxic FROM pivoted WHERE hemolytic <> 999) SELECT 'toxic' AS \"column\", count(*) FILTER (b.toxic IS DISTINCT FROM p.toxic) AS n_different FROM pivoted p LEFT JOIN b USING (sequence) UNION ALL SELECT 'cytotoxic', count(*) FILTER (b.cytotoxic IS DISTINCT FROM p.cytotoxic) FROM pivoted p LEFT JOIN b USING (sequence)")
def cell_comparison(spark, d):
    p = pivot(spark, d).select("sequence", "toxic", "cytotoxic", "hemolytic")
    b = p.where("hemolytic <> 999").withColumn("cytotoxic", F.when(F.col("cytotoxic") == 2, 1).otherwise(F.col("cytotoxic")))
    return profile.compare_cells(p, b, "sequence", ["toxic", "cytotoxic"])


@query("SELECT lower(gene) AS gene, arg_max(seq, o) AS sequence FROM (SELECT 'Gene' || (p_partkey % 37) AS gene, 'S' || p_partkey AS seq, p_partkey AS o FROM part WHERE p_partkey % 5 <> 0) GROUP BY ALL")
def gene_map(spark, d):
    header = F.concat(F.lit("sp|P1|X OS=Y "), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("GN=Gene"), (F.col("p_partkey") % 37).cast("string"))).otherwise(""), F.lit(" PE=1"))
    p = table(spark, d, "part").select(header.alias("header"), F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("sequence"), "p_partkey")
    return profile.gene_map(p, "header", ["p_partkey"], "sequence")


@query("SELECT (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2)) AS n_shared, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 UNION SELECT l_partkey FROM lineitem WHERE l_linenumber = 2)) AS n_union, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1 EXCEPT SELECT l_partkey FROM lineitem WHERE l_linenumber = 2)) AS n_only_first")
def set_disjointness(spark, d):
    li = table(spark, d, "lineitem")
    a, b = li.where("l_linenumber = 1").select("l_partkey").distinct(), li.where("l_linenumber = 2").select("l_partkey").distinct()
    # one aggregate over both sides instead of three set operations
    flags = a.withColumn("s", F.lit(1)).unionAll(b.withColumn("s", F.lit(2))).groupBy("l_partkey").agg(F.bit_or("s").alias("s"))
    return flags.agg(F.count_if(F.col("s") == 3).alias("n_shared"), F.count("*").alias("n_union"), F.count_if(F.col("s") == 1).alias("n_only_first"))


@query("SELECT vec_id, label, len(embedding) AS width FROM embeddings WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = vec_id AND quality = 1)")
def representation_semi_join(spark, d):
    ids = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return table(spark, d, "embeddings").join(ids, "vec_id", "left_semi").select("vec_id", "label", F.size("embedding").cast("long").alias("width"))


@query("SELECT e.vec_id, l.toxic, e.embedding[1]::DOUBLE AS p_0 FROM labels l JOIN embeddings e ON l.doc_id = e.vec_id")
def representation_join(spark, d):
    ids = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "toxic")
    return ids.join(table(spark, d, "embeddings"), "vec_id").select("vec_id", "toxic", F.col("embedding")[0].cast("double").alias("p_0"))


# ---- cards
def built(spark, d):
    # votes are resolved once: the sources' states are a table that every part reads
    told = materialize(resolved(spark, d), "resolved")
    n = evidence.status_counts(told)
    wide = hierarchy.propagate(hierarchy.wide_states(evidence.direct_evidence(n)))
    final = hierarchy.long_states(wide)
    negative, targets = cards.negative_sources(told, final, categories(spark, d)), cards.positive_targets(told, final, target_categories(spark, d))
    return cards.build(hierarchy.master_pivot(wide), final, n, measurements.valid_split(parsed(spark, d).where("sequence is not null"))[0], negative=negative, targets=targets)


def target_categories(spark, d):
    return annotations.source_categories(meta(spark, d), E, category="targets")


CARDED = f"""{HIERARCHY}, {CATS.replace("cats AS", "cats0 AS")}, cats AS (SELECT source_key, endpoint, unnest(string_split(categories, '|')) AS category FROM cats0),
tars AS (SELECT DISTINCT lower(name_source) AS source_key, endpoint, trim(unnest(string_split(lower(targets), ','))) AS target FROM (SELECT name_source, targets, lower(trim(unnest(string_split_regex(task, '[;,]')))) AS endpoint FROM meta) WHERE endpoint IN ({_EP})),
neg AS (
  SELECT r.sequence, r.endpoint, s.status, r.source, coalesce((SELECT string_agg(category, '|' ORDER BY category) FROM cats WHERE cats.source_key = lower(r.source) AND cats.endpoint = r.endpoint), '') AS categories
  FROM resolved r JOIN states s ON s.sequence = r.sequence AND s.endpoint = r.endpoint AND s.status IN ('negative', 'ambiguous') WHERE r.source_status = 'negative'
),
tgt AS (
  SELECT DISTINCT r.sequence, r.endpoint, t.target FROM resolved r JOIN states s ON s.sequence = r.sequence AND s.endpoint = r.endpoint AND s.status = 'positive'
  JOIN tars t ON t.source_key = lower(r.source) AND t.endpoint = r.endpoint WHERE r.source_status = 'positive' AND t.target NOT IN ('', '999', 'no information')
)"""


@query(f"""WITH {CARDED} SELECT 'sha256_' || sha256(sequence) AS id, endpoint, status, string_agg(source || ':' || categories, ';' ORDER BY source) AS sources FROM neg GROUP BY ALL""")
def card_negative_evidence(spark, d):
    found = built(spark, d).select("id", F.explode("negative_evidence").alias("part", "m")).select("id", "part", F.explode("m").alias("endpoint", "v"))
    said = F.array_join(F.transform("v.sources", lambda s: F.concat(s["source"], F.lit(":"), F.array_join(s["categories"], "|"))), ";")
    return found.select("id", "endpoint", F.when(F.col("part") == "supports_negative_status", "negative").otherwise("ambiguous").alias("status"), said.alias("sources"))


@query(f"""WITH {CARDED} SELECT 'sha256_' || sha256(sequence) AS id, endpoint, string_agg(target, '|' ORDER BY target) AS targets FROM tgt GROUP BY ALL""")
def card_targets(spark, d):
    return built(spark, d).select("id", F.explode("toxicity_targets").alias("endpoint", "t")).select("id", "endpoint", F.array_join("t", "|").alias("targets"))


@query(f"""WITH {CARDED} SELECT s.endpoint, s.status, coalesce(n.c, '') AS negative_evidence_categories, coalesce(t.t, '') AS toxicity_target_categories, count(*) AS n
FROM states s LEFT JOIN (SELECT sequence, endpoint, array_to_string(list_sort(list_distinct(flatten(list(string_split(categories, '|')) FILTER (categories <> '')))), '|') AS c FROM neg GROUP BY ALL) n USING (sequence, endpoint)
LEFT JOIN (SELECT sequence, endpoint, string_agg(target, '|' ORDER BY target) AS t FROM tgt GROUP BY ALL) t USING (sequence, endpoint) WHERE s.status <> 'no_information' GROUP BY ALL""")
def activity_evidence_table(spark, d):
    told, final = resolved(spark, d), states(spark, d)
    out = cards.activity_table(final, counts(spark, d), cards.negative_sources(told, final, categories(spark, d)), cards.positive_targets(told, final, target_categories(spark, d)))
    return out.groupBy("endpoint", "status", "negative_evidence_categories", "toxicity_target_categories").agg(F.count("*").alias("n"))


@query(f"""WITH {CARDED} SELECT r.endpoint, r.source, r.source_status, array_to_string(labels, '|') AS observed_labels,
  CASE WHEN r.source_status = 'negative' THEN coalesce((SELECT string_agg(category, '|' ORDER BY category) FROM cats WHERE cats.source_key = lower(r.source) AND cats.endpoint = r.endpoint), '') ELSE '' END AS negative_evidence_categories, count(*) AS n
FROM resolved r GROUP BY ALL""")
def source_evidence_table(spark, d):
    out = cards.source_table(resolved(spark, d), categories(spark, d), target_categories(spark, d))
    return out.groupBy("endpoint", "source", "source_status", "observed_labels", "negative_evidence_categories").agg(F.count("*").alias("n"))


@query(f"""WITH {HIERARCHY}, per AS (SELECT sequence, status, string_agg(endpoint, ',' ORDER BY list_position([{_EP}], endpoint)) AS endpoints FROM states WHERE status <> 'no_information' GROUP BY ALL)
SELECT id, length(p.sequence)::INT AS length, coalesce((SELECT string_agg(status || '=' || endpoints, ';' ORDER BY status) FROM per WHERE per.sequence = p.sequence), '') AS activity FROM pivoted p""")  # fmt: skip
def card_activity(spark, d):
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("activity_summary")), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ","))), ";")
    return built(spark, d).select("id", "length", F.coalesce(flat, F.lit("")).alias("activity"))


@query(f"""WITH {VALID} SELECT 'sha256_' || sha256(sequence) AS id, string_agg(concat_ws(' ', type, label, unit, source), ';' ORDER BY type, relation, value, unit, error NULLS FIRST, label, source) AS records FROM good WHERE in_master GROUP BY sequence""")
def card_measurements(spark, d):
    flat = F.array_join(F.transform("toxicity_properties", lambda r: F.concat_ws(" ", r["type"], r["reported_value"], r["unit"], r["source"])), ";")
    return built(spark, d).where("toxicity_properties is not null").select("id", flat.alias("records"))


@query(f"WITH {HIERARCHY} SELECT id, sequence, length(sequence)::INT AS length FROM pivoted WHERE sequence = (SELECT min(sequence) FROM pivoted)")
def card_lookup(spark, d):
    p = pivot(spark, d)
    first = p.agg(F.min("sequence")).first()[0]
    return cards.find(built(spark, d), sequence=f" {first.lower()} ").select("id", "sequence", "length")


@query(f"WITH {HIERARCHY} SELECT id FROM states JOIN pivoted USING (sequence) WHERE endpoint = 'toxic' AND status = 'ambiguous'")
def card_filter(spark, d):
    return cards.with_activity(built(spark, d), "ambiguous", "toxic", most=None).select("id")


@query(f"""WITH {HIERARCHY} SELECT 'sha256_' || sha256(sequence) AS id, string_agg(endpoint || ':' || hierarchy_source || ':' || before || ':' || status, ';' ORDER BY endpoint) AS ontology FROM flags WHERE hierarchy_source <> '' GROUP BY sequence""")
def card_ontology(spark, d):
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("ontology")), lambda e: F.concat_ws(":", e["key"], F.array_join(e["value"]["support_from"], "|"), e["value"]["direct_status"], e["value"]["final_status"])), ";")
    return built(spark, d).where("ontology is not null").select("id", flat.alias("ontology"))


@query(f"""WITH {HIERARCHY} SELECT 'sha256_' || sha256(sequence) AS id, string_agg(endpoint || ':' || concat_ws(',', CASE WHEN n_positive_sources > 0 THEN 'p' || n_positive_sources END, CASE WHEN n_negative_sources > 0 THEN 'n' || n_negative_sources END, CASE WHEN n_unlabeled_sources > 0 THEN 'u' || n_unlabeled_sources END, CASE WHEN n_conflicting_sources > 0 THEN 'c' || n_conflicting_sources END), ';' ORDER BY endpoint) AS evidence FROM counts GROUP BY sequence""")
def card_evidence_counts(spark, d):
    inner = lambda m: F.concat_ws(",", *(F.concat(F.lit(s[0]), F.try_element_at(m, F.lit(s)).cast("string")) for s in ("positive", "negative", "unlabeled", "conflicting")))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries(F.transform_values("evidence_counts", lambda _, v: inner(v)))), lambda e: F.concat_ws(":", e["key"], e["value"])), ";")
    return built(spark, d).select("id", flat.alias("evidence"))


@query(None)
def card_json(spark, d):
    return cards.as_json(built(spark, d))


@query(None)
def card_example(spark, d):
    return cards.as_json(cards.example(built(spark, d)).drop("score"))
