"""Queries of metadata and reference models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences
from ..operators import documents, evidence, hierarchy, metadata, models, projection
from .adapters import HIERARCHY, SOURCES, VOTES, table, votes
from .evidence import LABELLED, E, clean, matrix, pivot, states
from .registry import query


@query(f"WITH {VOTES} SELECT endpoint, count(*) AS n_rows, count(DISTINCT sequence) AS n_unique, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative FROM clean GROUP BY endpoint")
def long_annotation_summary(spark, d):
    return metadata.long_annotation_summary(clean(spark, d))


@query(f"WITH {HIERARCHY}, long AS (UNPIVOT (SELECT {', '.join(E)} FROM pivoted) ON {', '.join(E)} INTO NAME endpoint VALUE code) SELECT endpoint, count(*) FILTER (code = 1) AS n_positive, count(*) FILTER (code = 0) AS n_negative, count(*) FILTER (code = 999) AS n_missing, count(*) AS n FROM long GROUP BY endpoint")
def wide_annotation_summary(spark, d):
    return metadata.wide_annotation_summary(pivot(spark, d))


_before = ", ".join(f"CASE b_{e} WHEN 'negative' THEN 0 WHEN 'positive' THEN 1 WHEN 'ambiguous' THEN 2 WHEN 'unlabeled' THEN 3 ELSE 999 END AS {e}" for e in E)


@query(f"WITH {HIERARCHY} SELECT 'sha256_' || sha256(sequence) AS id, sequence, {_before} FROM tx")
def pre_hierarchy_pivot(spark, d):
    return metadata.pre_hierarchy_pivot(hierarchy.audit(states(spark, d)), pivot(spark, d))


@query(f"WITH {HIERARCHY}, i AS (SELECT min(id) AS id FROM pivoted) SELECT 'master' AS table_name, toxic AS code FROM pivoted JOIN i USING (id) UNION ALL SELECT 'hemolytic', hemolytic FROM pivoted JOIN i USING (id) WHERE hemolytic IN (0, 1)")
def support_hits(spark, d):
    p = pivot(spark, d)
    tables = {"master": p.select("id", F.col("toxic").alias("code")), "hemolytic": p.where(F.col("hemolytic").isin(0, 1)).select("id", F.col("hemolytic").alias("code"))}
    return metadata.support_hits(tables, p.agg(F.min("id")).first()[0]).select("table_name", "code")


@query(None)
def classification_holdout(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).cast("int").alias("truth"))
    train, test = models.holdout(df, "vec_id")
    return models.classify(train, test, "embedding", "truth").select("vec_id", "truth", "guess", F.round("score", 6).alias("score"))


@query(None)
def neighbour_graph(spark, d):
    return projection.neighbour_graph(table(spark, d, "embeddings"), "vec_id", "embedding").select("u", "v", F.round("distance", 5).alias("distance"))


@query(None)
def umap_projection(spark, d):
    return projection.umap(table(spark, d, "embeddings"), "vec_id", "embedding")


@query(None)
def tsne_projection(spark, d):
    return projection.tsne(table(spark, d, "embeddings"), "vec_id", "embedding")


def steps(spark, d):
    every = votes(spark, d).select(sequences.normalize_sequence(F.col("raw_sequence")).alias("sequence"))
    return documents.quality_steps(every)


_OK = "length(sequence) BETWEEN 5 AND 70"
_LETTERS = "regexp_full_match(sequence, '[ACDEFGHIKLMNPQRSTVWY]+')"


@query(f"""WITH {VOTES}, c AS (SELECT count(*) AS a, count(sequence) AS b, count(*) FILTER ({_LETTERS}) AS c, count(*) FILTER ({_LETTERS} AND {_OK}) AS d, count(DISTINCT sequence) FILTER ({_LETTERS} AND {_OK}) AS e FROM norm)
SELECT unnest(['present', 'canonical_residues', 'length_filter', 'different']) AS method, unnest([a, b, c, d]) AS n_before, unnest([b, c, d, e]) AS n_after FROM c""")  # fmt: skip
def filter_steps(spark, d):
    """Rows before and after each step, as the one job that ran them observed."""
    _, log = steps(spark, d).run()
    return spark.createDataFrame([(s["method"], s["n_before"], s["n_after"]) for s in log], "method string, n_before long, n_after long")


def document_rows(spark, document):
    return spark.createDataFrame(documents.flattened(document), "path string, value string")


_BIN = "CASE WHEN percentage_1 > 90 THEN '>90' " + " ".join(f"WHEN percentage_1 > {low} THEN '{low}-{low + 10}'" for low in range(80, 0, -10)) + " ELSE '>0' END"


@query(f"""WITH {LABELLED}, k AS (SELECT DISTINCT sequence FROM norm WHERE {_LETTERS} AND {_OK}), x AS (SELECT * FROM voted WHERE NOT positive AND NOT negative AND NOT only_unlabel),
l AS (SELECT min(length(sequence)) AS a, max(length(sequence)) AS b, round(avg(length(sequence)), 2) AS c, round(median(length(sequence)), 2) AS d FROM k),
c AS (SELECT count(*) AS a, count(sequence) AS b, count(*) FILTER ({_LETTERS}) AS c, count(*) FILTER ({_LETTERS} AND {_OK}) AS d, (SELECT count(*) FROM k) AS e FROM norm)
SELECT 'task' AS path, 'toxic' AS value
UNION ALL SELECT 'sources.n_unique_sequences.' || source, count(DISTINCT sequence)::VARCHAR FROM clean GROUP BY source
UNION ALL SELECT 'filters.' || unnest(['present', 'canonical_residues', 'length_filter', 'different']) || '.applied', 'True'
UNION ALL SELECT unnest(['filters', 'sequence_statistics']) || '.length_filter.min_length', '5' UNION ALL SELECT unnest(['filters', 'sequence_statistics']) || '.length_filter.max_length', '70'
UNION ALL SELECT unnest(['filters', 'sequence_statistics']) || '.different.by', 'sequence'
UNION ALL SELECT 'sequence_statistics.' || unnest(['present', 'canonical_residues', 'length_filter', 'different']) || '.before', unnest([a, b, c, d])::VARCHAR FROM c
UNION ALL SELECT 'sequence_statistics.' || unnest(['present', 'canonical_residues', 'length_filter', 'different']) || '.after', unnest([b, c, d, e])::VARCHAR FROM c
UNION ALL SELECT 'sequence_statistics.length_distribution.' || unnest(['min', 'max', 'mean', 'median']), unnest([a::VARCHAR, b::VARCHAR, c::VARCHAR, d::VARCHAR]) FROM l
UNION ALL SELECT 'statistics.' || unnest(['total_sequences_final', 'positive.positive_and_unlabel', 'positive.only_positive', 'negative.negative_and_unlabel', 'negative.only_negative', 'only_unlabel', 'ambiguous.n_sequences']),
  unnest([count(*), count(*) FILTER (positive), count(*) FILTER (exclusive_1), count(*) FILTER (negative), count(*) FILTER (exclusive_0), count(*) FILTER (only_unlabel), (SELECT count(*) FROM x)])::VARCHAR FROM voted
UNION ALL SELECT 'statistics.ambiguous.category_pbb.' || {_BIN}, count(*)::VARCHAR FROM x GROUP BY 1""")  # fmt: skip
def dataset_document(spark, d):
    kept, log = steps(spark, d).run()
    voted = evidence.label_votes(matrix(spark, d), SOURCES)
    return document_rows(spark, documents.dataset_document("toxic", clean(spark, d).select("sequence", "source"), voted, kept, log, stamp=False))


_TOXIC, _OTHER = f"toxic AS (SELECT sequence, endpoint AS effect, label FROM clean WHERE endpoint IN ('{E[0]}', '{E[1]}') AND label IN (0, 1))", f"other AS (SELECT sequence, endpoint AS activity FROM clean WHERE endpoint IN ('{E[-1]}', '{E[-2]}') AND label = 1 AND source < 'src3')"


@query(f"""WITH {VOTES}, {_TOXIC}, {_OTHER},
s AS (SELECT sequence, bool_or(p) AS p, bool_or(n) AS n, bool_or(t) AS t FROM (SELECT sequence, label = 1 AS p, label = 0 AS n, FALSE AS t FROM toxic UNION ALL SELECT sequence, FALSE, FALSE, TRUE FROM other) GROUP BY sequence)
SELECT 'task' AS path, 'toxicity_therapeutic_mapping' AS value
UNION ALL SELECT 'categories_general.' || unnest([{", ".join(f"'{g}'" for g in documents.GENERAL)}]) || '.logic', unnest([{", ".join("'category_detailed in " + str(list(of)).replace("'", "''") + "'" for of in documents.GENERAL.values())}])
UNION ALL SELECT 'categories_detailed.' || unnest([{", ".join(f"'{c}'" for c in documents.CATEGORIES)}]) || '.logic', unnest([{", ".join(f"'{r}'" for r in documents.CATEGORIES.values())}])
UNION ALL SELECT 'label_spaces.' || unnest(['toxic_effects_all', 'toxic_effects_positive', 'toxic_effects_negative', 'toxic_labels']), unnest([string_agg(DISTINCT effect, ',' ORDER BY effect), string_agg(DISTINCT effect, ',' ORDER BY effect) FILTER (label = 1), string_agg(DISTINCT effect, ',' ORDER BY effect) FILTER (label = 0), string_agg(DISTINCT label::VARCHAR, ',' ORDER BY label::VARCHAR)]) FROM toxic
UNION ALL SELECT 'label_spaces.therapeutic_activities', string_agg(DISTINCT activity, ',' ORDER BY activity) FROM other
UNION ALL SELECT 'statistics.n_unique_sequences_total', count(*)::VARCHAR FROM s
UNION ALL SELECT 'statistics.input_tables.' || unnest(['toxic_rows_total', 'toxic_positive_rows', 'toxic_negative_rows', 'toxic_unique_sequences']), unnest([count(*), count(*) FILTER (label = 1), count(*) FILTER (label = 0), count(DISTINCT sequence)])::VARCHAR FROM toxic
UNION ALL SELECT 'statistics.input_tables.' || unnest(['therapeutic_rows_total', 'therapeutic_unique_sequences']), unnest([count(*), count(DISTINCT sequence)])::VARCHAR FROM other
UNION ALL SELECT 'statistics.global_categories_general.' || unnest(['toxic_only', 'therapeutic_only', 'therapeutic_toxic']), unnest([count(*) FILTER ((p OR n) AND NOT t), count(*) FILTER (NOT p AND NOT n AND t), count(*) FILTER ((p OR n) AND t)])::VARCHAR FROM s
UNION ALL SELECT 'statistics.global_categories_detailed.' || unnest(['toxic_only_positive', 'toxic_only_negative', 'therapeutic_only', 'therapeutic_toxic_positive', 'therapeutic_toxic_negative']), unnest([count(*) FILTER (p AND NOT t), count(*) FILTER (n AND NOT t), count(*) FILTER (NOT p AND NOT n AND t), count(*) FILTER (p AND t), count(*) FILTER (n AND t)])::VARCHAR FROM s""")  # fmt: skip
def mapping_document(spark, d):
    c = clean(spark, d)
    toxic = c.where(F.col("endpoint").isin(*E[:2]) & F.col("label").isin(0, 1)).select("sequence", F.col("endpoint").alias("effect"), "label")
    other = c.where(F.col("endpoint").isin(*E[-2:]) & (F.col("label") == 1) & (F.col("source") < "src3")).select("sequence", F.col("endpoint").alias("activity"))
    return document_rows(spark, documents.mapping_document(toxic, other, stamp=False))
