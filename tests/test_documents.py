"""Steps that count as they run, and the documents made of them."""

from pyspark.sql import functions as F

from tessera.operators import documents


def test_steps_are_counted_where_they_stand(spark):
    df = spark.createDataFrame([(s,) for s in ["ACDEF", "ACDEF", "AC", "ACDEX", None, "KLMNPQ", "A" * 90]], "sequence string")
    out, log = documents.quality_steps(df).run()
    assert sorted(r["sequence"] for r in out.collect()) == ["ACDEF", "KLMNPQ"]
    assert [(s["method"], s["n_before"], s["n_after"]) for s in log] == [("present", 7, 6), ("canonical_residues", 6, 5), ("length_filter", 5, 3), ("different", 3, 2)]
    assert log[2]["parameters"] == {"min_length": 5, "max_length": 70}


def test_any_reduction_is_a_step(spark):
    steps = documents.Steps(spark.range(100)).keep("even", F.col("id") % 2 == 0, base=2).then("sample", lambda df: df.where("id < 10"), below=10).then("twice", lambda df: df.withColumn("i", F.explode(F.array(F.lit(1), F.lit(2)))))
    out, log = steps.run()
    assert out.count() == 10 and [s["n_after"] for s in log] == [50, 5, 10] and log[1] == {"method": "sample", "parameters": {"below": 10}, "n_before": 50, "n_after": 5}
    doc = documents.redundancy_document("reduce", "toxic", {"a": "a.csv"}, log, stamp=False)
    assert doc["reductions"] == log and doc["generated_at"] is None and documents.redundancy_document("r", "t", {}, [])["generated_at"]
    empty, log = documents.quality_steps(spark.createDataFrame([], "sequence string")).run()
    assert empty.count() == 0 and {s["n_after"] for s in log} == {0}


def test_categories(spark):
    toxic = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), ("b", "x", 0), ("c", None, 1), ("c", "x", 1)], "sequence string, effect string, label int")
    other = spark.createDataFrame([("c", "heal"), ("d", "heal"), ("d", None)], "sequence string, activity string")
    doc = documents.mapping_document(toxic, other)
    assert doc["statistics"]["global_categories_detailed"] == {"toxic_only_positive": 1, "toxic_only_negative": 2, "therapeutic_only": 1, "therapeutic_toxic_positive": 1, "therapeutic_toxic_negative": 0}
    assert doc["statistics"]["global_categories_general"] == {"toxic_only": 2, "therapeutic_only": 1, "therapeutic_toxic": 1} and doc["statistics"]["n_unique_sequences_total"] == 4
    assert doc["label_spaces"] == {"toxic_effects_all": ["x", "y"], "toxic_effects_positive": ["x"], "toxic_effects_negative": ["x", "y"], "therapeutic_activities": ["heal"], "toxic_labels": [0, 1]}
    none = documents.mapping_document(toxic.limit(0), other.limit(0))
    assert none["statistics"]["n_unique_sequences_total"] == 0 and none["label_spaces"]["toxic_labels"] == []
    assert ("statistics.n_unique_sequences_total", "4") in documents.flattened(doc)
