"""Configuration, the split workflow's files, sinks and the card exporter."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import config, export_card
from tessera.operators import cards, splits, stats, workflow
from tessera.plans import measures
from tessera.sources import sinks


def test_typed_overrides():
    assert [config.typed(x) for x in (None, " NA ", "yes", "0", "12", "1.5", " text ", True, 3)] == [None, None, True, False, 12, 1.5, "text", True, 3]
    got, unknown = config.with_overrides({"a": {"x": 1}, "a__y": "2.5", "b__z": "no", "c__q": 1, "plain": 3}, ("a", "b"))
    assert got["a"] == {"x": 1, "y": 2.5} and got["b"] == {"z": False} and got["plain"] == 3 and unknown == ["c__q"]
    with pytest.raises(ValueError):
        config.with_overrides({"a": 5, "a__x": 1}, ("a",))


def test_seeds_yaml_and_parameters(spark, tmp_path):
    (tmp_path / "seeds.csv").write_text("seed\n7\n42\n\n7\n")
    assert config.load_seeds(spark, str(tmp_path / "seeds.csv")) == [7, 42]
    made = config.strategy_parameters("stratified_kfold", 7, {"n_splits": "4", "dropna": "no"})
    assert made == {"stratified_kfold": {"n_splits": 4, "seed": 7, "val_size": 0.1, "shuffle": True, "dropna": False, "cast_to_str": False, "label_col": "label"}}
    config.write_parameters(made, str(tmp_path / "deep" / "params.yaml"))
    assert config.load_yaml(str(tmp_path / "deep" / "params.yaml")) == made
    rep = {"feature_mode": "descriptors", "metric": "cosine", "embeddings_path": "e", "ids_path": "i", "prefix": "d_"}
    assert config.strategy_parameters("distance_aware_kfold", 1, representation=rep)["distance_aware_kfold"]["descriptor_prefix"] == "d_"
    for bad in ("distance_aware_kfold", "other"):
        with pytest.raises(ValueError):
            config.strategy_parameters(bad, 1)


def test_card_paths(tmp_path):
    (tmp_path / "pyproject.toml").write_text('[project]\nversion = "1.2.3"\n')
    (tmp_path / "dataset_caracterization").mkdir()
    (tmp_path / "dataset_caracterization" / "sequence_descriptors.csv").write_text("")
    c = config.card_settings(str(tmp_path), "atlas", output=str(tmp_path / "out"))
    assert c["master"].endswith("/atlas_sequence_pivot.csv") and c["representations"].endswith("/atlas")
    assert c["version"] == "1.2.3" and c["output"].endswith("/out") and c["descriptors"].endswith("dataset_caracterization/sequence_descriptors.csv") and c["master"].startswith(str(tmp_path.resolve()))
    assert config.project_version(str(tmp_path / "none")) == "development"
    (tmp_path / "pyproject.toml").write_text('[tool.x]\nversion = "9"\n[project]\nname = "a"\n')
    assert config.card_settings(str(tmp_path))["version"] == "development" and config.card_settings(str(tmp_path), version="2")["version"] == "2"
    with pytest.raises(TypeError):
        config.card_settings(str(tmp_path), mister="x")


def test_reduction_levels_and_files(spark, tmp_path):
    for name in ("p70_0", "threshold_0.4", "other"):
        (tmp_path / name).mkdir()
    (tmp_path / "p70_0" / "data_nr.csv").write_text("")
    root = str(tmp_path)
    assert workflow.reduction_levels(spark, root) == ["p70_0", "threshold_0.4"]
    assert workflow.reduction_levels(spark, root, None) == [] and workflow.reduction_levels(spark, root, ["p1"]) == ["p1"]
    assert workflow.reduced_file(spark, root, "p70_0", "reduced_homology").endswith("p70_0/data_nr.csv")
    assert workflow.reduced_file(spark, root, "threshold_0.4", "reduced_distance").endswith("data_nr_labeled.csv")
    with pytest.raises(ValueError):
        workflow.reduction_levels(spark, f"{root}/none")


def test_joins_are_checked(spark):
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), spark.createDataFrame([(1, "c"), (1, "d")], "id int, y string")
    assert workflow.checked_join(two, one, "id", "many_to_one").count() == 2
    for left, right, how in ((one, two, "many_to_one"), (two, one, "one_to_one")):
        with pytest.raises(ValueError):
            workflow.checked_join(left, right, "id", how)


def test_runs_keep_folds_only_if_all_are_good(spark, tmp_path):
    good = spark.createDataFrame([(f"s{i}", i % 2) for i in range(600)], "id string, label int")
    status, folds = workflow.run_split(good, "s", "stratified_kfold", 1)
    assert status.first()["status"] == "kept" and folds.count() == 3000 and status.first()["reduction_levels"] == "no_threshold"
    assert {r.ok for r in workflow.compact(folds, good).collect()} == {True}
    assert False in {r.ok for r in workflow.compact(folds.where("id <> 's1'"), good).collect()}
    sinks.write_compact(folds, str(tmp_path / "folds"))
    assert spark.read.parquet(str(tmp_path / "folds")).groupBy("fold").count().count() == 5
    rare = spark.createDataFrame([(f"s{i}", int(i == 0)) for i in range(60)], "id string, label int")
    status, folds = workflow.run_split(rare, "s", "random_kfold", 1, "p70_0")
    assert status.first()["status"] == "invalid_split" and status.first()["reason"] and folds.count() == 0
    rows = spark.createDataFrame([("s", "a", 1, None, "no_threshold"), ("s", "a", 1, 90.0, "p90"), ("s", "a", 1, 70.0, "p70")], "scenario string, strategy string, seed int, parameter_value double, reduction_levels string")
    assert [r.reduction_levels for r in workflow.status_table(rows).collect()] == ["no_threshold", "p70", "p90"]


def test_representations_are_reused_if_they_fit(spark, tmp_path):
    sequences = spark.createDataFrame([("a",), ("b",)], "id string")
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "id string, vector array<float>")

    path = str(tmp_path / "rep")
    assert workflow.represented_again(spark, path, make, sequences).count() == 2
    assert workflow.represented_again(spark, path, make, sequences).count() == 2 and len(calls) == 1
    with pytest.raises(ValueError):
        workflow.represented_again(spark, path, make, sequences.unionAll(spark.createDataFrame([("c",)], "id string")))


def test_npy(spark, tmp_path):
    df = spark.createDataFrame([(f"s{i}", [float(i), 0.5]) for i in range(40)], "id string, v array<double>").repartition(3)
    files = sinks.write_npy(df, "id", "v", str(tmp_path / "npy")).collect()
    got = {}
    for f in files:
        ids = (tmp_path / "npy" / f"{f.file}.csv").read_text().split()[1:]
        got |= dict(zip(ids, np.load(tmp_path / "npy" / f"{f.file}.npy").tolist(), strict=True))
    assert got == {f"s{i}": [float(i), 0.5] for i in range(40)}


def test_resampling_is_the_same_however_it_is_dealt(spark):
    values = spark.createDataFrame([("d", i % 2, float(i % 7 + i % 2)) for i in range(60)] + [("one", 0, 1.0), ("d", 1, None)], "descriptor string, grp int, value double")
    one, two = (sorted(map(str, stats.compare_groups(v, n_perm=1200, n_boot=600).collect())) for v in (values, values.repartition(5)))
    assert one == two
    r = stats.compare_groups(values, n_perm=1200, n_boot=600).where("descriptor = 'd'").first()
    assert r.ci_low <= r.cliffs_delta <= r.ci_high and 0 <= r.p_value <= 1 and (r.n_a, r.n_b) == (30, 30)


def test_distribution_of_values_near_each_other(spark):
    """A narrow group is cut by its own values."""
    df = spark.createDataFrame([("wide", float(i * 1000)) for i in range(500)] + [("narrow", i / 1000) for i in range(500)], "g string, v double")
    got = stats.running_total(df, ["g"], "v", F.lit(1)).groupBy("g").agg(F.min("before"), F.max("before"), F.count_distinct("before")).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 499, 500)}


def test_exporter(spark, sf_dir, tmp_path, capsys):
    sinks.write_jsonl(spark.range(1).select(F.lit("sha256_x").alias("id"), F.lit("<b>").alias("sequence")), str(tmp_path / "cards"))
    assert export_card.main(["--cards", str(tmp_path / "cards"), "--id", "sha256_x"]) == 0
    assert json.loads(capsys.readouterr().out)["sequence"] == "<b>"
    assert export_card.main(["--cards", str(tmp_path / "cards"), "--id", "sha256_x", "--out", str(tmp_path / "out"), "--html"]) == 0
    assert "&lt;b&gt;" in (tmp_path / "out" / "sha256_x.html").read_text()
    assert export_card.main(["--cards", str(tmp_path / "cards"), "--sequence", "ACDEFGHIK"]) == 1
    with pytest.raises(SystemExit):
        export_card.main(["--cards", "x"])


def test_cards_hold_negative_evidence_and_targets(spark, sf_dir):
    card = measures.built(spark, sf_dir).where("negative_evidence is not null and toxicity_targets is not null").first().asDict(recursive=True)
    assert set(card["negative_evidence"]) <= {"supports_negative_status", "contributes_to_ambiguity"} <= set(cards.json_schema()["properties"]["negative_evidence"]["propertyNames"]["enum"])
    assert all(v == sorted(v) for v in card["toxicity_targets"].values())
    assert splits.registry(spark, ["a"], ["b"], [1], ["c"]).count() == 1
