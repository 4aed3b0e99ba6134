"""Golden cases of the column functions and operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import activity, labels, names, sequences
from tessera.operators import bioactivity, cards, dedup, hierarchy, similarity, splits, stats


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, want", [("  acdef ghik \n", "ACDEFGHIK"), (" \t", None), (None, None), ("ACX", "ACX")])
def test_normalize(spark, raw, want):
    assert one(spark, raw, sequences.normalize_sequence) == want


@pytest.mark.parametrize("seq, want", [("ACDEFGHIK", "sha256_c729ebc224388368ab8c8df88487ef137ad8bd5097651cf67c37bda5622c9f9a"), ("IKVAV", "sha256_91fb7a0d6adcc22cd7daa835e232d68396ce617bc9a5b89cb9c1210c2c9fea3b")])
def test_identity(spark, seq, want):
    assert one(spark, seq, sequences.sequence_id) == want
    assert one(spark, want, sequences.is_sequence_id)


@pytest.mark.parametrize("seq, want", [(None, "missing"), ("ACDE", "length"), ("A" * 71, "length"), ("ACDEX", "noncanonical"), ("ACDEF\n", "noncanonical"), ("ACDEF", "pass"), ("A" * 70, "pass")])
def test_qc(spark, seq, want):
    assert one(spark, seq, sequences.qc_reason) == want


@pytest.mark.parametrize("f, want", [(0.27, "20-30"), (0.75, "70-80"), (0.9, "90-100"), (1.0, "90-100"), (0.0, "0-10"), (None, "999")])
def test_support_bin(spark, f, want):
    assert one(spark, f, labels.support_bin, "double") == want


@pytest.mark.parametrize("p, want", [(90.0, "80-90"), (90.1, ">90"), (10.0, ">0"), (0.0, ">0"), (None, ">0"), (10.5, "10-20")])
def test_consensus_bin(spark, p, want):
    assert one(spark, p, labels.consensus_bin, "double") == want


def test_states(spark):
    with pytest.raises(Exception, match="unknown state"):
        spark.createDataFrame([("odd",)], "v string").select(labels.encode_state(F.col("v"))).collect()
    assert one(spark, "ambiguous", labels.encode_state) == 2 and one(spark, 3, labels.decode_state, "int") == "unlabeled"
    assert one(spark, " Yes ", labels.parse_boolean) is True and one(spark, None, labels.parse_boolean) is False
    assert one(spark, "cytolytic", labels.harmonise_endpoint) == "cytolysis" and one(spark, "toxic", labels.harmonise_endpoint) == "toxic"


@pytest.mark.parametrize(
    "text, want, label",
    [
        ("HC50 = 1.4 ± 0.2 uM", ("HC50", "=", 1.4, 0.2, "µM"), "1.4 ± 0.2"),
        ("LD50 ≥ 2,5 x 10^-3 mg/ml", ("LD50", ">=", 0.0025, None, "mg/mL"), ">= 0.0025"),
        ("MHC > 100 ug/ml [5]", ("MHC", ">", 100.0, 5.0, "µg/mL"), "> 100 ± 5"),
        ("LD50 unknown", ("LD50", None, None, None, None), None),
        (None, (None, None, None, None, None), None),
    ],
)
def test_activities(spark, text, want, label):
    r = one(spark, text, activity.parse_activity)
    assert (r.type, r.relation, r.error, r.unit) == (want[0], want[1], want[3], want[4])
    assert r.value == pytest.approx(want[2]) if want[2] is not None else r.value is None
    df = spark.createDataFrame([(r.relation, r.value, r.error)], "r string, v double, e double")
    assert df.select(F.when(F.col("v").isNotNull(), activity.measurement_label(F.col("r"), F.col("v"), F.col("e"))).alias("l")).first()["l"] == label
    if label:
        p = one(spark, label, activity.parse_label)
        assert (p.relation, p.value, p.error) == (want[1], pytest.approx(want[2]), want[3])


@pytest.mark.parametrize("x", [25.0, 1e-05, 1234567.0, 0.0001, 100000.0, 999999.5, 0.0, -2.5, 1e300, 123.456])
def test_general_format(spark, x):
    assert one(spark, x, activity.general_format, "double") == f"{x:g}"


@pytest.mark.parametrize("x", [0.1234565, 2.000005, 1.234565e-7, 8.123455e12, 1000.005, 0.5, 1e6, None, float("nan"), float("-inf")])
def test_general_format_rounds_the_binary_value(spark, x):
    """What ends in a five at the seventh digit lies above or below the middle by its bits alone."""
    assert one(spark, x, activity.general_format, "double") == (None if x is None else f"{x:g}")


def test_names(spark):
    assert one(spark, " Anti-Mammalian  cells ", names.endpoint_key) == "anti_mammalian_cells"
    assert one(spark, "fooBar baz-Qux", names.snake_case) == "foo_bar_baz_qux"
    assert one(spark, "b, a,999, No Information ,a", names.meaningful_targets) == ["a", "b"]
    assert [one(spark, v, names.threshold_parameter) for v in ("p70_0", "threshold_0.7", "minseqid_0_7", "no_threshold")] == [70.0, 0.7, 0.7, None]
    parts = ["p10", "p9", "p9a", "a100", "a20"]
    df = spark.createDataFrame([(p,) for p in parts], "v string")
    assert [r.v for r in df.orderBy(names.natural_key(F.col("v"))).collect()] == ["a20", "a100", "p9", "p9a", "p10"]


def test_duplicate_families(spark):
    rows = [("A", 1), ("B", 1), ("B", None), ("C", 0), ("C", 1), ("D", 1), ("D", 1), ("D", None), (None, 1), ("E", 0), ("E", 0)]
    collapsed, errors, unique = dedup.resolve(spark.createDataFrame(rows, "key string, label int"), ["key"])
    assert sorted((r.key, str(r.label)) for r in unique.collect()) == [("A", "1"), ("B", "1"), ("B", "None")]
    assert sorted(r.key for r in errors.collect()) == ["C", "D"] and [tuple(r) for r in collapsed.collect()] == [("E", 0)]


HIERARCHY = [
    ({"hemolytic": "positive"}, "cytotoxic", ("positive", "hemolytic", "hierarchy")),
    ({"hemolytic": "positive"}, "toxic", ("positive", "cytotoxic", "hierarchy")),
    ({"hemolytic": "positive", "cytotoxic": "ambiguous"}, "cytotoxic", ("ambiguous", "hemolytic", "direct_ambiguous_hierarchy_blocked")),
    ({"hemolytic": "positive", "cytotoxic": "ambiguous"}, "toxic", ("positive", "cytotoxic", "hierarchy")),
    ({"neurotoxic": "positive", "toxic": "negative"}, "toxic", ("positive", "neurotoxic", "direct_and_hierarchy")),
    ({"toxic": "positive", "embryotoxic": "positive"}, "toxic", ("positive", "embryotoxic", "direct_and_hierarchy")),
    ({"cytotoxic": "negative"}, "cytotoxic", ("negative", "", "direct")),
    ({"cytotoxic": "negative"}, "toxic", ("no_information", "", "no_information")),
    ({"hemolytic": "ambiguous"}, "cytotoxic", ("no_information", "", "no_information")),
    ({"hemolytic": "positive", "anti_mammalian_cells": "positive"}, "cytotoxic", ("positive", "hemolytic|anti_mammalian_cells", "hierarchy")),
    ({"toxic": "unlabeled", "ichthyotoxic": "positive"}, "toxic", ("positive", "ichthyotoxic", "direct_and_hierarchy")),
]


def test_hierarchy(spark):
    rows = [(f"S{i}", e, s) for i, (states, _, _) in enumerate(HIERARCHY) for e, s in states.items()]
    direct = spark.createDataFrame(rows, "sequence string, endpoint string, status_before_hierarchy string")
    got = {(r.sequence, r.endpoint): (r.status, r.hierarchy_source, r.status_origin) for r in hierarchy.long_states(hierarchy.propagate(hierarchy.wide_states(direct))).collect()}
    for i, (_, endpoint, want) in enumerate(HIERARCHY):
        assert got[f"S{i}", endpoint] == want


def test_bh(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None)], "i int, p_value double")
    q = {r.i: r.q_value for r in stats.adjust_bh(df).collect()}
    assert [q[i] for i in range(3)] == pytest.approx([0.03, 0.04, 0.04]) and q[3] is None


def test_rank_statistics_against_pairs(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, 40).tolist(), rng.integers(2, 11, 30).tolist()
    df = spark.createDataFrame([("d", 0, float(v)) for v in x] + [("d", 1, float(v)) for v in y], "d string, g int, v double")
    r = stats.effect_sizes(stats.rank_sums(df, "g", "v", ["d"])).first()
    want = sum((a > b) - (a < b) for a in x for b in y) / (len(x) * len(y))
    assert r.cliffs_delta == pytest.approx(want) and stats.delta(np.array(x), np.array(y)) == pytest.approx(want)
    assert r.vargha_delaney == pytest.approx((want + 1) / 2)


def test_group_comparison_is_stable(spark):
    df = spark.createDataFrame([(d, g, float(v + g * (d == "far") * 10)) for d in ("far", "near") for g in (0, 1) for v in range(30)], "descriptor string, grp int, value double")
    a = {r.descriptor: r for r in stats.compare_groups(df, n_perm=200, n_boot=50).collect()}
    b = {r.descriptor: r for r in stats.compare_groups(df.repartition(3), n_perm=200, n_boot=50).collect()}
    assert a == b and a["far"].p_value < 0.05 < a["near"].p_value and a["far"].selected and not a["near"].selected
    assert a["far"].ci_low <= a["far"].cliffs_delta <= a["far"].ci_high


def test_folds(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    f = splits.kfold(df, seed=3, stratified=True)
    assert f.count() == 1003 and f.select("id").distinct().count() == 1003
    for label in (0, 1):
        sizes = [r["count"] for r in f.where(f"label = {label}").groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert {(r.id, r.fold) for r in f.collect()} == {(r.id, r.fold) for r in splits.kfold(df.repartition(5), seed=3, stratified=True).collect()}
    assert {(r.id, r.fold) for r in f.collect()} != {(r.id, r.fold) for r in splits.kfold(df, seed=4, stratified=True).collect()}
    assert splits.validate(splits.assignments(f)).where("not ok").count() == 0
    assert splits.precheck(df.where("label = 0"), 5, True).first().ok is False


def test_cosine_blocks(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(50, 8))
    df = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(m)], "k long, v array<double>, l int")
    got = {(r.a, r.b): (r.cosine, r.same_label) for r in similarity.cosine_pairs(df, "k", "v", "l", block=16).collect()}
    assert len(got) == 50 * 49 // 2
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert all(abs(c - n[a] @ n[b]) < 1e-9 and s == (a % 3 == b % 3) for (a, b), (c, s) in got.items())


def test_pca(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(80, 5)) * [5, 3, 1, 1, 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "k long, v array<double>")
    got = np.array([r.components for r in similarity.pca(df, "k", "v").orderBy("k").collect()])
    u, s, _ = np.linalg.svd(m - m.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :2]), atol=1e-6)


def test_tokens_and_flags(spark):
    df = spark.createDataFrame([("Anti-bacterial peptide, hemolytic",), ("hemolytic peptide",), (None,), ("",)], "t string")
    tokens = {r.token: r.n_rows for r in bioactivity.token_mining(df, "t").collect()}
    assert tokens == {"hemolytic": 2, "peptide": 2}
    f = bioactivity.flags(F.col("t"), extra={"pep": "peptide"})
    assert df.select(f["hemolytic"].alias("h"), f["antibacterial"].alias("a"), f["pep"].alias("p")).collect()[0] == (1, 1, 1)


def test_card_schema_and_page():
    assert "activity_summary" in cards.json_schema()["properties"]
    assert "&lt;b&gt;" in cards.export_html({"id": "<b>"})


@pytest.mark.parametrize("how", ["standard", "minmax", "maxabs", "l1", "l2", "max"])
def test_scalers(spark, how):
    m = np.array([[1.0, 4.0], [2.0, -5.0], [3.0, 0.0]])
    want = {"standard": (m - m.mean(0)) / m.std(0), "minmax": (m - m.min(0)) / (m.max(0) - m.min(0)), "maxabs": m / np.abs(m).max(0), "l1": m / np.abs(m).sum(1, keepdims=True), "l2": m / np.linalg.norm(m, axis=1, keepdims=True), "max": m / np.abs(m).max(1, keepdims=True)}[how]
    got = similarity.scale(spark.createDataFrame(m.tolist(), "a double, b double"), ["a", "b"], how).collect()
    assert np.allclose(sorted(map(tuple, got)), sorted(map(tuple, want)))
