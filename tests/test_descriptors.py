"""Encodings and descriptors against numpy, worked examples and edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import descriptors as desc

SEQUENCES = ["GIGKFLHSAKKFGKAFVGEIMNS", "ACDEFGHIKLMNPQRSTVWY", "K", "AXB", "", None, "W" * 400]


@pytest.fixture(scope="module")
def sequences(spark):
    return spark.createDataFrame(list(enumerate(SEQUENCES)), "id long, sequence string")


def test_spectrum_is_the_transform(sequences):
    values = desc.scale("KYTJ820101")
    for width, n in ((23, 32), (64, 64), (100, 128)):
        got = {r[0]: r[1] for r in sequences.select("id", desc.spectrum(F.col("sequence"), width, values)).collect()}
        for i, s in enumerate(SEQUENCES):
            x = [values.get(c, 0.0) for c in (s or "")[:width]]
            want = np.abs(np.fft.fft(np.array(x + [0.0] * (n - len(x)))))[: n // 2]
            assert np.allclose(got[i], want, atol=1e-9)


def test_fixed_widths(sequences):
    values = desc.scale("ANDN920101")
    rows = sequences.select("sequence", desc.physicochemical(F.col("sequence"), 30, values).alias("x"), desc.frequency(F.col("sequence")).alias("f")).collect()
    for r in rows:
        s = r["sequence"] or ""
        assert list(r["x"]) == ([values.get(c, 0.0) for c in s] + [0.0] * 30)[:30]
        assert math.isclose(sum(r["f"]), sum(c in "ACDEFGHIKLMNPQRSTVWY" for c in s) / max(1, len(s)), abs_tol=1e-12)


def test_descriptors(sequences):
    rows = {r["id"]: r.asDict() for r in desc.describe_sequences(sequences, "id", "sequence", dipeptides={"GI": 2.0, "WW": 1.0}).collect()}
    first = rows[0]  # magainin 2
    assert first["length"] == 23 and abs(first["molecular_weight"] - 2466.9) < 0.1
    assert first["net_charge_pH"] > 3 and first["isoelectric_point"] > 9.5 and first["ncpr"] == pytest.approx(first["net_charge_pH"] / 23)
    assert first["aliphatic_index"] == pytest.approx((100 * 2 + 290 * 1 + 390 * 3) / 23) and first["extinction"] == 0
    assert first["dipeptide_index"] == pytest.approx(10 / 23 * 2)
    h = np.array([desc.EISENBERG[c] for c in SEQUENCES[0]])
    turns = np.exp(1j * np.radians(100.0) * np.arange(23))
    assert first["hydrophobic_moment"] == pytest.approx(max(abs((h[i : i + 11] * turns[i : i + 11]).sum()) / 11 for i in range(13)))
    k = np.array([desc.scale("KYTJ820101")[c] for c in SEQUENCES[0]])
    assert first["autocorrelation_3"] == pytest.approx((k[:-3] * k[3:]).mean())
    assert sum(first[f"composition_{i}"] for i in (1, 2, 3)) == pytest.approx(1) and first["distribution_2_100"] == 100.0 and first["distribution_3_0"] == pytest.approx(200 / 23)
    assert rows[1]["aa_entropy"] == pytest.approx(math.log2(20)) and rows[1]["extinction"] == 5500 + 1490
    assert rows[2]["autocorrelation_1"] is None and rows[2]["transition_12"] is None and rows[2]["dipeptide_index"] == 0
    for i in (4, 5):
        assert rows[i]["length"] == 0 and {v for c, v in rows[i].items() if c not in ("id", "length")} == {None}
    assert rows[3]["length"] == 3 and rows[3]["tiny"] == pytest.approx(1 / 3) and len(first) >= 42


def test_no_charge_at_the_isoelectric_point(sequences):
    points = {r["id"]: r["isoelectric_point"] for r in desc.describe_sequences(sequences, "id", "sequence").collect()}
    for i in (0, 1, 2):
        again = desc.describe_sequences(sequences.where(F.col("id") == i), "id", "sequence", ph=points[i]).first()
        assert abs(again["net_charge_pH"]) < 1e-6


def test_costly_parts_are_worked_out_once(spark):
    """A spectrum's letters and a step's charge: an expression used twice inside a lambda is evaluated twice."""
    text = str(desc.spectrum(F.col("s"), 70, desc.scale("ANDN920101")))
    assert text.count("split(s") == 1
    text = str(desc.isoelectric_point({r: F.col(f"n_{r}") for r in desc.RESIDUES}))
    assert text.count("n_K") == 1
