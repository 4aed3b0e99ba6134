"""Discovered terms and fitted transforms against plain Python and numpy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bioactivity, similarity

TEXTS = [
    *["Receptor-binding domain of snake Venom, alpha-conotoxin"] * 15, *["receptor binding site"] * 15, *["frog dermatonecrotoxin"] * 9, *["dermatonecrotoxin (toxins)"] * 8, *["ANTI-VIRAL and anti viruses"] * 2,
    *["no lysozymes here; an unlisted mycin"] * 16, *["haemolytic amp. AMPs ampx"] * 3, "rare bacteriocin-like lectin", "", None,
]


@pytest.fixture(scope="module")
def described(spark):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "id int, description string, venom int")


def test_terms_are_counted_within_pieces(described):
    got = {r["term"]: r["n"] for r in bioactivity.terms(described, "description", known=["venom"]).collect()}
    counts = {}
    for t in TEXTS:
        for piece in re.split(r"[;,|()\[\]{}/]+", (t or "").lower()):
            w = re.findall(r"[a-z][a-z-]+", piece)
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    g = " ".join(w[i : i + n])
                    if g in bioactivity.KEYWORDS or g.endswith(bioactivity.SUFFIXES) or any(p in g for p in bioactivity.PARTS):
                        counts[g] = counts.get(g, 0) + 1
    assert got == {g: n for g, n in counts.items() if n >= 15 and g != "venom"}
    assert got["dermatonecrotoxin"] == 17 and "receptor binding site" in got and "bacteriocin-like lectin" not in got


def test_annotation(described):
    made = bioactivity.annotate(described, extra={"site": r"\bsite\b", "venom": r"poison"}, collapse=True)
    rows = {r["id"]: r.asDict() for r in made.collect()}
    at = TEXTS.index
    assert made.columns[:2] == ["id", "description"] and made.columns.count("venom") == 1
    a, b = rows[0], rows[at("receptor binding site")]
    assert a["venom"] == 0 and a["snake_venom"] == 1 and b["site"] == 1  # the extra expression takes the seed's place, and the table's column
    assert a["alpha_conotoxin"] == 1 and a["binding"] == b["binding"] == 1 and "receptor_binding" not in a
    assert rows[at("dermatonecrotoxin (toxins)")]["toxin"] == 1 and rows[at("frog dermatonecrotoxin")]["skin_related"] == 1
    assert rows[at("ANTI-VIRAL and anti viruses")]["antiviral"] == 1 and rows[at("ANTI-VIRAL and anti viruses")]["antimicrobial"] == 1
    assert rows[at("haemolytic amp. AMPs ampx")]["hemolytic"] == 1 and rows[at("haemolytic amp. AMPs ampx")]["antimicrobial"] == 1
    assert rows[at("no lysozymes here; an unlisted mycin")]["an_unlisted_mycin"] == 1
    for t in ("", None):
        assert {v for k, v in rows[at(t)].items() if k not in ("id", "description")} == {0}
    plain = bioactivity.annotate(described, least=10_000)
    assert set(plain.columns) == {"id", "description", *bioactivity.SEEDS} - {"enzyme_inhibitory"} and plain.first()["antimicrobial"] == 0
    with pytest.raises(KeyError):
        bioactivity.annotate(described.drop("description"))
    assert list(bioactivity.column_names(["a b", "a-b", "kinase"], ["kinase"])) == [("a_b", "a b"), ("auto_a_b", "a-b"), ("auto_kinase", "kinase")]


def yeo_johnson(x, p):
    out = np.empty_like(x)
    up = x >= 0
    out[up] = np.log1p(x[up]) if abs(p) < 1e-12 else ((x[up] + 1) ** p - 1) / p
    out[~up] = -np.log1p(-x[~up]) if abs(p - 2) < 1e-12 else -(((1 - x[~up]) ** (2 - p)) - 1) / (2 - p)
    return out


def test_powers(spark):
    rng = np.random.default_rng(1)
    data = {"a": np.exp(rng.normal(size=800)) - 1, "b": rng.normal(size=800) ** 3, "c": np.full(800, 2.0), "d": -np.exp(rng.normal(size=800) * 0.5) * 5}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values(), strict=True)] + [(None,) * 4], "a double, b double, c double, d double")
    fitted = similarity.fit_power(df, list(data))
    for name in "abd":
        x, (power, mean, deviation) = data[name], fitted[name]
        score = lambda p, x=x: -0.5 * np.log(yeo_johnson(x, p).var()) + (p - 1) * (np.sign(x) * np.log1p(abs(x))).mean()
        grid = np.linspace(-5, 7, 12001)
        assert abs(power - max(grid, key=score)) < 2e-3
        assert mean == pytest.approx(yeo_johnson(x, power).mean()) and deviation == pytest.approx(yeo_johnson(x, power).std())
    assert fitted["c"][0] == 1.0 and fitted["c"][2] == 1.0
    out = similarity.transform_power(df, fitted).agg(*(f(c) for c in "abd" for f in (F.avg, F.stddev_pop))).first()
    assert np.allclose(out, [0, 1] * 3, atol=1e-6)
    for p in (-1.0, 0.0, 0.5, 2.0, 3.0):
        got = [r[0] for r in df.select(similarity.yeo_johnson(F.col("b"), p)).collect()]
        assert np.allclose(got[:-1], yeo_johnson(data["b"], p)) and got[-1] is None


def test_quantiles(spark):
    x = [1.0, 1.0, 1.0, 2.0, 4.0, 8.0, 8.0, 16.0]
    df = spark.createDataFrame([(v,) for v in [*x, None, float("nan")]], "x double")
    marks = similarity.fit_quantile(df, "x", 5)
    assert np.allclose(marks, np.quantile(x, np.linspace(0, 1, 5)))
    many = np.random.default_rng(2).normal(size=3000).round(2)
    big = spark.createDataFrame([(float(v),) for v in many], "x double")
    assert np.allclose(similarity.fit_quantile(big, "x", 101), np.quantile(many, np.linspace(0, 1, 101)))
    asked = spark.createDataFrame([(v,) for v in (-5.0, 1.0, 3.0, 100.0, None)], "x double")
    got = [r["x"] for r in similarity.transform_quantile(asked, "x", marks).collect()]
    assert got[0] == 0 and got[3] == 1 and got[4] is None and got[1] == pytest.approx(0.125) and got[2] == pytest.approx(0.5)
    assert similarity.fit_quantile(df.limit(0), "x") == []


def test_flags_as_rows_need_no_columns(described, monkeypatch):
    odd = [(100, "receptor-\nbinding  site, Kınase of fRog-dermatonecrotoxinx", 7), (101, "alphaconotoxin domainofsnakevenom; domain of snake venom", 7)]
    df = described.unionAll(described.sparkSession.createDataFrame(odd, described.schema))
    made = bioactivity.annotate(df, collapse=True)
    want = {(r["id"], c) for r in made.collect() for c in made.columns if c not in ("id", "description") and r[c] == 1}
    monkeypatch.setattr(bioactivity, "COLUMNS", 0)  # no number of terms is too large
    got = [(r["id"], r["flag"]) for r in bioactivity.flagged(df.drop("venom"), "id", collapse=True).collect()]
    assert len(got) == len(set(got)) and {g for g in got if g[1] != "venom"} == {w for w in want if w[1] != "venom"}
    assert (101, "of_snake_venom") in got and (101, "alpha_conotoxin") not in got
