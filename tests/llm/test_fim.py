import hashlib

import numpy as np
import pytest

from tessera.llm import fim
from pyspark.sql import functions as F


def by_hand(doc_id, text):
    """The contract, character by character."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["", "a", "one two\nthree", "Grüße 😀 naïve", "has <P> in it", "<S", "S><", "a<", "<M", ">><<P<S<M", "<P>", "x" * 200, "word " * 50_000]


def test_against_the_contract(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(400)]
    made = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: tuple(r)[1:] for r in made.collect()}
    assert got == {i: by_hand(i, t) for i, t in rows}
    assert {g[1] for g in got.values()} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fim.restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert {r["doc_id"]: r["text"] for r in back} == dict(rows)


def test_tables(edge, empty, clashing):
    rows = fim.digests(fim.transform(edge)).collect()
    want = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in edge.collect())
    assert sorted(r["restored_sha256"] for r in rows) == want
    assert fim.transform(empty).count() == 0
    assert fim.transform(clashing([(1, "a b"), (None, None)])).count() == 2


@pytest.mark.parametrize(("unit", "want"), [("char", [0, 1, 2, 3, 4, 5, 6, 7]), ("word", [0, 2, 4, 6, 7]), ("line", [0, 4, 7])])
def test_units(unit, want):
    assert fim.bounds(np.array([ord(c) for c in "ab \ncd\n"], np.uint32), unit).tolist() == want
    assert fim.bounds(np.array([], np.uint32), unit).tolist() == [0]


@pytest.mark.parametrize("unit", ["word", "line"])
def test_pieces_of_other_units_are_whole(spark, unit):
    rows = [(i, "some words  here\nand there\n\nthe end " * (i % 5)) for i in range(100)]
    made = fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), unit=unit, plain=0).collect()
    for r in made:
        if r["form"] != "plain":
            ends = fim.bounds(np.array([ord(c) for c in rows[r["doc_id"]][1]], np.uint32), unit).tolist()
            assert r["prefix_chars"] in ends and r["prefix_chars"] + r["middle_chars"] in ends
    with pytest.raises(ValueError):
        fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), unit="page")
