"""Grams of words against a plain count."""

from collections import Counter

import numpy as np

from tessera.operators import bioactivity


def test_grams_are_counted_by_numbers_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    letters = ["a", "bb", "ccc", "été", "ж", "ß"]
    texts = [" ".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(200)] + [None, "", " - ", "a", "1a2A3 a", "bb, bb; bb bb"]
    want = Counter()
    for t in texts:
        w = [x for x in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split(" ") if x]
        want.update({" ".join(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1)})
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    for size in (1 << 20, 50, 1):
        monkeypatch.setattr(bioactivity, "SLICE", size)
        monkeypatch.setattr(bioactivity, "ROWS", 7 if size == 50 else 1 << 16)
        out = bioactivity.token_mining(df, "t", least=1, most=4)
        assert {r.token: r.n_rows for r in out.collect()} == want
    assert {r.token for r in bioactivity.token_mining(df, "t", least=90).collect()} == {k for k, n in want.items() if n >= 90 and k.count(" ") < 3}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "array_join" not in plan, "no text is put together for each occurrence"
