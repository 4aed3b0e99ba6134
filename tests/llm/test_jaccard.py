import random

import corpus_pipeline
from tessera.llm import jaccard


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def planted(low, high, pairs, seed):
    """Pairs of texts whose similarity lies in [low, high)."""
    rng = random.Random(seed)
    out = []
    while len(out) < pairs:
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        near = list(base)
        for i in rng.sample(range(204), rng.randint(2, 10)):
            near[i] = f"x{rng.randrange(10**6)}"
        one, two = " ".join(base), " ".join(near)
        if low <= similarity(one, two) < high:
            out.append((one, two))
    return out


def kept(spark, pairs):
    rows = [(2 * i + k, t, "s") for i, p in enumerate(pairs) for k, t in enumerate(p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}


def test_pairs_at_and_above_the_threshold_are_found_and_those_below_stay(spark):
    high, low = planted(0.8, 0.85, 100, 1), planted(0.65, 0.75, 100, 2)
    ids = kept(spark, high + low)
    lost = sum(2 * i + 1 in ids for i in range(100))
    assert lost == 0, f"{lost} of 100 pairs of 0.80 to 0.85 aren't linked"
    gone = sum(2 * i not in ids or 2 * i + 1 not in ids for i in range(100, 200))
    assert gone == 0, f"{gone} of 100 pairs of 0.65 to 0.75 are linked"


def test_groups_against_brute_force(spark):
    """Families whose members lie on both sides of the threshold, so chains leave pairs to try."""
    rng = random.Random(7)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(25):
            copy = list(base)
            for i in rng.sample(range(150), rng.randint(0, 4)):
                copy[i] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                one, two = find(i), find(j)
                root[max(one, two)] = min(one, two)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == {i: find(i) for i in range(len(texts))}


def test_edges(edge, empty):
    by_id = {r.doc_id: r.component_id for r in jaccard.near_duplicates(edge).collect()}
    assert by_id[1] == by_id[2] == 1
    assert by_id[3] == by_id[4] == by_id[5] == 3
    assert by_id[None] is None
    assert jaccard.near_duplicates(empty).count() == 0
