import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import jaccard, simhash
from tessera.llm.components import connected_components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=4):
    root = {i: i for i in range(len(prints))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_edges(edge):
    rows = [(r.doc_id, r.f0 % (1 << 64), r.component_id) for r in simhash.near_duplicates(edge).collect()]
    given = [(r.doc_id, r.text) for r in edge.collect()]
    assert sorted((str(d), f) for d, f, _ in rows) == sorted((str(d), brute_print(t)) for d, t in given)
    by_id = {d: c for d, _, c in rows}
    assert by_id[1] == by_id[2] == 1
    assert by_id[3] == by_id[4] == by_id[5] == 3
    assert by_id[None] is None


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each(empty).count() == 0


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(3, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    prints = [brute_print(t) for t in texts]
    groups = brute_components(prints)
    want = {i: min(j for j, g in enumerate(groups) if g == groups[i]) for i in range(len(texts))}
    assert got == want


def test_links_lose_nothing_in_large_and_cut_cells(spark, monkeypatch):
    """Random walks of fingerprints, with small limits so that cells are cut into chunks."""
    monkeypatch.setattr(simhash, "HOT", 16)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(1)
    prints = [int(rng.integers(0, 1 << 63))]
    for _ in range(199):
        x = prints[int(rng.integers(0, len(prints)))]
        for b in rng.choice(64, int(rng.integers(1, 8)), replace=False):
            x ^= 1 << int(b)
        prints.append(x)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(s, s) for s in signed], "node long, f0 long")
    roots = {r.node: r.root for r in connected_components(simhash.links(nodes)).collect()}
    groups = brute_components(prints)
    mine = [roots.get(s, s) for s in signed]
    assert [[a == b for b in groups] for a in groups] == [[a == b for b in mine] for a in mine]


def test_embedding_is_a_lower_bound(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 63), (1 << 63) - 1, 50)
    df = spark.createDataFrame([(int(v),) for v in x], "f long").select("f", simhash.embedding(F.col("f")).alias("e"))
    for r in df.collect():
        f, e = r.f % (1 << 64), r.e % (1 << 64)
        assert all((e >> 2 * s & 3) == (f >> 2 * s & 3).bit_count() for s in range(32))


def test_near_copies_with_sampled_grids(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(2000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(200)]
        near = list(base)
        for _ in range(3):
            near[rng.randrange(200)] = rng.choice(words)
        texts += [" ".join(base), " ".join(near)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, size=5, lanes=4, radius=42, tables=48).collect()}
    found = sum(got[2 * i] == got[2 * i + 1] for i in range(40))
    assert found >= 38
    assert len({got[2 * i] for i in range(40)}) == 40


def test_one_of_each_keeps_one_row_of_repeats(edge):
    kept = simhash.one_of_each(edge).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "6", "7", "8", "None"]


@pytest.mark.parametrize("finder", [simhash.grouped, jaccard.grouped])
def test_one_of_each_loses_no_text(spark, clashing, finder):
    """Different texts under one doc_id or under none all stay; of equal texts the smallest doc_id does; other columns stay as they are."""
    said = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(1, said(0)), (5, said(1)), (5, said(2)), (5, said(0)), (None, said(3)), (None, said(4)), (None, said(1)), (None, said(3))]
    docs = clashing(rows)
    kept = simhash.one_of_each(docs, finder)
    assert kept.columns == docs.columns
    want = [r for r in docs.collect() if (r["doc_id"], r["text"]) in {(1, said(0)), (5, said(1)), (5, said(2)), (None, said(3)), (None, said(4))}]
    got = sorted(map(str, kept.collect()))
    assert len(got) == 5 and set(got) <= set(map(str, want)) and len({(r["doc_id"], r["text"]) for r in kept.collect()}) == 5
    assert got == sorted(map(str, simhash.one_of_each(docs.repartition(3), finder).collect())), "reruns agree"


def test_components_of_stars_and_chains(spark):
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[100 + i] == 100 for i in range(41)) and len(got) == 101


def test_two_level_grid_finds_pairs_at_the_mean_distance_and_cuts_full_cells(spark):
    """100 pairs that differ in 15 % of 256 bits among 3,000 others; with room for 400 nodes in a cell, cells are cut and the same pairs are found."""
    rng = np.random.default_rng(5)
    f = rng.integers(0, 1 << 64, (3200, 4), dtype=np.uint64)
    f[100:200] = f[:100] ^ np.packbits(rng.random((100, 256)) < 0.15, axis=1).view(np.uint64)
    near = np.bitwise_count(f[:100] ^ f[100:200]).sum(1) <= 60
    rows = [(i, *map(int, x)) for i, x in enumerate(f.view(np.int64))]
    nodes = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long")
    for room in (1 << 20, 400):
        groups = {}
        for r in simhash.buckets(nodes, 4, 60, simhash.agreement(0.15), room=room).collect():
            groups.setdefault(r.key, set()).add(r.node)
        together = {tuple(sorted(g)) for g in groups.values()}
        assert together == {(i, i + 100) for i in range(100) if near[i]}


def test_the_pipelines_candidates_come_from_the_grid(spark, monkeypatch):
    """Without the grid's buckets only equal sets are linked, so no other path proposes pairs."""
    words = [f"w{i}" for i in range(204)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x", *words[1:]])), (3, " ".join(words))], "doc_id long, text string")
    assert {r.component_id for r in jaccard.near_duplicates(df).collect()} == {1}
    monkeypatch.setattr(jaccard, "buckets", lambda nodes, *_: nodes.selectExpr("node as key", "node", "1L as members").limit(0))
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}
