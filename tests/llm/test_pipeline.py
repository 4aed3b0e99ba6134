"""The pipeline against a brute-force version, on a small fixture with planted cases."""

import hashlib
import random
import zlib

import numpy as np
import xxhash

import corpus_pipeline
from tessera.llm import decontam, mixing, simhash
from tests.llm.test_decontam import edit_distance
from tests.llm.test_jaccard import similarity
from tests.llm.test_quality import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def planted(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(words(30))) for i in range(5)]
    texts = {}
    for i in range(60):
        texts[i] = words(rng.randint(60, 200))
    for i in range(10):  # exact copies
        texts[100 + i] = list(texts[i])
    for i in range(10):  # near copies
        texts[200 + i] = list(texts[10 + i])
        texts[200 + i][5] = "changed"
    for i in range(5):  # leaks, one with an edit
        texts[300 + i] = words(50) + items[i][1].replace("e", "x", i % 2).split() + words(50)
    texts[400] = words(5)
    texts[401] = words(6) * 20
    rows = [(i, " ".join(t), "en", f"src{i % 4}", 0) for i, t in texts.items()]
    return rows + [(500, None, None, None, None), (501, "", "en", "src0", 0)], items


def near_groups(rows):
    """The smallest id reachable over pairs whose sets of five-word shingles have a similarity of 0.8."""
    root = {}
    for i, t in sorted((r[0], r[1]) for r in rows):
        root[i] = next((root[j] for j, u in sorted((r[0], r[1]) for r in rows if r[0] < i) if similarity(t, u) >= 0.8), i)
    return root


def brute_mix(rows, weights=(5, 2, 1)):
    """Times that each id is taken: queues in order of a hash of the id, virtual finish times, budget."""
    size = {i: len(t.split()) for i, t, *_ in rows}
    total = {}
    for i, _, _, s, _ in rows:
        total[s] = total.get(s, 0) + size[i]
    left, target, budget = sorted(total, key=lambda s: (s is None, s)), {}, 1.5 * sum(total.values())
    weight = {s: weights[k % 3] for k, s in enumerate(left)}
    while left:
        rate = (budget - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * rate > 2 * total[s]]
        target |= {s: 2.0 * total[s] for s in over} if over else {s: weight[s] * rate for s in left}
        left = [s for s in left if s not in over] if over else []
    place = {i: int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:15], 16) for i in size}
    entries = []
    for s in total:
        ids, upto = sorted((i for i, _, _, x, _ in rows if x == s), key=place.get), 0
        for turn in range(2):
            for i in ids:
                upto += size[i]
                entries.append((upto / target[s], s, place[i], i, turn))
    times, used = {}, 0
    for _, _, _, i, _ in sorted(entries):
        used += size[i]
        if used > sum(target.values()):
            break
        times[i] = times.get(i, 0) + 1
    return times


def rendezvous(i, n):
    return max(range(n), key=lambda s: int(hashlib.md5(f"{i}:{s}".encode()).hexdigest()[:13], 16))


def test_against_brute_force(spark, tmp_path):
    rows, items = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), "stage")
        after.append(docs)
    assert all(d.columns == COLUMNS for d in after[:-1])
    good = [r for r in rows if not brute(r[1])[5]]
    assert sorted(r.doc_id for r in after[0].collect()) == sorted(r[0] for r in good)
    root = near_groups(good)
    assert {i: root[i] for i in root if i >= 100 and i < 300} == {**{100 + i: i for i in range(10)}, **{200 + i: 10 + i for i in range(10)}}
    unique = [r for r in good if root[r[0]] == r[0]]
    assert sorted(map(tuple, after[1].collect())) == sorted(unique)
    leak = lambda t: any(edit_distance(decontam.normal(x), decontam.normal(t)) <= len(decontam.normal(x)) * 8 // 100 for _, x in items)
    clean = [r for r in unique if not leak(r[1])]
    assert len(unique) - len(clean) == 5
    assert sorted(map(tuple, after[2].collect())) == sorted(clean)
    times = brute_mix(clean)
    assert sorted(map(tuple, after[3].collect())) == sorted(r for r in clean for _ in range(times.get(r[0], 0)))
    final = after[4].collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in final) == sorted(map(tuple, after[3].collect()))
    by = {}
    for r in final:
        by.setdefault(r.shard, []).append(r.slot)
        assert (r.shard, r.grown_shard) == (rendezvous(r.doc_id, 40), rendezvous(r.doc_id, 41))
        assert (r["size"], r.text_crc32) == (len(r.text.encode()) + 16, zlib.crc32(r.text.encode()))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted((r.doc_id, r.slot) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.slot) for r in final), "reruns agree"


def test_stages_take_edge_rows_and_clashing_names(spark, tmp_path, clashing):
    """Nulls, empty and long texts, rows of one id with different texts, equal rows, and columns called like the stages' own."""
    said = lambda i, n=40: " ".join(f"w{i}x{k}" for k in range(n))
    item = said(900)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(1, said(0)), (5, said(1)), (5, said(2)), (5, said(0)), (None, said(3)), (None, said(4)), (None, said(3)), (3, None), (4, ""), (6, said(5, 30000)), (7, said(6) + " " + item), (8, "too short")]
    docs = clashing([(i, t, None if i == 6 else "s") for i, t in texts] + [(9, said(7), None)])
    same = docs.unionAll(docs.where("doc_id = 9"))
    table = lambda df: sorted(map(str, df.collect()))
    quality, near, leaks, mix, deal = (f for _, f in corpus_pipeline.STAGES)
    good = same.where("length(text) > 9")
    assert table(quality(spark, same, "")) == table(good)
    once = near(spark, good, "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in once) == sorted((str(i), t) for i, t in {(1, said(0)), (5, said(1)), (5, said(2)), (None, said(3)), (None, said(4)), (6, said(5, 30000)), (7, said(6) + " " + item), (9, said(7))})
    assert set(map(str, once)) <= set(table(good))
    assert table(leaks(spark, same, str(tmp_path))) == table(same.where("doc_id is null or doc_id <> 7"))
    mixed = table(mix(spark, same, ""))
    assert set(mixed) <= set(table(same)) and mixed == table(mix(spark, same.repartition(5), "")), "reruns agree"
    sizes = {str(r): len((r["text"] or "").split()) for r in same.collect()}
    taken = mixing.mix(same).agg({"taken": "sum"}).first()[0]
    assert sum(sizes[r] for r in mixed) == taken > 0
    out = deal(spark, same, "")
    assert [c for c in out.columns if c in same.columns] and len({c.lower() for c in out.columns}) == len(out.columns)
    stay = [c for c in same.columns if c.lower() not in ("key_text", "size", "text_crc32", "shard", "grown_shard", "slot")]
    assert table(out.select(*(f"`{c}`" for c in stay))) == table(same.select(*(f"`{c}`" for c in stay)))
    slots = {}
    for r in out.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["shard"] == rendezvous("null" if r["doc_id"] is None else r["doc_id"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_take_an_empty_table(spark, tmp_path, empty):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and {"doc_id", "text", "source"} <= set(out.columns)


def test_fingerprints_hash_whole_texts():
    words = [f"w{i}" for i in range(200_000)]
    whole = simhash.fingerprint(" ".join(words))
    h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)], dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h))
    assert whole == [want]
