import math
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import mixing, sharding


def test_targets_by_water_filling(spark):
    sizes = {"a": 100, "b": 1000, "c": 50, "d": 4000, "é": 0, None: 700}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1)).collect()
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, open_, want = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        rate = (budget - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * rate > 2 * sizes[s]}
        if not over:
            want |= {s: weight[s] * rate for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    assert {r.source: round(r.target, 6) for r in rows} == {s: round(t, 6) for s, t in want.items()}


def test_mix(edge, empty, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    got = mixing.mix(docs).collect()
    assert got and len(got) == docs.count()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str), "reruns agree"
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in target)
    assert sum(taken.values()) <= sum(target.values()) + 1e-6
    assert mixing.mix(edge).count() == 10 and mixing.mix(empty).count() == 0 and mixing.apply(empty).count() == 0
    once = mixing.mix(edge).agg(F.sum(F.expr("taken div nullif(size, 0)"))).first()[0]
    assert mixing.apply(edge).count() == once and mixing.apply(edge).columns == edge.columns


def test_shards(edge, empty, spark):
    rows = sharding.shards(edge).collect()
    for r, t in zip(sorted(rows, key=lambda r: (str(r.doc_id), r["size"])), sorted(edge.collect(), key=lambda r: (str(r.doc_id), len((r.text or "").encode()))), strict=True):
        assert (r["size"], r.text_crc32) == (len((t.text or "").encode()) + 16, zlib.crc32((t.text or "").encode()))
        assert r.grown_shard in (r.shard, 40)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shards(empty).count() == 0


def test_weights_and_growth(spark):
    ids = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    weights = [1.0, 2.0, 3.0, 4.0]
    rows = sharding.assign(ids, weights, [2.0]).groupBy("shard", "grown_shard").count().collect()
    count = defaultdict(int)
    for r in rows:
        assert r.grown_shard in (r.shard, 4)
        count[r.shard] += r["count"]
    assert all(abs(count[i] / 20000 - w / 10) < 4 * math.sqrt(w / 10 / 20000) for i, w in enumerate(weights))
    moved = sum(r["count"] for r in rows if r.grown_shard == 4)
    assert abs(moved / 20000 - 2 / 12) < 0.02
