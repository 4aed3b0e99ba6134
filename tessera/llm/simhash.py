"""SimHash near-duplicates: segment-popcount embedding, grid cells under the Manhattan bound, exact verification.

A fingerprint is one or more 64-bit lanes. The embedding maps a lane to the bit counts of its 32 two-bit segments. The
Manhattan distance of two embeddings is a lower bound of the Hamming distance of the fingerprints, so a grid over some of
the segments holds every pair whose distance falls on the other segments.

Exact mode (one lane, a small radius r): the segments form r + `agree` groups; a pair within r differs in r groups at most,
so it has the same counts in some `agree` groups, and one cell for each choice of `agree` groups finds every pair. A larger
`agree` makes more and smaller cells: 3 suits up to some 10^8 different texts, 4 some 10^9; the result is the same.
Sampling mode (several lanes): each cell takes `width` random segments out of all lanes, `tables` times; pairs at radius r
are found with a probability that `tables` sets.

Two levels (`buckets`, for a wide radius): a shuffle deals out coarse cells of few segments, and inside its task a cell is divided again,
by as many random choices of further segments as its size asks for, so fingerprints move once a coarse cell and not once a table.

Copies never become pairs: equal fingerprints are one node, and within a cell only a spanning forest of the verified links
is emitted. A cell over HOT members is cut into chunks and every pair of chunks is searched in a task of its own.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, row_hash, slices, text_hash, unboxed
from .components import connected_components, named, represented

SEED = 42
HOT, CHUNK = 32768, 16384
#: Cells up to this size are compared by shifted arrays, larger ones by a search from member to member.
SMALL = 8
#: A coarse cell takes so many segments at least, and more where ROOM nodes would share one; up to DIRECT members it is compared whole.
COARSE, ROOM, DIRECT = 4, 1 << 20, 48
#: Finer cells hold FEW members on average, and are drawn until they find SHARE of the pairs in the coarse cell. Up to SHIFTS members they are compared by shifted arrays.
FEW, SHARE, SHIFTS = 6, 0.8, 64
#: Odd multipliers that turn a shingle's hash into those of further lanes.
LANE_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, size: int, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text in blocks, so that a very long text needs little memory beside itself."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    count = max(1, len(words) - size + 1)
    h, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, count, block):
        end = min(count, start + block)
        part = words[start : end + size - 1]
        ends, at = [], 0
        for w in part:
            at += len(w)
            ends.append(at)
            at += 1
        whole = join(part)
        if len(part) <= size:
            yield np.array([h(whole, SEED)], dtype="<u8")
            continue
        starts = [0, *(e + 1 for e in ends[: len(part) - size])]
        yield np.array([h(whole[s:e], SEED) for s, e in zip(starts, ends[size - 1 :], strict=True)], dtype="<u8")


def lane(h: np.ndarray, i: int) -> np.ndarray:
    if not i:
        return h
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(LANE_MIX[i - 1])
        return h ^ (h >> np.uint64(29))


def packed(blocks: Iterable[np.ndarray], lanes: int = 1) -> list[int]:
    """The lanes of the fingerprint of shingle hashes, unsigned: a bit is 1 if set in over half of them. No hashes: zeros."""
    counts, total = np.zeros((lanes, 64), dtype=np.int64), 0
    for h in blocks:
        total += len(h)
        for i in range(lanes):
            planes = lane(h, i).view(np.uint8).reshape(-1, 8)
            counts[i] += (np.stack([np.bincount(planes[:, b], minlength=256) for b in range(8)]) @ _BITS).ravel()
    bits = (2 * counts > total).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().tolist()


def fingerprint(text: str | None, size: int = 4, lanes: int = 1) -> list[int]:
    """The lanes of a text's fingerprint, repeated shingles included. No words: zeros."""
    return packed(shingle_hashes(text, size), lanes)


def fingerprints(rows: DataFrame, ids: Sequence[str] = ("doc_id",), size: int = 4, lanes: int = 1) -> DataFrame:
    """(ids, f0 .. ) of every row of (ids, text), ids being of type long; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            f = np.array([fingerprint(t, size, lanes) for t in batch.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), *(pa.array(f[:, i]) for i in range(lanes))], names=[*ids, *(f"f{i}" for i in range(lanes))])

    return rows.select(*ids, "text").mapInArrow(run, ", ".join(f"{c} long" for c in [*ids, *(f"f{i}" for i in range(lanes))]))


def within(lanes: int, radius: int, a: str = "a", b: str = "b") -> Column:
    """Whether the fingerprints in columns a0 .., b0 .. differ in radius bits at most: first the Manhattan distance of the lanes' bit counts, a lower bound, then all bits."""
    sides = [(F.col(f"{a}{i}"), F.col(f"{b}{i}")) for i in range(lanes)]
    bound = sum((F.abs(F.bit_count(x) - F.bit_count(y)) for x, y in sides), F.lit(0))
    return (bound <= radius) & (sum((F.bit_count(x.bitwiseXOR(y)) for x, y in sides), F.lit(0)) <= radius)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_masks(lanes: int, radius: int, tables: int | None, width: int, agree: int = 3) -> list[tuple[int, ...]]:
    """For each grid, a mask over the packed embedding of every lane."""
    if tables is None:
        groups = [list(range(g, 32, radius + agree)) for g in range(radius + agree)]
        picks = [[s for g in c for s in groups[g]] for c in combinations(range(radius + agree), agree)]
    else:
        rng = random.Random(SEED)
        picks = [rng.sample(range(32 * lanes), width) for _ in range(tables)]
    return [tuple(sum(3 << 2 * (s % 32) for s in p if s // 32 == i) for i in range(lanes)) for p in picks]


def embedding(f: Column) -> Column:
    """The bit counts of the 32 two-bit segments, packed in 64 bits."""
    odd, even = F.shiftrightunsigned(f, 1).bitwiseAND(F.lit(0x5555555555555555)), f.bitwiseAND(F.lit(0x5555555555555555))
    return odd.bitwiseXOR(even).bitwiseOR(F.shiftleft(odd.bitwiseAND(even), 1))


def _cells(nodes: DataFrame, masks: list[tuple[int, ...]], lanes: int) -> DataFrame:
    """A row (key, node, lanes) for every grid cell of every fingerprint."""
    packed = nodes.select("node", *(f"f{i}" for i in range(lanes)), *(embedding(F.col(f"f{i}")).alias(f"e{i}") for i in range(lanes)))
    keys = F.array(*(F.xxhash64(F.lit(t), *(F.col(f"e{i}").bitwiseAND(F.lit(_signed(m[i]))) for i in range(lanes) if m[i])) for t, m in enumerate(masks)))
    return packed.select(F.explode(keys).alias("key"), "node", *(f"f{i}" for i in range(lanes)))


def _counts(x: np.ndarray) -> np.ndarray:
    """Bit counts of eight-bit segments; coarser than the grid's, cheaper for pairs."""
    return np.bitwise_count(x.view(np.uint8)).reshape(len(x), -1).astype(np.int8)


def _near(f: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Of the pairs, those within radius: the Manhattan distance of the bit counts first, the Hamming distance then."""
    out = np.zeros(len(i), dtype=bool)
    for s in range(0, len(i), 1 << 18):
        a, b = f[i[s : s + (1 << 18)]], f[j[s : s + (1 << 18)]]
        maybe = np.flatnonzero(np.abs(_counts(a) - _counts(b)).sum(1, dtype=np.int16) <= radius)
        out[s + maybe] = np.bitwise_count(a[maybe] ^ b[maybe]).sum(1, dtype=np.int16) <= radius
    return out


def _forest(f: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within radius among the rows of f."""
    left, queue, a, b = np.arange(len(f)), [], [], []
    while len(left) or queue:
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        x = queue.pop()
        if not len(left):
            continue
        hit = np.bitwise_count(f[left] ^ f[x]).sum(1, dtype=np.int16) <= radius
        found = left[hit].tolist()
        if found:
            a += [x] * len(found)
            b += found
            queue += found
            left = left[~hit]
    return a, b


def _links(batches: Iterator[pa.RecordBatch], lanes: int, radius: int, most: int) -> Iterator[pa.RecordBatch]:
    """Of cell rows sorted by key, the links (a, b) that connect what is within radius; for a cell over `most`, a row (null, null, key, members)."""

    def out(a: np.ndarray, b: np.ndarray, hot: list[tuple[int, int]]) -> pa.RecordBatch:
        z = [None] * len(hot)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())]), pa.concat_arrays([pa.array(b, pa.int64()), pa.array(z, pa.int64())]), *(pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array([h[k] for h in hot], pa.int64())]) for k in (0, 1))], names=["a", "b", "hot_key", "members"])

    def done(key: np.ndarray, node: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[edge, len(key)])
        small = np.repeat(size <= SMALL, size)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for d in range(1, SMALL):
            i = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
            i = i[_near(f, i, i + d, radius)]
            a.append(node[i])
            b.append(node[i + d])
        for s, n in zip(edge[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            x, y = _forest(f[s : s + n], radius)
            a.append(node[s + np.array(x, dtype=np.int64)])
            b.append(node[s + np.array(y, dtype=np.int64)])
        return out(np.concatenate(a), np.concatenate(b), [])

    keys, nodes, fs = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, lanes), np.uint64)
    over = None  # key and members of a cell that is only counted
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        f = np.stack([batch.column(2 + i).to_numpy() for i in range(lanes)], axis=1).view(np.uint64)
        if over:
            n = int(np.searchsorted(key, over[0], side="right"))
            over = (over[0], over[1] + n)
            key, node, f = key[n:], node[n:], f[n:]
            if not len(key):
                continue
            yield out(np.empty(0), np.empty(0), [over])
            over = None
        keys, nodes, fs = np.r_[keys, key], np.r_[nodes, node], np.concatenate([fs, f])
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last:
            yield done(keys[:last], nodes[:last], fs[:last])
        keys, nodes, fs = keys[last:], nodes[last:], fs[last:]
        if len(keys) > most:
            over = (int(keys[0]), len(keys))
            keys, nodes, fs = keys[:0], nodes[:0], fs[:0]
    if over:
        yield out(np.empty(0), np.empty(0), [over])
    if len(keys):
        yield done(keys, nodes, fs)


def links(nodes: DataFrame, lanes: int = 1, radius: int = 4, tables: int | None = None, width: int = 10, agree: int = 3) -> DataFrame:
    """Links (a, b) between nodes (node, f0 ..) whose transitive closure is that of all links within radius."""
    cells = _cells(nodes, grid_masks(lanes, radius, tables, width, agree), lanes)
    schema = "a long, b long, hot_key long, members long"

    def find(rows: DataFrame, most: int) -> DataFrame:
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _links(b, lanes, radius, most), schema)

    found = materialize(find(cells, HOT), "links")
    hot = found.where("hot_key is not null").select(F.col("hot_key").alias("key"), F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks"))
    found = found.where("hot_key is null").select("a", "b")
    if hot.isEmpty():
        return found
    parts = cells.join(hot, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    parts = parts.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).drop("chunks", "own", "other")
    return found.unionAll(find(parts, 1 << 62).where("hot_key is null").select("a", "b"))


def _segments(f: np.ndarray) -> np.ndarray:
    """embedding() of arrays."""
    half = np.uint64(0x5555555555555555)
    odd, even = (f >> np.uint64(1)) & half, f & half
    return (odd ^ even) | ((odd & even) << np.uint64(1))


def agreement(differ: float) -> float:
    """The share of two-bit segments with equal counts where this share of bits differs."""
    return (1 - differ) ** 2 + differ**2 / 2


def _joined(f: np.ndarray, seed: int, radius: int, agree: float) -> np.ndarray:
    """For each fingerprint of a coarse cell the place of the first one that it is connected with, by links within radius among those that share a finer cell."""
    n, lanes = f.shape
    root = np.arange(n)

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal root
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for x, y in zip(root[i].tolist(), root[j].tolist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        if up:
            to = np.arange(n)
            for x in list(up):
                to[x] = top(x)
            root = to[root]

    def tried(i: np.ndarray, j: np.ndarray) -> None:
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        good = _near(f, i, j, radius)
        unite(i[good], j[good])

    if n <= DIRECT:
        tried(*np.triu_indices(n, 1))
        return root
    e, rng = _segments(f), np.random.default_rng(seed & ((1 << 64) - 1))
    width = max(1, min(32 * lanes, math.ceil(math.log(n / FEW) / math.log(8 / 3))))
    for _ in range(math.ceil(math.log(1 - SHARE) / math.log1p(-(agree**width)))):
        picks = rng.choice(32 * lanes, width, replace=False)
        key = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in np.unique(picks // 32).tolist():
                mask = np.uint64(sum(3 << 2 * int(s % 32) for s in picks if s // 32 == i))
                key = lane(key ^ (e[:, i] & mask), 1)
        order = np.argsort(key)
        key = key[order]
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[edge, n])
        left = np.flatnonzero(np.repeat((size > 1) & (size <= SHIFTS), size))
        for d in range(1, SHIFTS):
            left = left[left + d < n]
            left = left[key[left + d] == key[left]]
            if not len(left):
                break
            tried(order[left], order[left + d])
        for s, m in zip(edge[size > SHIFTS].tolist(), size[size > SHIFTS].tolist(), strict=True):
            of = order[s : s + m]
            if (root[of] != root[of[0]]).any():
                x, y = _forest(f[of], radius)
                unite(of[np.array(x, dtype=np.int64)], of[np.array(y, dtype=np.int64)])
    return root


def buckets(nodes: DataFrame, lanes: int, radius: int, agree: float, miss: float = 1e-5, room: int = ROOM) -> DataFrame:
    """(key, node, members) of the nodes (node, f0 ..) that share a cell of the two-level grid with nodes they are connected with by links within radius.

    A pair within radius that has equal counts in a share `agree` of its segments is in no bucket together with a probability of `miss`.
    """
    spark, total = nodes.sparkSession, nodes.count()
    width = max(COARSE, math.ceil(math.log2(max(1, total) / room)))
    tables = math.ceil(math.log(miss) / math.log1p(-SHARE * agree**width))
    cells = _cells(nodes, grid_masks(lanes, radius, tables, width), lanes)
    if total > room:
        hot = cells.groupBy("key").agg(F.ceil(F.count("*") / F.lit(room // 2)).cast("int").alias("chunks")).where("chunks > 2")
        cut = cells.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        cells = cut.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).drop("chunks", "own", "other")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        node, key = rows.column("node").to_numpy(), rows.column("key")[0].as_py()
        f = np.stack([rows.column(f"f{i}").to_numpy() for i in range(lanes)], axis=1).view(np.uint64)
        root = _joined(f, key, radius, agree)
        members = np.bincount(root, minlength=len(root))[root]
        of = np.flatnonzero(members > 1)
        with np.errstate(over="ignore"):
            name = lane(lane(np.full(len(of), key, np.int64).view(np.uint64), 1) ^ node[root[of]].view(np.uint64), 2)
        return pa.table({"key": name.view(np.int64), "node": node[of], "members": members[of]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "key").groupBy("key").applyInArrow(run, "key long, node long, members long")


def grouped(rows: DataFrame, ids: Sequence[str], size: int = 4, radius: int = 4, lanes: int = 1, tables: int | None = None, width: int = 10, agree: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of rows (ids, f0 .., node), nodes (node, f0 .., first: the ids of the least row, null doc_id last) and roots (node, root) of what has a link."""
    cols = [f"f{i}" for i in range(lanes)]
    node = F.col("f0") if lanes == 1 else F.xxhash64(*cols)
    prints = materialize(fingerprints(rows, ids, size, lanes), "fingerprints").withColumn("node", node)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *ids)).alias("first")
    nodes = materialize(prints.groupBy("node", *cols).agg(first), "nodes")
    return prints, nodes, connected_components(links(nodes, lanes, radius, tables, width, agree))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, f0 .., component_id) for every row of docs: the smallest doc_id reachable over links within radius, itself included.

    Null and empty texts have fingerprint zero, which links like any other. Repeated rows come back repeated, with one
    component; a null doc_id stays null and counts last. Empty table: no rows. Other columns are ignored, whatever they are called.
    """
    rows = boxed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints, nodes, roots = grouped(rows, ["doc_id"], **options)
    return prints.join(named(nodes, roots), "node").drop("node")


def one_of_each(docs: DataFrame, finder: Callable[..., tuple[DataFrame, DataFrame, DataFrame]] = grouped, **options) -> DataFrame:
    """docs with one row of each group of near-duplicates that finder gives, all columns as they are.

    That is the row of the smallest doc_id (null last), then the smallest hash of its text, then of the whole row; of rows that are
    equal in every column, one. So different texts under one doc_id, or under none, each stay unless they are near-duplicates.
    An empty table gives no rows.
    """
    keyed = boxed(docs, "doc_id", "text")
    keyed = keyed.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string"), "t": text_hash(F.col("text")), "h": row_hash(keyed)})
    _, nodes, roots = finder(keyed.drop("row"), ["doc_id", "t", "h"], **options)
    chosen = represented(nodes, roots).select("first.t", "first.h")
    # rows that are equal in every column are merged before they are dealt out
    return unboxed(keyed.select("row", "t", "h").dropDuplicates(["t", "h"]).join(chosen, ["t", "h"], "left_semi"), docs)
