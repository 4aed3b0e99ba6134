"""Near-duplicates by the exact Jaccard similarity of whole shingle sets, for operator 4's `one_of_each`.

SimHash alone can't tell 0.8 from 0.7, so the method's steps (fingerprints of LANES lanes, segment counts, grid cells, distance) propose and the whole sets decide.
RADIUS is over 3.5 standard deviations above the mean distance at 0.8. There two segments agree in 0.73 of cases, so one table of cells that are fine
enough for many texts finds few pairs; the two-level grid (`simhash.buckets`) draws its finer cells inside the tasks, some hundred for each text.

Equal sets are one node. A bucket is what links within RADIUS connect inside a coarse cell. Each member of a bucket is tried with the bucket's heaviest member (the one that shares most buckets), then with its neighbour by weight,
then with LEADERS heavy members, always only across components; that is linear in the members. For what is still apart in a bucket, shingles that at most RARE of these sets have decide: similar sets either have such
a shingle in common, which is joined on, or enough others to reach the threshold by those alone, and only such pairs are tried one by one. So no proposed
pair is left out but those that are connected already. A link is kept only if the whole sets reach the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, materialize, row_hash, slices, text_bytes, text_hash
from .components import connected_components, merged, named
from .quality import words_of
from .simhash import SEED, agreement, buckets, packed, within

LANES, RADIUS = 4, 60
#: Members of a bucket that all others of different components are tried with before all pairs are.
LEADERS = 8
#: A shingle is rare among the sets that are still apart if so many of them have it at most.
RARE = 8
#: Bytes of text that are hashed at once; a longer text stays whole.
SLICE = 2 << 20
#: Bytes of a shingle's hash in a set: two sets of 10^6 have one false match in common.
WIDTH = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _finish(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of all rows, sorted within each row, and the offsets of the rows. Fewer words than size: one shingle of all; none: no shingle."""
    raw, offsets = text_bytes(column)
    words, at = words_of(_LOWER[raw], offsets)
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    coded = words.dictionary_encode()
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()], dtype=np.uint64)[coded.indices.to_numpy()]
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    # a shingle starts at every word but the last size - 1 of its row; a short row has one
    place = np.arange(len(h)) - at[:-1][row]
    starts = np.flatnonzero((place + size <= n[row]) | ((place == 0) & (n[row] < size)))
    row = row[starts]
    length = np.minimum(n[row], size)
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for words_in in np.unique(length).tolist():
            of = np.flatnonzero(length == words_in)
            x = np.zeros(len(of), np.uint64)
            for k in range(words_in):
                x = _finish(x * _GOLDEN + h[starts[of] + k])
            out[of] = x
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.r_[True, (out[1:] != out[:-1]) | (row[1:] != row[:-1])]
    out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(len(n) + 1))


def node_names(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set."""
    n = np.diff(at)
    total, mixed = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    with np.errstate(over="ignore"):
        x = _finish(sets + _GOLDEN)
        if len(full):
            total[full], mixed[full] = np.add.reduceat(x, at[full]), np.bitwise_xor.reduceat(x, at[full])
        return _finish(total ^ _finish(mixed ^ _finish(n.astype(np.uint64)))).view(np.int64)


def signatures(rows: DataFrame, ids: Sequence[str], size: int) -> DataFrame:
    """(ids, node, n, f0 ..) of every row of (ids, text); n is the size of the set."""
    lanes = [f"f{i}" for i in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets, at = shingle_sets(batch.column("text"), size)
            n = np.diff(at)
            f = np.array([packed([sets[s:e]], LANES) for s, e in zip(at[:-1], at[1:], strict=True)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), pa.array(node_names(sets, at)), pa.array(n), *(pa.array(f[:, i]) for i in range(LANES))], names=[*ids, "node", "n", *lanes])

    return rows.select(*ids, "text").mapInArrow(run, ", ".join(f"{c} long" for c in [*ids, "node", "n", *lanes]))


def sets_of(rows: DataFrame, size: int) -> DataFrame:
    """(node, members) of every row of (text): the lowest WIDTH bytes of each hash, joined in order of the whole hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets, at = shingle_sets(batch.column("text"), size)
            raw = np.ascontiguousarray(sets.view(np.uint8).reshape(-1, 8)[:, :WIDTH])
            yield pa.RecordBatch.from_arrays([pa.array(node_names(sets, at)), pa.array([raw[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["node", "members"])

    return rows.select("text").mapInArrow(run, "node long, members binary")


def _members(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    out[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return out.view(np.uint64).ravel()


def similar(one: bytes, two: bytes, part: int, whole: int) -> bool:
    """Whether two sets have a Jaccard similarity of part / whole at least."""
    a, b = _members(one), _members(two)
    return len(np.intersect1d(a, b)) * (part + whole) >= (len(a) + len(b)) * part


def verified(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Of the pairs (a, b), those whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(x, y, part, whole) for x, y in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(x), F.col("members").alias(f"of_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def rare_members(sets: DataFrame) -> DataFrame:
    """(piece, node, k): the members of the sets that at most RARE of them have, with the number that have it."""
    piece = F.explode(F.expr(f"transform(sequence(1, length(members) div {WIDTH}), i -> substring(members, (i - 1) * {WIDTH} + 1, {WIDTH}))")).alias("piece")
    pieces = sets.where(f"length(members) >= {WIDTH}").select("node", piece)
    return pieces.join(pieces.groupBy("piece").agg(F.count("*").alias("k")).where(F.col("k") <= RARE), "piece")


def _fits(a: Column, b: Column, part: int, whole: int) -> Column:
    """Whether sets of these sizes can reach part / whole at all."""
    return F.least(a, b) * whole >= F.greatest(a, b) * part


def grouped(rows: DataFrame, ids: Sequence[str], size: int = 5, part: int = 4, whole: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As simhash.grouped(): tables of rows (ids, node ..), nodes (node, first ..) and roots (node, root). ids must have t and h, which name a row's content."""
    lanes = [f"f{i}" for i in range(LANES)]
    prints = materialize(signatures(rows, ids, size), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *ids)).alias("first")
    nodes = materialize(prints.groupBy("node", "n", *lanes).agg(least), "nodes")
    # the angle of two sets' sums gives the share of bits that differ
    agree = agreement(math.acos(2 * part / (part + whole)) / math.pi)
    cells = materialize(buckets(nodes.where("n > 0").select("node", *lanes), LANES, RADIUS, agree), "buckets")
    # a node's weight: the members of all its buckets. The text that a family's copies were made from shares most with them and weighs most
    weight = F.sum("members").over(Window.partitionBy("node"))
    cells = materialize(cells.join(nodes.select("node", "n"), "node").select("key", "node", "n", weight.alias("weight")), "cells")
    heavy = [F.desc("weight"), F.xxhash64("node"), F.col("node")]

    def plausible(pairs: DataFrame) -> DataFrame:
        """Of the pairs (p), the distinct (a, b) whose fingerprints are within RADIUS."""
        prints_of = lambda x: nodes.select(F.col("node").alias(x), *(F.col(f).alias(f"{x}{i}") for i, f in enumerate(lanes)))
        both = pairs.select("p.*").distinct().join(prints_of("a"), "a").join(prints_of("b"), "b").where(within(LANES, RADIUS))
        return both.select("a", "b")

    def pair(a: str, b: str) -> Column:
        return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).alias("p")

    def chained() -> DataFrame:
        """Neighbours in each bucket by weight."""
        w = Window.partitionBy("key").orderBy(*heavy)
        near = cells.withColumns({"m": F.lag("node").over(w), "o": F.lag("n").over(w)})
        return near.where(F.col("m").isNotNull() & _fits(F.col("n"), F.col("o"), part, whole)).select(pair("node", "m"))

    def led(cells: DataFrame, leaders: int, apart: bool = False) -> DataFrame:
        """Every member of a bucket with its heaviest members; only across components, if `apart`."""
        rank = F.row_number().over(Window.partitionBy("key").orderBy(*heavy))
        top = cells.withColumn("rank", rank).where(F.col("rank") <= leaders).groupBy("key")
        root = F.col("root") if apart else F.col("node")
        top = top.agg(F.collect_list(F.struct(F.col("node").alias("m"), F.col("n").alias("o"), root.alias("r"))).alias("top"))
        both = cells.withColumn("r0", root).join(top, "key").select("node", "n", "r0", F.explode("top").alias("x"))
        return both.where((F.col("r0") != F.col("x.r")) & _fits(F.col("n"), F.col("x.o"), part, whole)).select(pair("node", "x.m"))

    star = materialize(plausible(led(cells, 1)), "pairs")
    tried = materialize(plausible(chained()).join(star, ["a", "b"], "left_anti"), "pairs")
    texts = rows.select("t", "h", "text")

    def sets_for(pairs: DataFrame, have: DataFrame | None = None) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if have is not None:
            ends = ends.join(have.select("node"), "node", "left_anti")
        wanted = nodes.join(ends, "node", "left_semi").select("first.t", "first.h")
        return materialize(sets_of(texts.join(wanted, ["t", "h"], "left_semi").dropDuplicates(["t", "h"]), size), "sets")

    sets = sets_for(star.unionAll(tried))
    roots = materialize(connected_components(verified(star, sets, part, whole)), "roots")
    root_of = lambda x, r: r.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))

    def apart(pairs: DataFrame) -> DataFrame:
        """(a, b, root_a, root_b) of the pairs whose ends are in different components; a node without links is its own root."""
        both = pairs.join(root_of("a", roots), "a", "left").join(root_of("b", roots), "b", "left")
        return both.select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b")).where("root_a <> root_b")

    def more(pairs: DataFrame) -> DataFrame:
        """roots with the links that hold among the pairs (a, b, root_a, root_b)."""
        found = materialize(verified(pairs.select("a", "b"), sets, part, whole).join(pairs, ["a", "b"]).select("root_a", "root_b").distinct(), "links")
        return roots if found.isEmpty() else merged(roots, found)

    roots = more(materialize(apart(tried), "pairs"))
    tried = star.unionAll(tried).select("a", "b")
    # what a bucket still holds apart: first with its LEADERS heaviest members, then all pairs
    for leaders in (LEADERS, None):
        now = cells.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = now.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        now = materialize(now.join(mixed, "key"), "open_cells")
        if now.isEmpty():
            break
        if leaders:
            pairs = led(now, leaders, apart=True)
        else:
            open_nodes = now.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
            sets = sets.unionAll(sets_for(open_nodes, sets))
            rare = materialize(rare_members(sets.join(open_nodes.select(F.col("a").alias("node")), "node", "left_semi")), "rare_members")
            now = now.join(rare.groupBy("node").agg(F.count("*").alias("few")), "node", "left").withColumn("common", F.col("n") - F.coalesce("few", F.lit(0)))
            sides = lambda rows, *more: (rows.select(*more, *(F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "root", "common"))) for x in "ab")
            new = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b"))
            # similar sets that aren't made up of common members alone have a rare one in common
            one, two = sides(rare.where("k > 1").select("piece", "node").join(now.select("node", "n", "root", "common").distinct(), "node"), "piece")
            pairs = one.join(two, "piece").where(new & _fits(F.col("n_a"), F.col("n_b"), part, whole)).select(pair("node_a", "node_b"))
            one, two = sides(now.where(F.col("common") * whole >= F.col("n") * part), "key")
            fits = F.least("common_a", "common_b") * (part + whole) >= (F.col("n_a") + F.col("n_b")) * part
            pairs = pairs.unionAll(one.join(two, "key").where(new & fits).select(pair("node_a", "node_b")))
        pairs = materialize(apart(plausible(pairs).join(tried, ["a", "b"], "left_anti")), "pairs")
        if not pairs.isEmpty():
            sets = sets.unionAll(sets_for(pairs, sets))
            roots = more(pairs)
            tried = tried.unionAll(pairs.select("a", "b"))
    return prints, nodes, roots


def near_duplicates(docs: DataFrame, size: int = 5, part: int = 4, whole: int = 5) -> DataFrame:
    """(doc_id, component_id) for every row of docs: the smallest doc_id reachable over pairs of similarity part / whole and more.

    Texts without words are copies of one another. Repeated rows come back repeated; a null doc_id stays null and counts last.
    """
    keyed = boxed(docs, "doc_id", "text")
    keyed = keyed.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string"), "t": text_hash(F.col("text")), "h": row_hash(keyed)})
    prints, nodes, roots = grouped(keyed.drop("row"), ["doc_id", "t", "h"], size, part, whole)
    return prints.select("doc_id", "node").join(named(nodes, roots), "node").drop("node")
