"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Keys that the edges of one node are dealt to in the joins.
SALTS = 16


def _salt() -> Column:
    return F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")


def _minima(edges: DataFrame) -> DataFrame:
    """(u, m, salts): the least neighbour of each u, and the salts that its edges have, as bits."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.bit_or(F.expr(f"shiftleft(1, cast(pmod(xxhash64(v), {SALTS}) as int))")).alias("salts"))


def _joined(edges: DataFrame, minima: DataFrame) -> DataFrame:
    """edges (u, v) with m; a node with a third of all edges is dealt to SALTS keys, one with a single edge has one, so no more rows are made than there are edges."""
    has = F.expr(f"filter(sequence(0, {SALTS - 1}), i -> (salts & shiftleft(1, i)) <> 0)")
    spread = minima.select("u", "m", F.explode(has).alias("salt"))
    return edges.withColumn("salt", _salt()).join(spread, ["u", "salt"])


def _pair(a: Column, b: Column) -> DataFrame:
    return F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    minima = _minima(both).withColumn("m", F.least("u", "m"))
    return _joined(both, minima).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    minima = _minima(edges)
    links = _joined(edges, minima).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return links.unionAll(minima.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node reachable.

    Rows with a null end and self-links add nothing; an empty table gives an empty result. Repeated edges count once.
    Every round is written to the shared folder, so no lineage grows and lost executors cost one round at most.
    """
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(now.select(_pair(F.col(a), F.col(b)).alias("p")).select("p.*").distinct(), "edges")
    sign = None
    while True:
        after = materialize(_small_star(_large_star(now)), "edges")
        release(now)
        now = after
        last, sign = sign, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == last or sign[0] == 0:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after further links (root_a, root_b) between roots or nodes that have none yet; only what the links touch is searched."""
    new = materialize(connected_components(links, "root_a", "root_b"), "merged_roots")
    dealt = new.select(F.col("node").alias("old"), F.col("root").alias("now"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    moved = roots.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    moved = moved.join(dealt, (F.col("root") == F.col("old")) & (moved["salt"] == dealt["salt"]), "left").select("node", F.coalesce("now", "root").alias("root"))
    return materialize(moved.unionAll(new.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, first, root) of nodes (node, first ..); root is null for a node without links."""
    return materialize(nodes.select("node", "first").join(roots, "node", "left"), "rooted")


def represented(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(first) of each component: the least of its nodes'."""
    rooted = _rooted(nodes, roots)
    linked = rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("first")).select("first")
    return linked.unionAll(rooted.where("root is null").select("first"))


def named(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component_id) of every node: the doc_id of the least `first` in its component."""
    rooted = _rooted(nodes, roots)
    linked = rooted.where("root is not null")
    # a component with a third of all texts is dealt to SALTS keys; what is linked to nothing needs no join
    first = linked.groupBy("root").agg(F.min("first").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(first, ["root", "salt"]).select("node", F.col("least.doc_id").alias("component_id"))
    return materialize(out.unionAll(rooted.where("root is null").select("node", F.col("first.doc_id").alias("component_id"))), "components")
