"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import WORD, boxed, materialize, row_hash, text_hash, unboxed

#: Each source's queue, and the merged queue, are summed up in so many parts.
PARTS = 1024


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): the budget by weight, with no target over most times its source.

    Sources count by code point, null last, and take the weights in turn. The excess over a limit goes to the others by weight
    until none is above: sources in order of limit / weight, those before the water level are full. One row per source, ordered on one task:
    sources, not documents.
    """
    turn = F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1
    limit = F.col("source_size") * F.lit(float(most))
    s = sources.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod("turn", F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("limit", limit).withColumn("level", F.col("limit") / F.col("weight"))
    up = Window.partitionBy().orderBy("level", "turn").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy().orderBy("level", "turn").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    budget = F.least(F.sum("source_size").over(every) * F.lit(float(share)), F.sum("limit").over(every))
    s = s.withColumn("left", budget - F.coalesce(F.sum("limit").over(up), F.lit(0.0))).withColumn("rest", F.sum("weight").over(down))
    # full while the limits so far leave more for each unit of weight than this source can take
    s = s.withColumn("full", F.col("left") / F.col("rest") >= F.col("level"))
    s = s.withColumn("first", F.min(F.when(~F.col("full"), F.struct("level", "turn", (F.col("left") / F.col("rest")).alias("rate")))).over(every)["rate"])
    return s.select("source", "source_size", "weight", F.when(F.col("full") | F.col("first").isNull(), F.col("limit")).otherwise(F.col("weight") * F.col("first")).alias("target"))


def _place(seed: int) -> Column:
    """60 bits of the MD5 of "seed:doc_id"."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def _literal(entry: Row) -> Column:
    types = (("finish", "double"), ("last", "boolean"), ("source", "string"), ("place", "long"), ("id", "long"), ("nth", "int"), ("round", "int"))
    return F.struct(*(F.lit(entry[k]).cast(t).alias(k) for k, t in types))


def mix(docs: DataFrame, source: str = "source", seed: int = 0, **options) -> DataFrame:
    """(doc_id, text_hash, source, size, source_size, target, taken) for every row: the words that the mix takes of it, repeats counted.

    Each source's queue holds its shuffled documents, then the same again, `most` times in all. An entry's virtual finish
    time is the words of its source up to its end, divided by the source's target. The queues merge in that order and end
    before the entry that would pass the total budget. The shuffle is a hash of doc_id, so reruns agree; rows with one
    doc_id follow by size and text. Null text and texts without words have size 0 and are never taken; a null source is a source;
    an empty table gives no rows; other columns are ignored.
    """
    return _mixed(_rows(boxed(docs, "doc_id", "text", source).withColumnRenamed(source, "source"), seed), **options).drop("h")


def _rows(rows: DataFrame, seed: int, whole: bool = False) -> DataFrame:
    """(doc_id, source, size, text_hash, h, place) of boxed rows; h tells rows apart by all columns if `whole`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = row_hash(rows) if whole else F.lit(0).cast("long")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(text).alias("size"), text_hash(F.col("text")).alias("text_hash"), h.alias("h")).withColumn("place", _place(seed))


def _mixed(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    rows = materialize(rows.withColumn("part", F.shiftright("place", 60 - (PARTS.bit_length() - 1)).cast("int")), "sizes")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("n"))
    aims = materialize(targets(parts.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most), "targets")
    in_source = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("before"))
    starts = starts.join(aims.select(F.col("source").alias("a"), "source_size", "target"), F.col("s").eqNullSafe(F.col("a"))).drop("a")
    upto = Window.partitionBy("source", "part").orderBy("place", "doc_id", "size", "text_hash", "h")
    queue = rows.withColumn("upto", F.sum("size").over(upto.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(upto))
    queue = queue.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).withColumn("upto", F.col("before") + F.col("upto")).drop("s", "p", "before")
    queue = materialize(queue, "queue")

    # an entry's place in the merged queue; entries of one document differ by nth and round
    def entry(round_: Column | int) -> Column:
        finish = F.try_divide((F.col("upto") + F.lit(round_) * F.col("source_size")).cast("double"), F.col("target"))
        return F.struct(finish.alias("finish"), F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("source"), "place", F.coalesce("doc_id", F.lit(0)).alias("id"), "nth", F.lit(round_).cast("int").alias("round"))

    # the budget ends within one of the bins of virtual time, and within that in one of its bins: only the last one's
    # entries, some 1 / PARTS ** 2 of all, need an order. A level of bins has 2 * PARTS + 1 rows at most.
    entries = queue.where("size > 0").select("size", F.explode(F.array(*(entry(r) for r in range(most)))).alias("e"))
    budget, ahead, step, low = aims.agg(F.sum("target")).first()[0] or 0.0, 0, 1.0 / PARTS, 0.0
    sure = None
    for _ in range(2):
        binned = entries.withColumn("bin", F.least(F.floor((F.col("e.finish") - F.lit(low)) / F.lit(step)), F.lit(2 * PARTS)).cast("int"))
        bins = binned.groupBy("bin").agg(F.sum("size").alias("n"))
        upto_bin = F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.lit(ahead)
        cut = bins.select("bin", upto_bin.alias("ahead")).where(F.col("ahead") < F.lit(budget)).orderBy(F.desc("bin")).first()
        if cut is None:
            break
        entries, ahead, sure = binned.where(F.col("bin") == cut["bin"]).select("size", "e"), cut["ahead"], True
        low, step = low + cut["bin"] * step, step / PARTS
    if sure is None:
        rounds = F.lit(0)
    else:
        total = F.lit(ahead) + F.sum("size").over(Window.partitionBy().orderBy("e"))
        last = entries.withColumn("total", total).where(F.col("total") <= F.lit(budget)).agg(F.max("e").alias("e")).first()["e"]
        if last is None:  # the first of these entries would pass the budget, so what is before them is all
            first = entries.agg(F.min("e").alias("e")).first()["e"]
            taken = [entry(r) < _literal(first) for r in range(most)]
        else:
            taken = [entry(r) <= _literal(last) for r in range(most)]
        rounds = sum((F.coalesce(t, F.lit(False)).cast("int") for t in taken), F.lit(0))
    return queue.select("doc_id", "text_hash", "h", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("size") * rounds).otherwise(0).cast("long").alias("taken"))


def apply(docs: DataFrame, source: str = "source", seed: int = 0, **options) -> DataFrame:
    """docs as the mix takes them: a row taken twice comes twice, one that isn't taken goes. All columns stay under their names.

    As mix(), with rows of one doc_id and text in order of a hash of all their columns, so reruns agree on which of them is repeated.
    """
    keyed = boxed(docs, "doc_id", "text", source).withColumnRenamed(source, "source")
    taken = _mixed(_rows(keyed, seed, whole=True), **options).where("taken > 0")
    times = taken.groupBy(F.col("text_hash").alias("t"), "h").agg(F.sum(F.expr("taken div size")).cast("int").alias("times"))
    # rows that are equal in every column are merged before they are dealt out, and come back as often as all of them are taken
    merged = keyed.select("row", text_hash(F.col("text")).alias("t"), row_hash(keyed).alias("h")).dropDuplicates(["t", "h"])
    return unboxed(merged.join(times, ["t", "h"]).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))), docs)
