"""Rendezvous hashing of stable record keys over weighted shards, with gapless slots; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, materialize

#: Rows of a shard are ranked in so many parts by the key's hash, so no task ranks a whole shard.
PARTS = 1024


def unit(key: Column, shard: int) -> Column:
    """A number in (0, 1), uniform over keys and independent between shards: 52 bits of the MD5 of "key:shard"."""
    head = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """(score, shard) of the shard, counted from `first`, whose score -weight / ln(u) is largest. A key moves only to an added shard or away from a removed one."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = [F.struct((F.lit(-float(w)) / F.ln(unit(key, i))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights, first)]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def _assigned(rows: DataFrame, weights: Sequence[float], added: Sequence[float], overhead: int) -> DataFrame:
    """rows (key, text ..) with key_text, size, text_crc32, shard, grown_shard, and hash and part, which place a row in its shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.withColumns({"key_text": F.coalesce(F.col("key").cast("string"), F.lit("null")), "size": F.octet_length(text).cast("long") + F.lit(overhead), "text_crc32": F.crc32(text.cast("binary"))})
    rows = rows.withColumn("best", rendezvous(F.col("key_text"), weights))
    grown = F.greatest(F.col("best"), rendezvous(F.col("key_text"), added, len(weights)))["shard"] if added else F.lit(None).cast("int")
    # what is under one key is spread over the parts by checksum and size
    place = F.md5(F.concat_ws(":", F.lit("slot"), "key_text", F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    rows = rows.withColumns({"shard": F.col("best")["shard"], "grown_shard": grown, "hash": place}).drop("best", "text")
    return rows.withColumn("part", F.pmod(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * PARTS / F.lit(1 << 32), F.lit(PARTS)).cast("int"))


def _slotted(rows: DataFrame) -> DataFrame:
    """Adds slot; PARTS counts for each shard are summed up, so every rank is taken within one part of one shard."""
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("hash", "key_text", "text_crc32", "size"))
    return rows.withColumn("rank", rank).join(counts, ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("rank") - 1).cast("long"))


#: Columns of assign(), and of deal() too with slot.
NEW = ("key_text", "size", "text_crc32", "shard", "grown_shard")


def _beside(docs: DataFrame, rows: DataFrame, new: Sequence[str]) -> DataFrame:
    """The columns of docs, but those called like a new one, and the new ones."""
    old = [(c, i) for i, c in enumerate(docs.columns) if c.lower() not in new]
    return rows.select(*(F.col(f"row.c{i}").alias(c) for c, i in old), *new)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return boxed(docs, key, text).withColumnsRenamed({key: "key", text: "text"})


def assign(docs: DataFrame, weights: Sequence[float], added: Sequence[float] = (), key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """Every row with key_text, size, text_crc32, shard and grown_shard (with the `added` shards behind the others; null without any).

    The shard depends on the key and the weights only. Null keys share one key of their own ("null" can't be a number's text).
    A null text has no bytes. Existing columns of the new names are replaced, whatever their case; all others stay. Empty table: no rows.
    """
    return _beside(docs, _assigned(_keyed(docs, key, text), weights, added, overhead), NEW)


def deal(docs: DataFrame, weights: Sequence[float], added: Sequence[float] = (), key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """assign() with slot: places counted from 0 within a shard without gaps, by a hash of key, checksum and size, so that rows under one
    key spread over the parts that are ranked apart. Equal rows take their places in any order."""
    return _beside(docs, _slotted(_assigned(_keyed(docs, key, text), weights, added, overhead)), (*NEW, "slot"))


def shards(docs: DataFrame, n: int = 40, **options) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) over n equal shards and n + 1: the law `key`.

    A row of docs is a row of the result: nulls in any column, empty texts and repeats included (see deal()); other columns are ignored.
    """
    rows = _assigned(_keyed(docs, options.pop("key", "doc_id"), options.pop("text", "text")), [1.0] * n, [1.0], options.pop("overhead", 16)).drop("row")
    out = _slotted(materialize(rows, "assigned"))
    return out.select(F.col("key").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
