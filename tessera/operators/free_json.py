"""Metadata of any shape: JSON texts as variants, walked level by level, their keys normalised, and put together again."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Names of a source's fields that stand for others, after normalisation.
SOURCE_ALIASES = {"type_source": "source_type", "static_dynamic": "resource_behavior", "year_of_publication": "publication_year", "dataset_information": "annotation_content", "obtaining_negative_dataset": "negative_dataset_origin"}


def metadata_key(name: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """Lower-cased runs of letters and digits joined by single underscores; then its alias, if it has one."""
    key = F.lower(F.regexp_replace(F.regexp_replace(name, "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""))
    if not aliases:
        return key
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), key), key)


def nodes(df: DataFrame, key: str, text: str, aliases: Mapping[str, str] | None = SOURCE_ALIASES) -> DataFrame:
    """(key, place, path, name, kind, json): every value of every text, at any depth. place: positions from the root; path: normalised names and [positions]; kind:
    object, array or value; json: that of a value or of an empty object or list, else null.

    A round takes every object and list of one level apart, so there are as many rounds as the deepest text has levels, each a written table; texts spread over tasks as their values do.
    Members of an object come by their original names. Null texts and texts that aren't JSON have no nodes. Keys should be unique: texts under one key are one.
    """
    first = df.select(F.col(key).alias("key"), F.try_parse_json(F.col(text)).alias("v")).where("v is not null")
    level = first.select("key", F.array().cast("array<int>").alias("place"), F.lit("").alias("path"), F.lit(None).cast("string").alias("name"), "v")
    out = None
    while True:
        kind = F.when(F.schema_of_variant("v").startswith("OBJECT"), "object").when(F.schema_of_variant("v").startswith("ARRAY"), "array").otherwise("value")
        now = materialize(level.withColumn("kind", kind), "nodes")
        bare = F.when(F.col("kind") == "object", F.schema_of_variant("v") == "OBJECT<>").otherwise(F.try_variant_get("v", "$[0]", "variant").isNull())
        plain = now.select("key", "place", "path", "name", "kind", F.when((F.col("kind") == "value") | bare, F.to_json("v")).alias("json"))
        out = plain if out is None else out.unionAll(plain)
        inner = now.where("kind <> 'value'")
        if not inner.limit(1).count():
            return out
        parts = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("at", "member", "part"))
        name = metadata_key(F.col("member"), aliases)
        path = F.when(F.col("kind") == "array", F.concat("path", F.lit("["), F.col("at").cast("string"), F.lit("]"))).when(F.col("path") == "", name).otherwise(F.concat("path", F.lit("."), name))
        level = parts.select("key", F.array_append("place", F.col("at")).alias("place"), path.alias("path"), F.when(F.col("kind") == "object", name).alias("name"), F.col("part").alias("v"))


def leaves(walked: DataFrame) -> DataFrame:
    """(key, path, value) of nodes(): plain values as JSON, and empty objects and lists. A node tells that it is one, so nothing is joined."""
    return walked.where("json is not null").select("key", "path", F.col("json").alias("value"))


def rebuilt(walked: DataFrame) -> DataFrame:
    """(key, json) of nodes(): the texts again with normalised keys, an object's members by name. Of members that get one name the last by its original name counts."""
    walked = materialize(walked, "walked")
    deepest = walked.agg(F.max(F.size("place")).alias("n")).first()["n"]
    done = walked.where(F.size("place") == F.lit(deepest if deepest is not None else 0))
    for depth in range((deepest or 0) - 1, -1, -1):
        parent = F.slice("place", 1, F.size("place") - 1)
        told = done.select("key", parent.alias("place"), F.element_at("place", -1).alias("at"), "name", _json().alias("json"))
        last = told.groupBy("key", "place", F.coalesce("name", F.col("at").cast("string")).alias("one")).agg(F.max_by(F.struct("at", "name", "json"), "at").alias("m"))
        member = F.when(F.col("m.name").isNull(), F.col("m.json")).otherwise(F.concat(F.to_json(F.array("m.name")).substr(F.lit(2), F.length(F.to_json(F.array("m.name"))) - 2), F.lit(":"), "m.json"))
        order = F.struct(F.col("m.name").alias("name"), F.col("m.at").alias("at"), member.alias("text"))
        made = last.groupBy("key", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["text"]), ",").alias("inner"))
        here = walked.where(F.size("place") == depth).join(made, ["key", "place"], "left")
        body = F.when(F.col("kind") == "object", F.concat(F.lit("{"), F.coalesce("inner", F.lit("")), F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), F.coalesce("inner", F.lit("")), F.lit("]"))).otherwise(F.col("json"))
        done = materialize(here.select("key", "place", "path", "name", "kind", body.alias("json")), "level")
    return done.select("key", _json().alias("json"))


def _json() -> Column:
    """A node's text; below the deepest level objects and lists are empty."""
    return F.coalesce(F.col("json"), F.when(F.col("kind") == "object", "{}").when(F.col("kind") == "array", "[]"))
