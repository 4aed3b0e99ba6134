"""A corpus pipeline: quality rules, near-duplicates, benchmark passages, source mix, shards.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and gives a DataFrame. run() writes each result as
Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, jaccard, mixing, quality, sharding, simhash
from tessera.llm.common import materialize, read

#: No SQL: shingles need XXH64, and the places of items need edit distances. Tests compare run() with a brute-force version.
ORACLE_SQL = None

#: Near-duplicates of the stage: an exact Jaccard similarity of 4/5 and more between whole sets of five-word shingles.
NEAR = {"size": 5, "part": 4, "whole": 5}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules reject go (null, empty and very short texts among them); the others lose the lines above the limits. Repeated rows stay repeated."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that of the smallest doc_id (null last). Texts without words are copies of one another."""
    return simhash.one_of_each(docs, jaccard.grouped, **NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of the benchmark go; null and empty texts hold none."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as the mix takes them; texts without words are never taken. A null source is a source."""
    return mixing.apply(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with the columns of its shard; null doc_ids share a shard. Existing columns of the new names are replaced."""
    return sharding.deal(docs, [1.0] * 40, [1.0])


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("benchmark decontamination", decontamination), ("source mix", source_mix), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
