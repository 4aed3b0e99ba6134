"""Votes as a stream. Label sets only grow, so source states need no watermark: a later vote updates its key's row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import clean_votes, source_status
from ..session import scratch_path


def source_states(votes: DataFrame) -> DataFrame:
    """(sequence, endpoint, source, source_status) of a stream or table of raw votes, by bits for the labels seen: state of a fixed size for each key."""
    bit = F.when(F.col("label") == 0, 1).when(F.col("label") == 1, 2).when(F.col("label") == 2, 4).otherwise(0)
    seen = clean_votes(votes).groupBy("sequence", "endpoint", "source").agg(F.bit_or(bit).alias("seen"))
    labels = F.filter(F.array(F.when(F.col("seen").bitwiseAND(1) > 0, 0), F.when(F.col("seen").bitwiseAND(2) > 0, 1), F.when(F.col("seen").bitwiseAND(4) > 0, 2)), lambda x: x.isNotNull())
    return seen.select("sequence", "endpoint", "source", source_status(labels).alias("source_status"))


def run_once(spark: SparkSession, votes: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Everything that is there now: each batch writes the keys that it changed to the shared folder, and a key's last state counts. No batch goes through the driver,
    and a batch that is run again replaces its files."""
    states = source_states(votes)
    path, made = scratch_path(spark, name), []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        made.append(number)

    q = states.writeStream.outputMode("update").foreachBatch(put).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not made:
        return spark.createDataFrame([], states.schema)
    told = spark.read.schema("sequence string, endpoint string, source string, source_status string, batch long").parquet(path)
    return told.groupBy("sequence", "endpoint", "source").agg(F.max_by("source_status", "batch").alias("source_status"))


def arrivals(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each type in windows of event time; rows later than `late` don't count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
