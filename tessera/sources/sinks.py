"""Writers; Spark's commit protocol makes each atomic."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",", compression: str = "none") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep, compression=compression, escape='"')


def write_tsv(df: DataFrame, path: str) -> None:
    write_csv(df, path, sep="\t")


def write_jsonl(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.select(F.to_json(F.struct(*(f"`{c}`" for c in df.columns))).alias("value")).write.mode("overwrite").text(path, compression=compression)


def write_fasta(df: DataFrame, path: str, ident: str = "id", sequence: str = "sequence") -> None:
    df.select(F.concat(F.lit(">"), F.col(ident), F.lit("\n"), F.col(sequence)).alias("value")).write.mode("overwrite").text(path)


def write_by_status(states: DataFrame, path: str) -> None:
    """One folder for each endpoint and state."""
    states.write.mode("overwrite").partitionBy("endpoint", "status").parquet(path)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON document as text."""
    spark.createDataFrame([(json.dumps(document, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of every file under path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def output_metadata(spark: SparkSession, name: str, df: DataFrame, path: str) -> dict:
    """Rows, columns, bytes and a digest over the files' digests of one output."""
    files = checksums(spark, path).where("file not like '\\_%' and file not like '.%'")
    one = files.agg(F.sum("size").alias("size"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256")).first()
    return {"name": name, "rows": df.count(), "columns": df.columns, "bytes": one["size"], "sha256": one["sha256"]}


def write_vectors(df: DataFrame, key: str, vector: str, path: str) -> None:
    """Vectors as float arrays beside their ids, for a later export to one matrix."""
    df.select(key, F.col(vector).cast("array<float>").alias("vector")).write.mode("overwrite").parquet(path)


def to_numpy(df: DataFrame, key: str, vector: str, most: int = 1_000_000):
    """(ids, float32 matrix) by key, for a set that fits the driver; a larger one is an error."""
    import numpy as np

    n = df.count()
    if n > most:
        raise ValueError(f"{n} rows are over the limit of {most}")
    table = df.select(key, vector).orderBy(key).toArrow()
    return table.column(0).to_numpy(), np.array(table.column(1).to_pylist(), dtype=np.float32)


def write_npy(df: DataFrame, key: str, vector: str, path: str) -> DataFrame:
    """Vectors as float32 .npy matrices beside CSV files of their ids, one pair for each partition, under a path that all executors share; gives (file, rows, width).

    A file's name is new for each attempt, and only files that are named in the result count.
    """
    import uuid
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        store.create_dir(base, recursive=True)
        for batch in batches:
            if not batch.num_rows:
                continue
            name, rows = uuid.uuid4().hex, batch.column(1).to_pylist()
            matrix = np.array(rows, dtype=np.float32)
            with store.open_output_stream(f"{base}/{name}.npy", compression=None) as f:
                np.lib.format.write_array(f, matrix, allow_pickle=False)
            with store.open_output_stream(f"{base}/{name}.csv", compression=None) as f:
                f.write(f"{key}\n".encode() + b"".join(f"{k}\n".encode() for k in batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(rows)]), pa.array([matrix.shape[1]])], names=["file", "rows", "width"])

    return df.select(key, F.col(vector).cast("array<float>").alias("vector")).mapInArrow(run, "file string, rows long, width long")


def write_compact(assigned: DataFrame, path: str) -> None:
    """Folds as (id, label) under fold and part; readers see the old folds or the new ones."""
    assigned.select("fold", "part", "id", "label").write.mode("overwrite").partitionBy("fold", "part").parquet(path)
