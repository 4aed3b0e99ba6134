"""What the operators of this package share: scratch tables and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..session import materialize, release, scratch_path

__all__ = ["WORD", "boxed", "materialize", "placed", "read", "release", "row_hash", "scratch_path", "slices", "text_bytes", "text_hash", "unboxed"]

#: A word, as a regular expression: a run without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about most_bytes of text; a longer single text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)])
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + most_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def placed(df: DataFrame, name: str) -> int:
    """Where the column spelt so is, else the first that differs in case only; -1: nowhere."""
    lower = [c.lower() for c in df.columns]
    return df.columns.index(name) if name in df.columns else lower.index(name.lower()) if name.lower() in lower else -1


def boxed(df: DataFrame, *names: str) -> DataFrame:
    """Every row of df as one struct, `row`, with the named columns beside it: whatever other columns are called, none can clash.

    A name means the column spelt so, else the first that differs in case only.
    """
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    at = {n: placed(df, n) for n in names}
    if missing := [n for n, i in at.items() if i < 0]:
        raise ValueError(f"no such column: {', '.join(missing)}")
    return plain.select(F.struct(*plain.columns).alias("row"), *(F.col(f"c{i}").alias(n) for n, i in at.items()))


def unboxed(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The rows of boxed(like) again, with its columns in their order."""
    return rows.select("row.*").toDF(*like.columns)


def text_hash(text: Column) -> Column:
    """XXH64 (seed 42) of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def row_hash(rows: DataFrame) -> Column:
    """A hash of the struct `row` of boxed() rows: every column and where the nulls are."""
    fields = rows.schema["row"].dataType.fields
    value = lambda f: F.to_json(F.struct(F.col(f"row.{f.name}"))) if isinstance(f.dataType, (MapType, VariantType)) else F.col(f"row.{f.name}")
    nulls = F.concat(*(F.when(F.col(f"row.{f.name}").isNull(), "1").otherwise("0") for f in fields))
    return F.xxhash64(nulls, *(value(f) for f in fields))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
