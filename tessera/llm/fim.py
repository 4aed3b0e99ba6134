"""Fill-in-the-middle: texts as arrays of code points, cut at ranks among the boundaries of their units, pieces put in another order.

A text is decoded to UTF-32; each code point gets a class, boundaries are where neighbours' classes differ. Every draw comes from a hash
of the row's key, so reruns, other partitions and lost executors change nothing. Rows are independent: no shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, slices

#: Marks of the three pieces, fixed. A text that has one stays plain, so the first of each mark is where a piece begins.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in hundredths: texts that stay plain, and suffix-first forms among the others.
PLAIN, SPM = 10, 20
#: White space that units of words are told apart by.
SPACE = np.array([9, 10, 11, 12, 13, 32], np.uint32)

CLASSES = {
    "char": lambda codes: (np.arange(len(codes)) & 1).astype(np.uint8),  # neighbours always differ
    "word": lambda codes: np.isin(codes, SPACE),
    "line": lambda codes: np.concatenate([[0], np.cumsum(codes[:-1] == 10)]) if len(codes) else codes,
}


def bounds(codes: np.ndarray, unit: str = "char") -> np.ndarray:
    """Where the units of a text end, with 0 first: code points, runs of words or white space, or lines with their line feed."""
    classes = CLASSES[unit](codes)
    inner = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    return np.concatenate([[0], inner, [len(codes)]]) if len(codes) else np.zeros(1, np.int64)


def draws(key: str, seed: int) -> list[int]:
    """Four numbers below 2^32 for a key."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def formatted(text: str, key: str, seed: int = 1, unit: str = "char", plain: int = PLAIN, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output)."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = bounds(codes, unit)
    n = len(ends) - 1
    a, b, c, d = draws(key, seed)
    if not n or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or c % 100 >= 100 - plain:
        return n, "plain", None, None, text
    start, end = (int(ends[i]) for i in sorted((a % (n + 1), b % (n + 1))))
    first, middle, last = (codes[i:j].tobytes().decode("utf-32-le") for i, j in ((0, start), (start, end), (end, len(codes))))
    if d % 100 < spm:
        return n, "spm", start, end - start, f"{SUFFIX}{last}{PREFIX}{first}{MIDDLE}{middle}"
    return n, "psm", start, end - start, f"{PREFIX}{first}{SUFFIX}{last}{MIDDLE}{middle}"


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, unit: str = "char", plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) for every row of docs; n counts units.

    Null and empty texts, and texts with a mark in them, are plain. A null key draws as the empty text; repeated rows draw alike; an empty table gives no
    rows; other columns are ignored, whatever they are called. A text needs some 20 bytes a code point while it is cut.
    """
    if unit not in CLASSES:
        raise ValueError(f"unit is one of {', '.join(CLASSES)}")

    def run(batches):
        for part in slices(batches, "text"):
            out = [formatted(t, k, seed, unit, plain, spm) for t, k in zip(part.column("text").to_pylist(), part.column("drawn").to_pylist(), strict=True)]
            n, form, first, middle, output = (list(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=["key", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = boxed(docs, key, text)
    rows = rows.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("drawn"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("key", key)


def _between(output: Column, before: str, after: str | None = None) -> Column:
    """What stands behind the first `before`, up to the first `after`."""
    start = F.locate(before, output) + len(before)
    return F.substring(output, start, F.locate(after, output) - start if after else F.char_length(output))


def restore(output: Column, form: Column) -> Column:
    """The text that an output and its form were made of; null if either is null, or the form unknown."""
    psm = F.concat(_between(output, PREFIX, SUFFIX), _between(output, MIDDLE), _between(output, SUFFIX, MIDDLE))
    spm = F.concat(_between(output, PREFIX, MIDDLE), _between(output, MIDDLE), _between(output, SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def digests(made: DataFrame, key: str = "doc_id") -> DataFrame:
    """transform()'s rows with the digests of the output, and of the text restored from it, in place of the output."""
    back = restore(F.col("output"), F.col("form"))
    return made.select(key, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
