"""Quality rules: per-document counts, then cross-document line frequency within each host."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, placed, slices, text_bytes, text_hash

#: Bytes that start a code point, white space of WORD, and the symbols that are counted.
_STARTS = np.array([b & 0xC0 != 0x80 for b in range(256)])
_SPACE = np.array([b == 0x20 or 9 <= b <= 13 for b in range(256)])
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)

#: Seed of the text hash, that of Spark's xxhash64().
SEED = 42

STATS = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line: long, words: int>>"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows in one array, and for each row the offset of its first word."""
    solid = ~_SPACE[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = ends - starts
    bounds = np.r_[0, np.cumsum(lengths)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[solid]))])
    return words, np.searchsorted(starts, offsets)


def repeated_words(ids: np.ndarray, rows: np.ndarray, window: int = 5) -> np.ndarray:
    """For each word, whether it lies in a window of words that its row holds twice or more."""
    covered = np.zeros(len(ids), dtype=bool)
    count = len(ids) - window + 1
    if count < 2:
        return covered
    starts = np.flatnonzero(rows[:count] == rows[window - 1 :])
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC4CEB9FE1A85EC53)
        mixed ^= mixed >> np.uint64(29)
        h = rows[starts].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        for k in range(window):
            h = (h ^ (mixed[starts + k] * _POWERS[k % 5])) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(32)
    order = np.argsort(h)
    one, two = starts[order[:-1]], starts[order[1:]]
    same = (h[order[:-1]] == h[order[1:]]) & (rows[one] == rows[two])
    hit = np.flatnonzero(same)
    for k in range(window):  # a collision of the hash isn't a repeat
        hit = hit[ids[one[hit] + k] == ids[two[hit] + k]]
    marks = np.unique(np.r_[one[hit], two[hit]])
    for k in range(window):
        covered[marks + k] = True
    return covered


def _line_hash(words: list[bytes]) -> int:
    h = xxhash.xxh64_intdigest(b" ".join(words).lower())
    return h - (1 << 64) if h >> 63 else h


def without_lines(text: str, lines: Collection[int]) -> str:
    """The text without its lines whose hash is in lines; the other lines stay as they are."""
    lines = set(lines)
    return "\n".join(x for x in text.split("\n") if not (words := x.encode().split()) or _line_hash(words) not in lines)


def _lines(text: str | None) -> tuple[int, list[tuple[int, int]]]:
    """Lines equal to an earlier one, and the hash and words of every different normalised line; lines without words don't count."""
    seen, repeats, found = set(), 0, {}
    for line in (text or "").split("\n"):
        words = line.encode().split()
        if not words:
            continue
        repeats += line in seen
        seen.add(line)
        h = _line_hash(words)
        found[h] = found.get(h, 0) + len(words)
    return repeats, list(found.items())


def statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    """The counts of every row, and the hashes of its normalised lines (words lower-cased in A-Z and joined by single spaces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, offsets = text_bytes(batch.column("text"))
            words, at = words_of(raw, offsets)
            n = np.diff(at)
            ids = words.dictionary_encode().indices.to_numpy() if len(words) else np.empty(0, np.int32)
            covered = repeated_words(ids, np.repeat(np.arange(len(n)), n))
            texts = batch.column("text").to_pylist()
            lines = [_lines(t) for t in texts]
            hashes = np.array([xxhash.xxh64_intdigest(t or "", SEED) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("host"), pa.array(hashes), *(pa.array(x) for x in (n, _sums(_STARTS[raw] & ~_SPACE[raw], offsets), _sums(_SYMBOL[raw], offsets), np.array([x for x, _ in lines], dtype=np.int64), _sums(covered, at))),
                 pa.array([[{"line": h, "words": w} for h, w in x] for _, x in lines], pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())])))],
                names=["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    rows = boxed(docs, "doc_id", "text", host).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, STATS)


def judge(docs: DataFrame, host: str = "source", in_host: int = 20, in_all: int = 50, depleted: float = 0.5) -> DataFrame:
    """The counts of every row with base_failed, removed_words, removed_lines (hashes; null if none) and kept.

    A line is above the limit in a host if `in_host` different texts of the host have it: it goes from all but the first document
    (smallest doc_id) of the host with it. It is above the limit everywhere if the hosts' numbers of such texts come to `in_all`: it goes from all but the
    first document of all. So copies never remove each other wholly. The limits are numbers of texts, so they hold at any size of a host. A document that
    loses over `depleted` of its words so is rejected. Null text: no words, so it fails the base rules. A null host is a host.
    Repeated rows get equal verdicts, and rows with one doc_id and text count as one document. An empty table gives no rows. Other columns are ignored.
    """
    stats = materialize(statistics(docs, host).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")), "statistics")
    lines = stats.select("host", "text_hash", "doc_id", F.explode("lines").alias("l")).select("host", "text_hash", "doc_id", "l.line", "l.words")
    seen = lines.groupBy("host", "line", "text_hash").agg(F.min("doc_id").alias("doc_id")).groupBy("host", "line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    seen = materialize(seen, "seen_lines")
    every = seen.groupBy("line").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("n").alias("most"))
    # lines above some limit, and their hosts
    above = every.where((F.col("n") >= in_all) | (F.col("most") >= in_host)).select("line", F.when(F.col("n") >= in_all, True).alias("everywhere"), F.col("first_id").alias("first_of_all"))
    common = seen.join(above, "line").where(F.col("everywhere") | (F.col("n") >= in_host))
    common = materialize(common.select(F.col("host").alias("in_host"), F.col("line").alias("in_line"), F.when(F.col("everywhere"), F.col("first_of_all")).otherwise(F.col("first_id")).alias("first_id")), "common_lines")
    lost = lines.join(common, (F.col("line") == F.col("in_line")) & F.col("host").eqNullSafe(F.col("in_host"))).where("doc_id is null or doc_id <> first_id")
    lost = lost.select("doc_id", "text_hash", "host", "line", "words").distinct().groupBy("doc_id", "text_hash", "host").agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("line")).alias("removed_lines"))
    lost = lost.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("host").alias("s"), "removed_words", "removed_lines")
    out = stats.drop("lines").join(lost, (F.col("text_hash") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")) & F.col("host").eqNullSafe(F.col("s")), "left").drop("d", "t", "s")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= F.col("n_words") * depleted))


def keep(docs: DataFrame, host: str = "source", **options) -> DataFrame:
    """docs without the rejected rows, all columns kept under their names. A row is judged by doc_id, text and host; repeated rows stay repeated.

    text loses the lines that judge() counts in removed_words; n_chars, where there is one, is then that of the new text. Rows with
    null or empty texts are rejected; a null doc_id or host is one like any other. An empty table gives no rows.
    """
    good = judge(docs, host, **options).where("kept").select("doc_id", "text_hash", "host", "removed_lines").distinct()
    good = good.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), F.col("host").alias("s"), "removed_lines")
    rows = boxed(docs, "doc_id", "text", host).withColumnRenamed(host, "host")
    same = (text_hash(F.col("text")) == F.col("t")) & F.col("doc_id").cast("long").eqNullSafe(F.col("d")) & F.col("host").cast("string").eqNullSafe(F.col("s"))
    clean = F.udf(lambda t, lines: None if t is None else without_lines(t, lines), "string", useArrow=True)
    some = F.col("removed_lines").isNotNull()
    out = rows.join(good, same).withColumn("clean", clean(F.when(some, F.col("text").cast("string")), F.coalesce("removed_lines", F.array().cast("array<long>"))))
    new = {placed(docs, "text"): F.col("clean"), placed(docs, "n_chars"): F.char_length("clean")}
    value = lambda i: F.when(some, new[i].cast(docs.schema[i].dataType)).otherwise(F.col(f"row.c{i}")) if i in new else F.col(f"row.c{i}")
    return out.select(*(value(i).alias(f"c{i}") for i in range(len(docs.columns)))).toDF(*docs.columns)
