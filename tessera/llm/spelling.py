"""Spelling variants: words within one edit are found by automata over the two halves of every word.

Of two words one edit apart, the edit leaves one half of the shorter word whole: the first half stands at the other word's start, or the second
half at its end. Automaton shards hold both halves of every word; words are scanned, a match counts at its offset and between words whose
lengths differ by one at most; then one half of the other half must agree too, and what is left is verified.

A half's shard follows from the word's length and the half's outer characters, so a word is scanned in the four places that can hold a
match, not in all shards. Where many words share such a place, it is a grid of blocks, and no task holds more than a block of each side.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, release, slices

#: Letters of words, fixed: Latin-1, so a word is a byte a character inside tasks. Everything else is a space; only A to Z are lower-cased.
_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0xC0 else 32 for i in range(256))
#: Different words that a task counts before it passes them on.
COUNTED = 1 << 17
#: Outer characters of a half that its place is named by.
OUTER = 6
#: Rows of a shard, and words on one side of a block of a frequent place.
SHARD, BLOCK = 8192, 4096
#: Bytes of candidates that are verified at once.
VERIFIED = 1 << 20


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters, in Latin-1, A to Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def misspelt(run: bytes, key: int, every: int) -> bytes:
    """run without one character, for one run in `every` by its checksum; key is the checksum of what precedes it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode("utf-8"), key)
    at = h % len(run)
    return run if not every or h % every else run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 31, chars: int = 7, least: int = 2) -> DataFrame:
    """(word, n): words of at least `chars` characters with at least `least` occurrences in all texts.

    One run in `every` loses a character, by the checksum of its row's key and itself (0: none does). A null key's checksum is that of an empty key; null and
    empty texts have no words; repeated rows count again; an empty table gives no rows; other columns are ignored. Tasks count their own words
    first, COUNTED at a time, so a word in every text crosses the shuffle once a task.
    """
    if chars < 2:
        raise ValueError("a word of one character has no halves")

    def counted(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        found: Counter = Counter()
        for part in slices(batches, "text"):
            for drawn, t in zip(part.column("drawn").to_pylist(), part.column("text").to_pylist(), strict=True):
                before = zlib.crc32(f"{drawn}:".encode())
                for r, n in Counter(runs(t)).items():
                    if len(r) >= chars and len(w := misspelt(r, before, every)) >= chars:
                        found[w] += n
            if len(found) >= COUNTED:
                yield counted(found)
                found = Counter()
        yield counted(found)

    rows = boxed(docs, key, text).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("drawn"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _places(word: Column, length: Column) -> list[Column]:
    """Where a word is held or scanned, as if it were of `length`: the outer characters of its first and its second half, and the length."""
    first, second = F.floor(length / 2).cast("int"), (length - F.floor(length / 2)).cast("int")
    of = lambda side, part: F.concat(F.lit(side), length.cast("string"), F.lit(":"), part)
    return [of("<", F.substring(word, F.lit(1), F.least(first, F.lit(OUTER)))), of(">", F.substring(word, -F.least(second, F.lit(OUTER)), F.lit(OUTER)))]


def _dealt(words: DataFrame) -> DataFrame:
    """(shard, held, word, n): each word where its halves are held, and where it is scanned for halves of words as long, or shorter by one."""
    word, length = F.col("word"), F.char_length("word")
    place = lambda held, p: F.struct(F.lit(held).alias("held"), p.alias("place"))
    own, shorter = _places(word, length), _places(word, length - 1)
    places = F.array(*(place(True, p) for p in own), *(place(False, p) for p in own + shorter))
    rows = words.select("word", "n", F.explode(places).alias("at")).select("word", "n", "at.*")
    side = lambda held: F.ceil(F.count(F.when(F.col("held") == held, 1)) / F.lit(BLOCK)).cast("int")
    blocks = rows.groupBy("place").agg(side(True).alias("rows"), side(False).alias("columns")).where("rows > 1 or columns > 1")
    # a block of the held words meets every block of the scanned ones; most places are a single block, and those that aren't are few
    rows = rows.join(materialize(blocks, "blocks"), "place", "left").withColumns({"rows": F.greatest("rows", F.lit(1)), "columns": F.greatest("columns", F.lit(1))})
    own = F.pmod(F.xxhash64("word"), F.when(F.col("held"), F.col("rows")).otherwise(F.col("columns"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("held"), F.col("columns")).otherwise(F.col("rows")) - 1)
    rows = rows.select("place", "held", "word", "n", own.alias("own"), F.explode(others).alias("other"))
    shards = max(1, 6 * words.count() // SHARD)
    cell = F.xxhash64("place", F.when(F.col("held"), F.col("own")).otherwise(F.col("other")), F.when(F.col("held"), F.col("other")).otherwise(F.col("own")))
    return rows.select(F.pmod(cell, F.lit(shards)).alias("shard"), "held", "word", "n")


def quarters(rest: str, length: int) -> tuple[tuple[int, str], tuple[int, str]]:
    """What stands before and behind the middle of a part of `length` characters, in what another word has in its place: an edit leaves one of them whole."""
    front = length // 2
    return (0, rest[:front]), (1, rest[len(rest) - (length - front) :])


def automaton(of_length: dict[int, list[str]]) -> ahocorasick.Automaton:
    """Finds both halves of every word: each gives (its length, numbers of words by side, the word's length and either quarter of the other half)."""
    held: dict[str, dict[tuple, list[int]]] = {}
    for length, words in of_length.items():
        for i, w in enumerate(words):
            halves = w[: length // 2], w[length // 2 :]
            for side, half in enumerate(halves):
                of = held.setdefault(half, {})
                other = halves[1 - side]
                for quarter in quarters(other, len(other)):
                    of.setdefault((side, length, *quarter), []).append(i)
    out = ahocorasick.Automaton()
    for half, of in held.items():
        out.add_word(half, (len(half), of))
    out.make_automaton()
    return out


def one_apart(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of characters differ by exactly one edit; both of one length (replaced), or `long` has one more (inserted)."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(1) == 1
    ahead, behind = short != long[:, :-1], short != long[:, 1:]
    m = short.shape[1]
    first = np.where(ahead.any(1), ahead.argmax(1), m)  # all before it are equal from the left
    last = np.where(behind.any(1), m - 1 - behind[:, ::-1].argmax(1), -1)  # all after it are equal from the right
    return last < first


def _by_length(words: list[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def _rows(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)


def near(held: list[str], scanned: list[str]) -> set[tuple[str, str]]:
    """(held word, scanned word) one edit apart, the held one shorter, or as long and before it."""
    if not held:
        return set()
    of_length = _by_length(held)
    found, rows = automaton(of_length), {n: _rows(words, n) for n, words in of_length.items()}
    out: set[tuple[str, str]] = set()
    for m, words in _by_length(scanned).items():
        there = _rows(words, m)
        # candidates by the held word's length: numbers of held words, and for each match the scanned word's number and how many they are
        waiting = {length: (array("q"), [], []) for length in (m, m - 1) if length in rows}

        def verify(length: int, m=m, words=words, there=there, waiting=waiting) -> None:
            numbers, by, counts = waiting[length]
            i, j = np.array(numbers, np.int64), np.repeat(np.array(by, np.int64), np.array(counts, np.int64))
            hits = np.flatnonzero(one_apart(rows[length][i], there[j]))
            pairs = ((of_length[length][a], words[b]) for a, b in zip(i[hits].tolist(), j[hits].tolist(), strict=True))
            out.update(p for p in pairs if length < m or p[0] < p[1])
            waiting[length] = (array("q"), [], [])

        for j, w in enumerate(words):
            for end, (n, of) in found.iter(w):
                for side, fits in ((0, end + 1 == n), (1, end + 1 == m)):
                    for length in waiting if fits else ():
                        if n == (length // 2, length - length // 2)[side]:
                            for quarter in quarters(w[: m - n] if side else w[n:], length - n):
                                if some := of.get((side, length, *quarter)):
                                    numbers, by, counts = waiting[length]
                                    numbers.extend(some)
                                    by.append(j)
                                    counts.append(len(some))
                                    if len(numbers) * m >= VERIFIED:
                                        verify(length)
        for length in list(waiting):
            verify(length)
    return out


def links(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for words (word, n) one edit apart, each pair in one direction. Words are distinct, not null and Latin-1."""

    def found(table: pa.Table) -> pa.Table:
        rows = {}  # a word can be held, or scanned, for both halves
        for row in zip(*(table.column(c).to_pylist() for c in ("held", "word", "n")), strict=True):
            rows[row[:2]] = row[2]
        pairs = sorted(near([w for h, w in rows if h], [w for h, w in rows if not h]))
        return pa.table(
            [pa.array([w for w, _ in pairs], pa.string()), pa.array([rows[True, w] for w, _ in pairs], pa.int64()), pa.array([w for _, w in pairs], pa.string()), pa.array([rows[False, w] for _, w in pairs], pa.int64())],
            names=["word", "n", "other", "other_n"],
        )

    # a pair can meet in two shards, if the edit lies between the halves
    return _dealt(words).groupBy("shard").applyInArrow(found, "word string, n long, other string, other_n long").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): forms are followed to the last, twice as far each round. n grows tenfold a step, so rounds are few."""
    now = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.where("moved").limit(1).count():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(now)
        now = after
    return now.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 31, chars: int = 7, least: int = 2, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the vocabulary() of docs: how many words are one edit away, the most frequent of them (ties: the first by code
    point) if it is `times` as frequent as the word, and the end of the chain of such forms, else null, and the word itself as root. Edge rows as in vocabulary()."""
    words = materialize(vocabulary(docs, key, text, every, chars, least), "words")
    pairs = links(words)
    both = F.array(F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    ends = pairs.select(F.explode(both).alias("e")).select("e.*")
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    enough = -F.col("best.order") >= times * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.order")).alias("form_n")
    )
    found = materialize(found, "variants")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
