"""Benchmark decontamination: pigeonhole pieces find candidate places, Myers' bit-parallel distance verifies them.

An item with error budget k is cut into k + 1 pieces: a passage within k edits of it holds at least one piece unchanged, at
its place up to k characters. All pieces form one automaton. A hit is verified up a binary tree of joined pieces: a part of j
pieces that lies in a passage within the budget has, on some path, at most j - 1 edits, so a chance hit fails at a short part and
only few reach the whole item.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, slices

#: Edits allowed for each character of an item.
ERROR_RATE = 0.08
#: Characters of items in one automaton; more items are searched in further blocks.
BLOCK_CHARS = 4 << 20


def normal(text: str | None) -> str:
    """Lower-cased, words joined by single spaces."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = ERROR_RATE) -> int:
    """Edits that a passage of an item of this length may have: the rate, rounded down."""
    return int(length * rate)


def distance(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """The smallest edit distance of pattern to a part of text and where that part ends; None if it is over `most`. Myers (1999)."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        hp = (minus | ~(d0 | plus)) & full
        hm = plus & d0
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = hp << 1 & full, hm << 1 & full
        plus, minus = (hm | ~(d0 | hp)) & full, hp & d0
        if score < best[0]:
            best = (score, j)
    return best if best[0] <= most else None


@cache
def parents(piece: int, pieces: int) -> tuple[tuple[int, int], ...]:
    """The parts [low, high) of two pieces and more that hold a piece, from the smallest on, when halves are halved down to single pieces."""
    low, high, out = 0, pieces, []
    while high - low > 1:
        out.append((low, high))
        middle = (low + high) // 2
        low, high = (low, middle) if piece < middle else (middle, high)
    return tuple(reversed(out))


class Matcher:
    """The pieces of a block of items, for search in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for p in range(k + 1):
                places.setdefault(t[len(t) * p // (k + 1) : len(t) * (p + 1) // (k + 1)], []).append((n, p))
        self.pieces = ahocorasick.Automaton()
        for piece, where in places.items():
            self.pieces.add_word(piece, (len(piece), where))
        if places:
            self.pieces.make_automaton()

    def search(self, text: str) -> dict[int, tuple[int, int]]:
        """For each item that text holds within its budget: its number, the distance and the end of the passage."""
        found: dict[int, tuple[int, int]] = {}
        tested: dict[tuple[int, int, int, int], tuple[int, int] | None] = {}
        if not len(self.pieces):
            return found
        for last, (length, where) in self.pieces.iter(text):
            for n, p in where:
                if n in found and not found[n][0]:
                    continue
                _, item, k = self.items[n]
                size, m = len(item), k + 1
                start = last + 1 - length - size * p // m  # where the item begins if nothing before the piece is edited
                if start >= 0 and text.startswith(item, start):
                    found[n] = (0, start + size)
                    continue
                hit = None
                for low, high in parents(p, m):
                    part = (n, start, low, high)
                    if part not in tested:
                        begin, end, most = size * low // m, size * high // m, high - low - 1
                        edge = max(0, start + begin - most)
                        d = distance(item[begin:end], text[edge : max(0, start + end + most)], most)
                        tested[part] = (d[0], edge + d[1]) if d else None
                    hit = tested[part]
                    if hit is None:
                        break
                if hit and (n not in found or hit[0] < found[n][0]):
                    found[n] = hit
        return found


_matchers: dict[str, Matcher] = {}


def _blocks(items: DataFrame, least: int, named: bool) -> Iterator[list[tuple[int, str]]]:
    """Items of at least `least` characters in blocks of bounded size, one after the other; each goes to the executors on its own. Not `named`: without regard to ids."""
    block, chars = [], 0
    for row in boxed(items, "item_id", "text").select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        t = normal(row["t"])
        if not t or len(t) < least or named and row["i"] is None:
            continue
        if block and chars + len(t) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((row["i"] if named else 0, t))
        chars += len(t)
    yield block


def _worker(name: str, items: list[tuple[int, str]], rate: float) -> Matcher:
    if name not in _matchers:
        _matchers.clear()  # one automaton at a time
        _matchers[name] = Matcher(items, rate)
    return _matchers[name]


def matches(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, least: int = 0) -> DataFrame:
    """(doc_id, item_id, distance, budget, match_end) for every row of docs and item that its whole text holds within the budget.

    Both sides are normalised as normal() does; match_end counts code points of the normalised text. The distance is the
    smallest found at a place that holds a piece, so exact passages have 0. Items under `least`
    characters are left out, none unless it is set. Empty and null texts and items match nothing, nor does an item without id; repeated rows match repeatedly, an empty
    table gives no rows, other columns are ignored. Work is in proportion to the pieces found, of which a long repetitive text holds many.
    Items are read in blocks of BLOCK_CHARS, each a scan of its own.
    """
    def one(block: list[tuple[int, str]]) -> DataFrame:
        shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _worker(name, shared.value, rate)
            for batch in slices(batches, "text"):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    rows += [(doc, matcher.items[n][0], d, matcher.items[n][2], end) for n, (d, end) in sorted(matcher.search(normal(text)).items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=["doc_id", "item_id", "distance", "budget", "match_end"])

        rows = boxed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(run, "doc_id long, item_id long, distance long, budget long, match_end long")

    out = None
    for block in _blocks(items, least, True):
        out = one(block) if out is None else out.unionAll(one(block))
    return out


def clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, least: int = 0) -> DataFrame:
    """docs without the rows that hold an item; all columns stay, whatever they are called, and no row moves to another task.

    As in matches(), but an item needs no id. Null and empty texts hold nothing and stay; repeated rows go or stay together; an empty table, or one without items, comes back as it is.
    Between two blocks of items what is left is written, so a worker holds one automaton at a time.
    """
    at = docs.columns.index("text") if "text" in docs.columns else [c.lower() for c in docs.columns].index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def one(rows: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _worker(name, shared.value, rate)
            for batch in slices(batches, f"c{at}"):
                yield batch.filter(pa.array([not matcher.search(normal(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    first = True
    for block in _blocks(items, least, False):
        if block:
            plain, first = one(plain if first else materialize(plain, "clean"), block), False
    return plain.toDF(*docs.columns)
