"""Masked pseudo-likelihood: a bidirectional window network predicts every token from WINDOW words on both sides.

The vocabulary is a table of all words of the corpus and their counts, so it grows with the corpus. Its KNOWN most frequent words go to
the workers, the TOP of them are what the network tells apart: CLASSES balanced classes of words with like neighbours, a softmax over classes, then one
over the words of the class, both from the embeddings of the words around. The other words are one more class, in which a word has its share of the
counts: from the workers' table if it is known, else from the whole table by a join, without the row's own occurrences.

The network is trained in numpy by minibatches: each task passes over all its texts, and the tasks' parameters are averaged by tokens.
KNOWN, TOP and DIM bound what the driver and a worker hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, slices, text_bytes
from .quality import words_of

WINDOW, DIM = 3, 16
KNOWN, CLASSES, MEMBERS = 1 << 17, 64, 64
TOP = CLASSES * MEMBERS
#: Embeddings that the words outside TOP share by hash, and that of the places beyond both ends of a text.
SHARED = 1024
EDGE = TOP + SHARED
#: Places of words outside TOP, and of what isn't a word.
OTHER, NONE = -1, -2
#: Frequent words whose counts on either side of a word are its context, by which words get their classes.
MARKS = 64
BATCH, RATE = 32768, 0.1
#: Values in one row of a task's parameters, and the rows of one kind that are added up by different tasks.
CHUNK, SALTS = 8192, 16
SEED = 42
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Bytes up to which a word's hash is 64-bit FNV-1a, byte after byte for all words at once; longer words have XXH64.
LONG = 64


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z lower-cased), and the offsets of the rows in them."""
    raw, offsets = text_bytes(column)
    words, at = words_of(_LOWER[raw], offsets)
    out = np.full(len(words), 0xCBF29CE484222325, np.uint64)
    if not len(words):
        return out.view(np.int64), at
    bounds = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    n = np.diff(bounds)
    # in order of length, so that the words with a k-th byte are a stretch at the end
    order = np.argsort(np.minimum(n, LONG + 1).astype(np.int16), kind="stable")
    at_byte, first = bounds[:-1][order], np.searchsorted(np.minimum(n[order], LONG + 1), np.arange(LONG), side="right")
    with np.errstate(over="ignore"):
        for k in range(min(int(n.max()), LONG)):
            h = out[first[k] :]
            h ^= data[at_byte[first[k] :]]
            h *= np.uint64(0x100000001B3)
            at_byte[first[k] :] += 1
    out[order] = out.copy()
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(words[i].as_py(), SEED)
    return out.view(np.int64), at


def _texts(docs: DataFrame) -> DataFrame:
    return boxed(docs, "text").select(F.col("text").cast("string").alias("text"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of every different word of all documents: its hash and its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, n = np.unique(tokens(batch.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n)], names=["word", "n"])

    return _texts(docs).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Words:
    """The known words by hash, with their counts and, for the TOP of them, their places (class * MEMBERS + member; else OTHER)."""

    hashes: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    other: int  # tokens of all words outside TOP

    def __post_init__(self) -> None:
        """An open hash table of the words' numbers."""
        bits = max(4, (4 * len(self.hashes)).bit_length())
        slots, left = np.full(1 << bits, -1, np.int32), np.arange(len(self.hashes), dtype=np.int32)
        at = self._slot(self.hashes, bits)
        while len(left):
            free = np.flatnonzero(slots[at] < 0)
            taken, first = np.unique(at[free], return_index=True)
            slots[taken] = left[free[first]]
            rest = np.setdiff1d(np.arange(len(left)), free[first])
            left, at = left[rest], (at[rest] + 1) & (len(slots) - 1)
        object.__setattr__(self, "slots", slots)

    @staticmethod
    def _slot(words: np.ndarray, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((words.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The words' numbers; -1: not known."""
        out = np.full(len(words), -1, np.int32)
        if not len(self.hashes):
            return out
        at, left, size = self._slot(words, len(self.slots).bit_length() - 1), np.arange(len(words)), len(self.slots)
        while len(left):
            i = self.slots[at]
            same = (i >= 0) & (self.hashes[i] == words[left])
            out[left[same]] = i[same]
            more = (i >= 0) & ~same
            left, at = left[more], (at[more] + 1) & (size - 1)
        return out

    def rows(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words and their numbers, the rows of their embeddings, and their places or OTHER."""
        place = np.where(at >= 0, self.places[at], OTHER) if len(self.places) else np.full(len(words), OTHER)
        return np.where(place >= 0, place, TOP + (words.view(np.uint64) % np.uint64(SHARED)).astype(np.int64)), place


def spaced(rows: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows and places of all tokens with WINDOW times EDGE (place NONE) before each text and after the last, and where the tokens are in them.

    So a token's neighbours are those of the array, whatever text they are in.
    """
    where = np.arange(len(rows)) + WINDOW * (np.repeat(np.arange(len(at) - 1), np.diff(at)) + 1)
    size = len(rows) + WINDOW * len(at)
    wide, of = np.full(size, EDGE), np.full(size, NONE)
    wide[where], of[where] = rows, place
    return wide, of, where


def blocks(wide: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches of BATCH places with the WINDOW rows on both sides of them."""
    for s in range(WINDOW, len(wide) - WINDOW, BATCH):
        e = min(s + BATCH, len(wide) - WINDOW)
        yield s, wide[s - WINDOW : e + WINDOW], of[s:e]


def contexts(docs: DataFrame, words: Words) -> np.ndarray:
    """Counts (place, mark, side): how often a TOP word has each of MARKS words before and after it, over all documents. places are ranks here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TOP * MARKS * 2, np.int64)
        for batch in slices(batches, "text"):
            found, at = tokens(batch.column("text"))
            place = words.rows(found, words.find(found))[1]
            near = np.flatnonzero((np.diff(np.repeat(np.arange(len(at) - 1), np.diff(at))) == 0))
            for side, (one, two) in enumerate(((near + 1, near), (near, near + 1))):
                hit = (place[one] >= 0) & (place[two] >= 0) & (place[two] < MARKS)
                total += np.bincount((place[one[hit]] * MARKS + place[two[hit]]) * 2 + side, minlength=len(total))
        seen = np.flatnonzero(total)
        for s in range(0, len(seen), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(seen[s : s + (1 << 16)]), pa.array(total[seen[s : s + (1 << 16)]])], names=["code", "n"])

    table = materialize(_texts(docs).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "contexts").toArrow()
    out = np.zeros(TOP * MARKS * 2, np.int64)
    out[table.column("code").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(TOP, MARKS * 2)


def _axes(context: np.ndarray, dim: int) -> np.ndarray:
    """Principal components of the context shares' square roots."""
    x = np.sqrt(context / np.maximum(context.sum(1, keepdims=True), 1))
    x = x - x.mean(0)
    values, vectors = np.linalg.eigh(x.T @ x)
    return x @ vectors[:, ::-1][:, :dim]


def balanced(context: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The rows in an order in which equal stretches are the classes: halves by the main axis of each part, again and again; ties by row."""
    parts = [np.arange(len(context))]
    while len(parts) < classes:
        parts = [half for part in parts for order in [part[np.argsort(_axes(context[part], 1)[:, 0], kind="stable")]] for half in (order[: len(order) // 2], order[len(order) // 2 :])]
    return np.concatenate(parts)


class Network:
    """Parameters as one flat array, and views of it."""

    SHAPES = ((EDGE + 1, DIM), (2 * WINDOW, DIM), (DIM,), (CLASSES + 1, DIM), (CLASSES + 1,), (CLASSES, MEMBERS, DIM), (CLASSES, MEMBERS))
    SIZE = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, flat: np.ndarray) -> None:
        self.flat, self.parts, at = flat, [], 0
        for s in self.SHAPES:
            n = int(np.prod(s))
            self.parts.append(flat[at : at + n].reshape(s))
            at += n

    @classmethod
    def start(cls, counts: np.ndarray, other: int, context: np.ndarray) -> Network:
        """Embeddings from the contexts; the outputs begin as the words' shares of the counts, by place."""
        net = cls(np.zeros(cls.SIZE, np.float32))
        rng = np.random.default_rng(SEED)
        emb, pos, _, _, class_bias, _, bias = net.parts
        emb[:] = rng.normal(0, 0.1, emb.shape)
        axes = _axes(context, DIM)
        emb[:TOP] += axes / max(1e-6, float(axes.std()))
        pos[:] = rng.normal(0, 0.1, pos.shape) + 0.4
        by = counts.reshape(CLASSES, MEMBERS)
        class_bias[:] = np.log(np.r_[by.sum(1), other] + 0.5)
        bias[:] = np.where(by > 0, np.log(np.maximum(by, 1)), -30.0)
        return net

    @staticmethod
    def _log_softmax(x: np.ndarray) -> np.ndarray:
        x = x - x.max(1, keepdims=True)
        return x - np.log(np.exp(x).sum(1, keepdims=True))

    def step(self, wide: np.ndarray, of: np.ndarray, grads: Network | None = None) -> np.ndarray:
        """For each place of a block log P of its word or, for OTHER, of their class (NONE: 0); adds the gradients of the mean loss to grads."""
        emb, pos, hidden_bias, class_out, class_bias, out, bias = self.parts
        x, n = emb[wide], len(of)
        shifts = [*range(WINDOW), *range(WINDOW + 1, 2 * WINDOW + 1)]
        z = sum(x[d : d + n] * pos[k] for k, d in enumerate(shifts)) + hidden_bias
        real = np.flatnonzero(of != NONE)
        place, h = of[real], np.tanh(z[real])
        kind = np.where(place >= 0, place // MEMBERS, CLASSES)
        order = np.argsort(kind.astype(np.int16), kind="stable")
        real, place, h, kind = real[order], place[order], h[order], kind[order]
        every = np.arange(len(place))
        logc = self._log_softmax(h @ class_out.T + class_bias)
        found = logc[every, kind]
        if grads is not None:
            scale = np.float32(1 / max(1, len(place)))
            d = np.exp(logc)
            d[every, kind] -= 1
            d *= scale
            dh = d @ class_out
            grads.parts[3] += d.T @ h
            grads.parts[4] += d.sum(0)
        bounds = np.searchsorted(kind, np.arange(CLASSES + 1))
        for c in np.flatnonzero(np.diff(bounds)).tolist():
            s, e = bounds[c], bounds[c + 1]
            mine, own = place[s:e] - c * MEMBERS, every[: e - s]
            logm = self._log_softmax(h[s:e] @ out[c].T + bias[c])
            found[s:e] += logm[own, mine]
            if grads is not None:
                d = np.exp(logm)
                d[own, mine] -= 1
                d *= scale
                dh[s:e] += d @ out[c]
                grads.parts[5][c] += d.T @ h[s:e]
                grads.parts[6][c] += d.sum(0)
        if grads is not None:
            dz = np.zeros((n, DIM), np.float32)
            dz[real] = dh * (1 - h * h)
            grads.parts[2] += dz.sum(0)
            back = np.zeros((len(wide), DIM), np.float32)
            for k, d in enumerate(shifts):
                grads.parts[1][k] += np.einsum("nd,nd->d", dz, x[d : d + n])
                back[d : d + n] += dz * pos[k]
            flat = grads.parts[0].reshape(-1)
            flat += np.bincount((wide[:, None] * DIM + np.arange(DIM)).ravel(), weights=back.ravel(), minlength=len(flat)).astype(np.float32)
        score = np.zeros(n)
        score[real] = found
        return score


def _fit(docs: DataFrame, words: Words, net: Network) -> Network:
    """One pass over all texts: every task trains from the same start, then the mean of the tasks' parameters by tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((words, net.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, (known, flat) = None, shared.value
        seen = 0
        for batch in slices(batches, "text"):
            found, at = tokens(batch.column("text"))
            if not len(found):
                continue
            if mine is None:
                mine, grads, squares = Network(flat.copy()), Network(np.zeros_like(flat)), np.full_like(flat, 1e-6)
            wide, of, _ = spaced(*known.rows(found, known.find(found)), at)
            for _, near, goal in blocks(wide, of):
                grads.flat[:] = 0
                mine.step(near, goal, grads)
                squares += grads.flat * grads.flat
                mine.flat -= np.float32(RATE) * grads.flat / np.sqrt(squares)
            seen += len(found)
        if seen:
            salt = TaskContext.get().partitionId() % SALTS
            for c in range(0, Network.SIZE, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([salt]), pa.array([seen]), pa.array([mine.flat[c : c + CHUNK].tobytes()], pa.binary())], names=["chunk", "salt", "n", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for c, n, part in zip(*(batch.column(k).to_pylist() for k in ("chunk", "n", "part")), strict=True):
                old = sums.setdefault(c, [0, 0.0])
                old[0] += n
                old[1] = old[1] + n * np.frombuffer(part, np.float32).astype(np.float64)
        for c, (n, part) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([n]), pa.array([part.tobytes()], pa.binary())], names=["chunk", "n", "part"])

    trained = _texts(docs).mapInArrow(run, "chunk long, salt long, n long, part binary")
    summed = materialize(trained.repartition("chunk", "salt").mapInArrow(add, "chunk long, n long, part binary"), "parameters").toArrow()
    total, out = {}, np.zeros(Network.SIZE)
    for c, n, part in sorted(zip(*(summed.column(k).to_pylist() for k in ("chunk", "n", "part")), strict=True)):
        out[c : c + CHUNK] += np.frombuffer(part, np.float64)
        total[c] = total.get(c, 0) + n
    if not total:
        return net
    return Network((out / total[0]).astype(np.float32))


@dataclass(frozen=True)
class Model:
    words: Words
    network: np.ndarray
    vocabulary: DataFrame  # (word, n), whole


def train(docs: DataFrame, rounds: int = 1) -> Model:
    """A model of all texts, by `rounds` passes over them; small corpora need more than one. Null texts have no words; an empty corpus gives a model that knows no word.

    Repeated rows count repeatedly; other columns are ignored. A rerun over differently dealt texts gives slightly different averages.
    """
    whole = materialize(vocabulary(docs), "vocabulary")
    most = whole.orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()
    total = whole.agg(F.sum("n")).first()[0] or 0
    word, n = most.column("word").to_numpy(), most.column("n").to_numpy()
    rank = np.where(np.arange(len(word)) < TOP, np.arange(len(word)), OTHER)
    by_hash = np.argsort(word)
    ranked = Words(word[by_hash], n[by_hash], rank[by_hash], int(total - n[:TOP].sum()))
    context = contexts(docs, ranked)
    order = balanced(context)
    place = np.empty(TOP, np.int64)
    place[order] = np.arange(TOP)
    words = Words(ranked.hashes, ranked.counts, np.where(ranked.places >= 0, place[ranked.places], OTHER), ranked.other)
    counts = np.zeros(TOP, np.int64)
    counts[place[: min(TOP, len(n))]] = n[:TOP]
    net = Network.start(counts, words.other, context[order])
    for _ in range(rounds):
        net = _fit(docs, words, net)
    return Model(words, net.flat, whole)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_unseen, log_likelihood, mean_log_likelihood) for every row; without tokens 0, 0, 0.0 and null. Null text: no tokens.

    log_likelihood sums log P(word | the words around it). A word that isn't known has the share of its occurrences outside the row;
    if there are none, it counts half of one, and in n_unseen. Repeated rows are scored one by one and count as outside of one another. Other columns are
    ignored, an empty table gives no rows, a text is scored whole.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.words, model.network))  # of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat = shared.value
        net, row = Network(flat), TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            found, at = tokens(batch.column("text"))
            known = words.find(found)
            rows, place = words.rows(found, known)
            wide, of, where = spaced(rows, place, at)
            by_place = np.zeros(len(wide))
            for s, near, goal in blocks(wide, of):
                by_place[s : s + len(goal)] = net.step(near, goal)
            share = np.where((known >= 0) & (place < 0), np.log(np.maximum(words.counts[known] if len(words.counts) else 1, 1) / max(1, words.other)), 0.0)
            total = np.r_[0.0, np.cumsum(share + by_place[where])]
            # words that aren't known, by row: hash and count
            strange = np.flatnonzero(known < 0)
            row_of, word = np.repeat(np.arange(len(at) - 1), np.diff(at))[strange], found[strange]
            order = np.lexsort((word, row_of))
            row_of, word = row_of[order], word[order]
            first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (row_of[1:] != row_of[:-1])]) if len(word) else np.empty(0, np.int64)
            times = np.diff(np.r_[first, len(word)])
            ends = np.searchsorted(row_of[first], np.arange(len(at))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (word[first], times)]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(n)), batch.column("doc_id"), pa.array(np.diff(at)), pa.array(total[at[1:]] - total[at[:-1]]), *lists], names=["row", "doc_id", "n_tokens", "inner", "words", "times"])
            row += n

    rows = boxed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = materialize(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, inner double, words array<long>, times array<long>"), "scored")
    strange = scored.where("size(words) > 0").select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    outside = F.coalesce(F.col("n") - F.col("times"), F.lit(0))
    outside = F.when(outside > 0, outside.cast("double")).otherwise(0.5)
    share = F.ln(outside / F.lit(float(max(1, model.words.other)))) * F.col("times")
    found = strange.join(model.vocabulary, "word", "left").groupBy("row").agg(F.sum(share).alias("outer"), F.sum(F.when(outside < 1, F.col("times")).otherwise(0)).alias("n_unseen"))
    out = scored.join(found, "row", "left").withColumn("log_likelihood", F.col("inner") + F.coalesce("outer", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", F.coalesce("n_unseen", F.lit(0)).cast("long").alias("n_unseen"), "log_likelihood", F.expr("if(n_tokens > 0, log_likelihood / n_tokens, null)").alias("mean_log_likelihood"))
