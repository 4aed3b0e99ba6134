"""Byte-level BPE: words of a batch are walked as a trie, each prefix is encoded once, from the last tokens of shorter prefixes.

The encoding of a prefix ends in exactly one token t, and what precedes t is the encoding of a shorter prefix: t is the one whose last
neighbour there would stay beside it. So the state of a trie node is one last token, found from the states of its ancestors; a word's
encoding is read back along them. Work is linear in the different prefixes, also within one word of megabytes.

Nothing is shuffled: a task encodes its own batches, keeps the words it has met up to WORDS of them, and needs the vocabulary only.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, slices

#: How byte-level vocabularies split text into words, fixed.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Letters and digits that are newer than the Unicode tables the tokenizers library splits by, fixed: neither letter nor digit there.
NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB
11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191
191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
""".split()
_NEWER = regex.compile("[" + "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in NEWER) + "]")
#: Different words that a task remembers before it starts anew.
WORDS = 1 << 19


class Vocabulary:
    """Tokens and merges of a byte-level BPE file; small, and the same for every task."""

    def __init__(self, pieces: dict[int, bytes], ranks: dict[tuple[int, int], tuple[int, int]], specials: dict[str, int]):
        self.pieces, self.ranks, self.specials = pieces, ranks, specials


def load(path: str) -> Vocabulary:
    """The vocabulary of a tokenizers file. Raises ValueError for one that isn't plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split, added = file["model"], file["pre_tokenizer"] or {}, file["added_tokens"]
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [k for a in added for k in ("single_word", "lstrip", "rstrip", "normalized") if a[k]]
    if odd or model["type"] != "BPE" or file["normalizer"] or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
        raise ValueError(f"{os.path.basename(path)} isn't plain byte-level BPE {odd}")
    # the alphabet of such files: printable Latin-1 stands for itself, the other bytes follow from 256
    same = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte = {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in same)}
    ids = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    pieces = {i: bytes(byte[c] for c in t) for t, i in ids.items()} | {a["id"]: a["content"].encode() for a in added}
    return Vocabulary(pieces, {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}, {a["content"]: a["id"] for a in added})


def suffixes(tokens: dict[bytes, int]) -> tuple[dict[int, int], list[int], list[tuple]]:
    """(go, fail, ends): steps from state << 8 | byte, the state of the longest proper suffix, and the (length, id) of tokens that end in a state, longest first."""
    go: dict[int, int] = {}
    ends: list[tuple] = [()]
    for piece, i in tokens.items():
        state = 0
        for byte in piece:
            to = go.setdefault(state << 8 | byte, len(ends))
            if to == len(ends):
                ends.append(())
            state = to
        ends[state] = ((len(piece), i),)
    fail = [0] * len(ends)
    steps: list[list[tuple[int, int]]] = [[] for _ in ends]
    for key, to in go.items():
        steps[key >> 8].append((key & 255, to))
    level = [0]
    while level:
        below = []
        for state in level:
            for byte, to in steps[state]:
                other = fail[state]
                while state and other and other << 8 | byte not in go:
                    other = fail[other]
                fail[to] = go.get(other << 8 | byte, 0) if state else 0
                ends[to] += ends[fail[to]]
                below.append(to)
        level = below
    return go, fail, ends


class Encoder:
    """Encodes by a vocabulary; remembers at most `words` different words, and as many neighbours."""

    def __init__(self, vocabulary: Vocabulary, words: int = WORDS):
        self.words, self.ranks, self.pieces = words, vocabulary.ranks, vocabulary.pieces
        special = set(vocabulary.specials.values())
        self.of = {piece: i for i, piece in self.pieces.items() if i not in special}
        self.go, self.fail, self.ends = suffixes(self.of)
        self.specials = {s: np.uint32(i).tobytes() for s, i in vocabulary.specials.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.known: dict[str, bytes] = {}
        self.sides: dict[int, tuple[list, list] | None] = {}
        self.beside: dict[tuple[int, int], bool] = {}

    def edges(self, token: int) -> tuple[list, list] | None:
        """(left, right): what stands at either end of a token while its bytes are merged, lowest rank first and leftmost among equals,
        each with the rank that ends it. None for a token that its bytes don't merge into."""
        if token not in self.sides:
            piece = self.pieces[token]
            ids, left, right = [self.of[piece[i : i + 1]] for i in range(len(piece))], [], []
            while pairs := [(self.ranks[pair][0], i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in self.ranks]:
                rank, i = min(pairs)
                if i == 0:
                    left.append((ids[0], rank))
                if i == len(ids) - 2:
                    right.append((ids[-1], rank))
                ids[i : i + 2] = [self.ranks[ids[i], ids[i + 1]][1]]
            never = len(self.ranks)
            self.sides[token] = ([*left, (token, never)], [*right, (token, never)]) if ids == [token] else None
        return self.sides[token]

    def fits(self, before: int, token: int) -> bool:
        """Whether `token` stays as it is behind the token `before` (-1: at a word's start).

        It doesn't if a merge crosses the border: a pair of what stands there on both sides whose rank comes before those that end its parts,
        an equal one on the left being first.
        """
        found = self.beside.get((before, token))
        if found is None:
            if len(self.beside) >= self.words:
                self.beside.clear()
            found = self.edges(token) is not None
            if found and before >= 0:
                across = ((self.ranks.get((a, b)), x, y) for a, x in self.edges(before)[1] for b, y in self.edges(token)[0])
                found = not any(merge and merge[0] < x and merge[0] <= y for merge, x, y in across)
            self.beside[before, token] = found
        return found

    def walk(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids): depth first over the trie of the words. In byte order they are its leaves from left to right; the stack holds
        the states of the path from the root, and going on to the next leaf drops those below the branch."""
        path, states, places = b"", [-1], [0]
        go, fail, ends, beside = self.go, self.fail, self.ends, self.beside
        for word in sorted(words):
            depth = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                depth += 1
            del states[depth + 1 :], places[depth + 1 :]
            place = places[depth]
            for end in range(depth + 1, len(word) + 1):
                byte = word[end - 1]
                while (to := go.get(place << 8 | byte)) is None:
                    if not place:
                        raise ValueError("a byte without a token")
                    place = fail[place]
                place = to
                places.append(place)
                for n, token in ends[place]:
                    before = states[end - n]
                    found = beside.get((before, token))
                    if found or found is None and self.fits(before, token):
                        states.append(token)
                        break
            path, ids, end = word, [], len(word)
            while end:
                ids.append(states[end])
                end -= len(self.pieces[states[end]])
            yield word, ids[::-1]

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        there = set().union(*split)
        new = there - self.known.keys()
        if len(self.known) + len(new) > self.words:  # what these texts share with earlier ones is frequent
            self.known = {w: ids for w, ids in self.known.items() if w in there}
        self.known.update((word.decode("utf-8"), struct.pack(f"<{len(ids)}I", *ids)) for word, ids in self.walk(w.encode("utf-8") for w in new))
        return [b"".join(map(self.known.__getitem__, s)) for s in split]

    def split(self, text: str) -> list[str]:
        """Words of a text, and the added tokens in it."""
        if self.cut is None or not any(s in text for s in self.specials):
            return words(text)
        self.known |= self.specials
        return [w for i, part in enumerate(self.cut.split(text)) for w in ([part] if i % 2 else words(part))]


def _latin(pattern: str) -> re.Pattern:
    """A pattern for text below U+0100: its classes spelt out, so that the quicker engine takes it."""
    of = {kind: "".join(re.escape(chr(c)) for c in range(256) if regex.fullmatch(kind, chr(c))) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(of.values()) + "]").replace(r"\S", f"[^{of[r'\s']}]")
    for kind, chars in of.items():
        pattern = pattern.replace(kind, f"[{chars}]")
    return re.compile(pattern)


_LATIN = _latin(SPLIT.pattern)


def words(text: str) -> list[str]:
    try:
        text.encode("latin-1")
        return _LATIN.findall(text)
    except UnicodeEncodeError:
        if _NEWER.search(text):
            return [text[m.start() : m.end()] for m in SPLIT.finditer(_NEWER.sub("\uffff", text))]
        return SPLIT.findall(text)


def decoded(ids: bytes, pieces: dict[int, bytes]) -> str:
    """The text of ids as little-endian unsigned 32-bit integers, with replacement characters for what isn't UTF-8; unknown ids have none."""
    return b"".join([pieces.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def _encoder(name: str, shared) -> Encoder:
    """The encoder of this worker; its tasks share what it remembers."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(shared.value)
    return _encoders[name]


def _shared(df: DataFrame, path: str):
    """(name, vocabulary) for the workers; its size is that of the file at `path`, which only the driver needs to have."""
    return uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(load(path))


def _mapped(rows: DataFrame, schema: str, column: str, f) -> DataFrame:
    """rows (key, column) with the columns that f(values) gives; batches are cut so that a task holds few megabytes beside its longest text."""

    def run(batches):
        for part in slices(batches, column):
            out = f(part.column(column))
            yield pa.RecordBatch.from_arrays([part.column("key"), *out.values()], names=["key", *out])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, {schema}")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return boxed(docs, key, text).select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _ids(values: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(v) // 4 for v in values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(values), "<u4").astype(np.int32)))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) for every row of docs, ids an array of ints, as the tokenizers library encodes whole texts without adding special tokens.

    The strings of added tokens in a text become their ids. Null and empty texts have no ids; null keys and repeated rows stay; an empty table gives no
    rows; other columns are ignored, whatever they are called. A text's ids are one value, so it is bounded by what a row can hold.
    """
    name, shared = _shared(docs, path)

    def f(column: pa.Array) -> dict[str, pa.Array]:
        return {"ids": _ids(_encoder(name, shared).encoded(column.to_pylist()))}

    return _mapped(_texts(docs, key, text), "ids array<int>", "text", f).withColumnRenamed("key", key)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) for every row of tokens (key, ids), special tokens included. Null ids and null members give no text; ids that the file lacks neither."""
    _, shared = _shared(tokens, path)

    def run(batches):
        pieces = shared.value.pieces
        for b in batches:
            for at in range(0, b.num_rows, 64):  # the longest ids are as long as the longest texts
                part = b.slice(at, 64)
                out = [decoded(np.array([i for i in v or () if i is not None], "<u4").tobytes(), pieces) for v in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.string())], names=["key", "text"])

    rows = boxed(tokens, key, ids).select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encode() and decode() in one pass, digests of what both gave. Edge rows as in encode()."""
    name, shared = _shared(docs, path)

    def f(column: pa.Array) -> dict[str, pa.Array]:
        ids = _encoder(name, shared).encoded(column.to_pylist())
        back = [decoded(i, shared.value.pieces) for i in ids]
        return {
            "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
            "decoded_sha256": pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in back]),
        }

    return _mapped(_texts(docs, key, text), "n_tokens long, ids_sha256 string, decoded_sha256 string", "text", f).withColumnRenamed("key", key)
