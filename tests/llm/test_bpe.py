import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LATE = [chr(int(x, 16)) for r in bpe.NEWER for x in r.split("-")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(PATH)


def made(seed, n, alphabet, longest):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(longest))) for _ in range(n)]


TEXTS = [
    *made(1, 400, [chr(c) for c in range(32, 127)], 60),
    *made(2, 400, [*" \t\n\r\x85\xa0\x1c  '", "a", "é", "ß", "²", "٣", "中", "é", "😀", "<|endoftext|>", "'ll", "'S", "’s", *LATE[:20]], 40),
    *made(3, 50, "ab", 600),
    *made(4, 50, "etaoinshrdlu", 400),
    "", "a" * 3000, " " * 3000, "<|endoftext|>" * 3, "<|endoftext", "it's I'LL they've",
]


def test_encodes_as_the_library_does(vocabulary, library):
    encoder = bpe.Encoder(vocabulary)
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encoded(TEXTS)]
    assert got == [x.ids for x in library.encode_batch(TEXTS, add_special_tokens=False)]


def test_remembers_few_words(vocabulary):
    small, large = bpe.Encoder(vocabulary, words=50), bpe.Encoder(vocabulary)
    for at in range(0, len(TEXTS), 10):
        assert small.encoded(TEXTS[at : at + 10]) == large.encoded(TEXTS[at : at + 10])
    assert len(small.beside) <= 50


def test_decodes_as_the_library_does(vocabulary, library):
    rnd = random.Random(5)
    for _ in range(2000):  # most of these aren't whole UTF-8
        ids = [rnd.randrange(50257) for _ in range(8)]
        assert bpe.decoded(np.array(ids, "<u4").tobytes(), vocabulary.pieces) == library.decode(ids, skip_special_tokens=False)


def test_words_of_every_code_point(library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 4096):
        text = "".join(f"a{c}1{c}. {c}" for c in chars[at : at + 4096])
        assert bpe.words(text) == [text[i:j] for _, (i, j) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_one_long_word_is_linear(vocabulary):
    word = "".join(random.Random(6).choice("etaoinshrdlu") for _ in range(200_000))
    (ids,) = bpe.Encoder(vocabulary).encoded([word])
    assert bpe.decoded(ids, vocabulary.pieces) == word


def test_shared_prefixes_are_encoded_once(vocabulary):
    encoder, seen = bpe.Encoder(vocabulary), []
    encoder.ends = type("Ends", (), {"__getitem__": lambda _, place, ends=encoder.ends: seen.append(place) or ends[place]})()
    list(encoder.walk([b"international", b"internationally", b"interns", b"internet", b"internationally"[:5]]))
    prefixes = {w[:i] for w in (b"internationally", b"interns", b"internet") for i in range(1, len(w) + 1)}
    assert len(seen) == len(prefixes)


def test_tables(spark, edge, empty, clashing, library):
    rows = bpe.round_trip(edge, PATH).collect()
    assert len(rows) == edge.count()
    texts = {r["doc_id"]: r["text"] or "" for r in edge.collect()}
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.round_trip(empty, PATH).count() == 0
    back = bpe.decode(bpe.encode(edge, PATH), PATH).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in back) == sorted((k is None, k or 0, t or "") for k, t in ((r["doc_id"], r["text"]) for r in edge.collect()))
    assert bpe.encode(clashing([(1, "a b"), (None, None)]), PATH).count() == 2
    odd = spark.createDataFrame([(1, None), (2, [None, 64, 99_999])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(odd, PATH).collect()} == {1: "", 2: "a"}


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.load(public_tokenizers.path("word_bpe_49k.json"))
