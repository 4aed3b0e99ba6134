import random
import re
import zlib
from collections import Counter

import numpy as np

from tessera.llm import spelling


def counted(rows):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def apart(a, b):
    """Edit distance by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def by_hand(rows):
    n = counted(rows)
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and apart(w, v) == 1] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def table(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows.collect()}


def corpus(seed, n):
    """Texts whose words are edits of a few, some of them chains in which each form is tenfold its variant."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randrange(7, 10))) for _ in range(30)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(30):
            w = words[min(int(rnd.expovariate(0.2)), 29)]
            for _ in range(rnd.choice([0] * 12 + [1, 1, 2])):
                at, c = rnd.randrange(len(w)), rnd.choice("abcdé")
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
            text.append(w.title() if rnd.random() < 0.1 else w)
        rows.append((i, rnd.choice([" ", ", ", "\n", "1", "—"]).join(text)))
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = corpus(1, 300) + [(1000 + i, "abcdefgh abcdefgh") for i in range(600)] + [(5000, "abcdefg abcdefg " * 3), (5001, "abcdeg abcdefg bcdefg " * 2), (5002, "ab" * 40 + " " + "ab" * 40 + "a"), (5003, "ab" * 40 + " " + "ab" * 40 + "a")]
    want = by_hand(rows)
    assert sum(w[0] is not None for w in want.values()) > 5 and max(w[3] for w in want.values()) > 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(spelling.variants(docs)) == want
    # frequent places as grids of blocks, and many shards
    monkeypatch.setattr(spelling, "BLOCK", 3)
    monkeypatch.setattr(spelling, "SHARD", 16)
    assert table(spelling.variants(docs)) == want


def test_chains_end_at_their_root(spark):
    words = [("aaaaaaaa", 2000), ("aaaaaaab", 200), ("aaaaaabb", 20), ("aaaaabbb", 2), ("zzzzzzzz", 3)]
    docs = spark.createDataFrame([(1, " ".join(w for w, n in words for _ in range(n)))], "doc_id long, text string")
    got = table(spelling.variants(docs, every=0))
    assert got["aaaaabbb"] == ("aaaaaabb", "aaaaaaaa", 2, 1, 20)
    assert got["aaaaaaaa"][:2] == (None, "aaaaaaaa") and got["zzzzzzzz"] == (None, "zzzzzzzz", 3, 0, None)


def test_halves_miss_no_pair():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(7, 11))) for _ in range(700)})
    got = spelling.near(words, words)
    want = {(a, b) for a in words for b in words if (len(a), a) < (len(b), b) and abs(len(a) - len(b)) <= 1 and apart(a, b) == 1}
    assert got == want
    assert spelling.near([], words) == spelling.near(words, []) == set()


def test_verification():
    rows = lambda *w: np.array([list(x.encode()) for x in w], np.uint8)
    assert spelling.one_apart(rows("abc", "abc", "abc"), rows("abc", "abd", "add")).tolist() == [False, True, False]
    assert spelling.one_apart(rows("abc", "abc", "abc", "aaa"), rows("xabc", "abcx", "axcb", "aaaa")).tolist() == [True, True, False, True]


def test_tables(spark, edge, empty, clashing):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert table(spelling.variants(edge)) == by_hand(rows)
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(clashing([(1, "something something"), (None, None)])).count() == 1
    long = "letters" * 30_000
    got = table(spelling.variants(spark.createDataFrame([(1, f"{long} {long} {long}x {long}x")], "doc_id long, text string"), every=0))
    assert {len(w): v[3] for w, v in got.items()} == {len(long): 1, len(long) + 1: 1}
