import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm import lm


def corpus():
    rng = random.Random(1)
    subjects, verbs, things = ["cat", "dog", "bird", "child"], ["sees", "likes", "finds"], ["food", "water", "home", "grass"]
    sentence = lambda: f"the {rng.choice(subjects)} {rng.choice(verbs)} the {rng.choice(things)} ."
    return [" ".join(sentence() for _ in range(20)) for _ in range(200)], rng


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def split(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def hashed(word):
    raw = word.encode().lower()
    if len(raw) > 64:
        h = xxhash.xxh64_intdigest(raw, 42)
    else:
        h = 0xCBF29CE484222325
        for b in raw:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


def brute(model, text, seen):
    """Scores one token after the other from the flat parameters; seen: counts of all words."""
    sizes = [(lm.EDGE + 1) * lm.DIM, 2 * lm.WINDOW * lm.DIM, lm.DIM, (lm.CLASSES + 1) * lm.DIM, lm.CLASSES + 1, lm.TOP * lm.DIM, lm.TOP]
    parts = np.split(model.network.astype(np.float64), np.cumsum(sizes)[:-1])
    emb, pos, class_out, out = parts[0].reshape(-1, lm.DIM), parts[1].reshape(-1, lm.DIM), parts[3].reshape(-1, lm.DIM), parts[5].reshape(-1, lm.DIM)
    places = dict(zip(model.words.hashes.tolist(), model.words.places.tolist(), strict=True))
    words = split(text)
    row = lambda i: lm.EDGE if not 0 <= i < len(words) else p if (p := places.get(hashed(words[i]), -1)) >= 0 else lm.TOP + hashed(words[i]) % (1 << 64) % lm.SHARED
    other = sum(n for w, n in seen.items() if places.get(hashed(w), -1) < 0)
    total, own, unseen = 0.0, Counter(words), 0
    for i, w in enumerate(words):
        z = parts[2].copy()
        for k, d in enumerate([-3, -2, -1, 1, 2, 3]):
            z += emb[row(i + d)] * pos[k]
        h = np.tanh(z)
        logits = class_out @ h + parts[4]
        place = places.get(hashed(w), -1)
        kind = place // lm.MEMBERS if place >= 0 else lm.CLASSES
        total += logits[kind] - math.log(np.exp(logits).sum())
        if place >= 0:
            mine = out[kind * lm.MEMBERS : (kind + 1) * lm.MEMBERS] @ h + parts[6][kind * lm.MEMBERS : (kind + 1) * lm.MEMBERS]
            total += mine[place % lm.MEMBERS] - math.log(np.exp(mine).sum())
        elif hashed(w) in places:
            total += math.log(seen[w] / other)
        else:
            total += math.log((seen[w] - own[w] or 0.5) / other)
            unseen += seen[w] == own[w]
    return len(words), unseen, total


def test_scores_against_brute_force(spark, edge, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 12)
    monkeypatch.setattr(lm, "BATCH", 64)
    texts, _ = corpus()
    texts = [f"{t} Rare{i % 30}" for i, t in enumerate(texts[:40])] + [r.text for r in edge.collect() if r.doc_id != 6]
    docs = table(spark, texts)
    model = lm.train(docs)
    # of 12 known words, five are made others, as if there were more than TOP
    places = model.words.places.copy()
    places[:5] = lm.OTHER
    seen = Counter(w for t in texts for w in split(t))
    top = {h for h, p in zip(model.words.hashes.tolist(), places.tolist(), strict=True) if p >= 0}
    other = sum(n for w, n in seen.items() if hashed(w) not in top)
    model = lm.Model(lm.Words(model.words.hashes, model.words.counts, places, other), model.network, model.vocabulary)
    got = {r.doc_id: r for r in lm.score(docs, model).collect()}
    for i, t in enumerate(texts):
        n, unseen, total = brute(model, t, seen)
        assert (got[i].n_tokens, got[i].n_unseen) == (n, unseen)
        assert abs(got[i].log_likelihood - total) < 1e-3 * max(1, n)


def test_vocabulary_against_brute_force(edge):
    got = {r.word: r.n for r in lm.vocabulary(edge).collect()}
    assert got == Counter(hashed(w) for r in edge.collect() for w in split(r.text))


def test_network_beats_counts_on_held_out_texts(spark):
    """Words of the held-out texts are likelier than by the words alone, and than by the words with the word before."""
    texts, rng = corpus()
    model = lm.train(table(spark, texts[:150]), rounds=40)
    held = texts[150:]
    got = {r.doc_id: r.mean_log_likelihood for r in lm.score(table(spark, held), model).collect()}
    one = Counter(w for t in texts[:150] for w in t.split())
    two = Counter(p for t in texts[:150] for p in zip(["^", *t.split()], t.split()))
    before = Counter(a for t in texts[:150] for a in ["^", *t.split()[:-1]])
    n = sum(one.values())
    flat = [np.mean([math.log(one[w] / n) for w in t.split()]) for t in held]
    pair = [np.mean([math.log((two[a, w] + 0.1) / (before[a] + 0.1 * len(one))) for a, w in zip(["^", *t.split()], t.split())]) for t in held]
    assert np.mean(list(got.values())) > np.mean(pair) > np.mean(flat)
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    mixed = {r.doc_id: r.mean_log_likelihood for r in lm.score(table(spark, shuffled), model).collect()}
    assert sum(got[i] > mixed[i] for i in got) >= 49


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    net = lm.Network(rng.normal(0, 0.3, lm.Network.SIZE))
    wide, of, where = lm.spaced(rng.integers(0, lm.EDGE, 40), rng.integers(-1, lm.TOP, 40), np.array([0, 25, 25, 40]))
    assert (wide[np.setdiff1d(np.arange(len(wide)), where)] == lm.EDGE).all()
    (_, near, goal), *rest = lm.blocks(wide, of)
    assert not rest
    grads = lm.Network(np.zeros(lm.Network.SIZE))
    net.step(near, goal, grads)
    for i in np.argsort(-np.abs(grads.flat))[[0, 1, 10, 100, 500]]:
        at = net.flat[i]
        ends = []
        for e in (1e-4, -1e-4):
            net.flat[i] = at + e
            ends.append(-net.step(near, goal).sum() / 40)
        net.flat[i] = at
        assert abs((ends[0] - ends[1]) / 2e-4 - grads.flat[i]) < 1e-5


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    net = lm.Network(rng.normal(0, 0.3, lm.Network.SIZE))
    near = rng.integers(0, lm.EDGE, 2 * lm.WINDOW + 1)
    every = [float(net.step(near, np.array([p]))[0]) for p in [lm.OTHER, *range(lm.TOP)]]
    assert abs(np.exp(every).sum() - 1) < 1e-4


def test_classes_are_balanced_and_by_context():
    rng = np.random.default_rng(5)
    kinds = rng.permutation(np.arange(64) % 4)
    context = np.stack([rng.poisson(np.where(np.arange(8) // 2 == k, 400, 4)) for k in kinds])
    order = lm.balanced(context, 4)
    assert sorted(order) == list(range(64))
    assert all(len(set(kinds[order[16 * c : 16 * c + 16]])) == 1 for c in range(4))


def test_words_of_other_rows_tell_repeated_texts_apart(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 16)
    texts, rng = corpus()
    own = [t + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(12)) for t in texts[:60]]
    docs = table(spark, own + own[:10])
    got = {r.doc_id: r for r in lm.score(docs, lm.train(docs)).collect()}
    twice = [got[i].mean_log_likelihood for i in [*range(10), *range(60, 70)]]
    assert min(twice) > max(got[i].mean_log_likelihood for i in range(10, 60))
    assert all(got[i].n_unseen == (0 if i < 10 or i >= 60 else 12) for i in got)


def test_edges(edge, empty, clashing):
    docs = clashing([(r.doc_id, r.text) for r in edge.collect()])
    rows = lm.score(docs, lm.train(docs)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted((str(r.doc_id), len((r.text or "").encode().split())) for r in edge.collect())
    assert all((r.mean_log_likelihood is None) == (r.n_tokens == 0) and r.log_likelihood <= 0 for r in rows)
    twice = [r.log_likelihood for r in rows if r.doc_id == 2]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert lm.score(empty, lm.train(empty)).count() == 0
    assert [r.log_likelihood for r in lm.score(docs, lm.train(empty)).collect() if not r.n_tokens] == [0.0] * 3


def test_tokens_and_lookups():
    long = "x" * 64, "y" * 65, "Z" * 3000
    words, at = lm.tokens(pa.array(["a B  c\nd e", None, "", f"é {' '.join(long)}", "a"]))
    assert at.tolist() == [0, 5, 5, 5, 9, 10]
    assert words.tolist() == [hashed(w) for w in ["a", "B", "c", "d", "e", "é", *long, "a"]]
    rng = np.random.default_rng(6)
    some = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    table = lm.Words(some, some, some, 1)
    asked = np.r_[some[::3], rng.integers(-(1 << 62), 1 << 62, 5000)]
    number = {w: i for i, w in enumerate(some.tolist())}
    assert table.find(asked).tolist() == [number.get(w, -1) for w in asked.tolist()]
