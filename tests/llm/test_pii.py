import hashlib
import math
import random
import re

from tessera.llm import pii

EXPRESSIONS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TRICKY = [
    "a@b.c_x@d.e.f a.b@c.d@e.f", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4 0000000000255.1.1.1", "+1 (743) 555-3824 4111 1111 1111 1111 4111-1111-1111-1111é 4242424242424242", None, "", "9" * 5000, "1 " * 4000,
    "é+49 30 1234567890." + "a" * 30000 + "@x.y", "😀 1.2.3.4 x@y.z", "+1+2 33333333333+", "x@y.", "@a.b", "a@b.c-", "4111111111111111 4111111111111112",
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()


def brute(text):
    return sorted((m.start(), n, m.end(), k) for n, (k, e) in enumerate(EXPRESSIONS.items()) for m in e.finditer(text or "") if valid(k, m[0]))


def test_base_against_brute_force(spark, sf_dir, edge, empty):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.report(docs).collect():
        spans = brute(texts[r.doc_id])
        assert hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest() == r.base_sha256, r
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[3] == k for s in spans) for k in pii.KINDS]
    assert pii.report(edge).count() == 10 and pii.report(empty).count() == 0


WS = " \t\n\x0b\x0c\r"


def shape(v):
    if re.search(pii._AT, v):
        return re.sub("[A-Za-z0-9_%+-]+", "a", v)
    if re.fullmatch(r"[0-9]+([\[(]?\.[\])]?[0-9]+){3,5}", v):
        return re.sub("[0-9]+", "0", v)
    return re.sub("[0-9]", "0", v)


def allowed(kind, v):
    address, dotted, digits = "a" in shape(v), "." in v and bool(re.fullmatch(r"[0-9]+([\[(]?\.[\])]?[0-9]+){3,5}", v)), len(re.sub("[^0-9]", "", v))
    return {"email": address, "ip": dotted, "card": not address and not dotted and digits >= 8, "phone": not address and not dotted}[kind]


def side(words, n):
    """The first n words of a list of (gap, word), joined, or nothing if one is missing, too long or too far off."""
    got = words[:n]
    if len(got) < n or any(len(w) > 64 or len(g) > 4 for g, w in got):
        return ""
    return got


def pattern_set(text, start, end, value):
    plain = lambda x: re.sub("[0-9]", "0", re.sub(f"[{WS}]+", " ", x.lower()))
    before = re.findall(f"([^{WS}]*)([{WS}]*)", text[:start])[:-1]
    before = [(g, w) for w, g in reversed(before) if w]
    after = [(g, w) for g, w in re.findall(f"([{WS}]*)([^{WS}]+)", text[end:])]
    out = {"s": shape(value)}
    if l1 := side(before, 1):
        out["l1"] = plain(l1[0][1] + l1[0][0])
    if l2 := side(before, 2):
        out["l2"] = plain(l2[1][1] + l2[1][0] + l2[0][1] + l2[0][0])
    if r1 := side(after, 1):
        out["r1"] = plain(r1[0][0] + r1[0][1])
    if r2 := side(after, 2):
        out["r2"] = plain("".join(g + w for g, w in r2))
    if l1 and r1:
        out["b"] = out["l1"] + " _ " + out["r1"]
    return {f"{k}:{v}" for k, v in out.items()}


def brute_added(texts, rounds=8, support=3, sure=0.75):
    """The added spans of every text."""
    graph, seeds, places = set(), set(), []
    for n, text in enumerate(t or "" for t in texts):
        base = brute(text)
        for a, _, b, k in base:
            seeds.add((text[a:b], k))
            graph |= {(p, text[a:b]) for p in pattern_set(text, a, b, text[a:b])}
        for m in re.finditer(pii.CANDIDATE, text):
            if ("a" in shape(m[0]) or len(re.sub("[^0-9]", "", m[0])) >= 7) and not any(a < m.end() and b > m.start() for a, _, b, _ in base):
                places.append((n, m.start(), m.end(), m[0]))
                graph |= {(p, m[0]) for p in pattern_set(text, *places[-1][1:])}
    known, before = {s: 1.0 for s in seeds}, None
    for _ in range(rounds):
        held, backed = {}, {}
        for p, v in graph:
            for (w, k), s in known.items():
                if w == v:
                    held.setdefault(p, {}).setdefault(k, 0.0)
                    held[p][k] += s
                    backed[p, k] = backed.get((p, k), 0) + (s >= sure)
        patterns = {}
        for p, by in held.items():
            k = max(by, key=lambda k: (by[k], k))
            if backed[p, k] >= support and by[k] / (sum(by.values()) + 1) >= sure:
                patterns[p] = (k, by[k] / (sum(by.values()) + 1))
        known = {s: 1.0 for s in seeds}
        for v in {v for _, v in graph} - {v for v, _ in seeds}:
            for k in pii.KINDS:
                left = math.prod(1 - c for p, w in graph if w == v and p in patterns for x, c in [patterns[p]] if x == k)
                if left < 1 and allowed(k, v):
                    known[v, k] = 1 - left
        now = {x for x, s in known.items() if s >= sure}
        if now == before:
            break
        before = now
    best = {}
    for (v, k), s in known.items():
        if s >= sure:
            best[v] = max(best.get(v, (0, -9, "")), (s, -pii.KINDS.index(k), k))
    out = [[] for _ in texts]
    for n, a, b, v in places:
        if v in best:
            out[n].append((a, pii.KINDS.index(best[v][2]), b, best[v][2]))
    return out


def planted(seed):
    """Texts that hold seeds and unseen identifiers in the same contexts, and numbers that are no identifiers in others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = lambda: next(d for d in iter(lambda: digits(16), 0) if luhn(d))
    unseen = {
        "email": (lambda: f"write to {word()}@{word()}.com soon", lambda: f"{word()}.{word()} (at) {word()} (dot) org", lambda x: f"write to {x} soon"),
        "phone": (lambda: f"please call +1 ({digits(3)}) 555-{digits(4)} after noon", lambda: f"({digits(3)}) 555-{digits(4)}", lambda x: f"please call {x} after noon"),
        "ip": (lambda: f"login from host 10.{rng.randrange(256)}.{rng.randrange(256)}.1 failed", lambda: f"10[.]{rng.randrange(256)}[.]{rng.randrange(256)}[.]1", lambda x: f"login from host {x} failed"),
        "card": (lambda: f"paid by card {card()} today", lambda: digits(12), lambda x: f"paid by card {x} today"),
    }
    texts, want = [], []
    fill = lambda: " ".join(word() for _ in range(rng.randint(3, 9)))
    for kind, (seed_text, value, context) in unseen.items():
        for _ in range(8):
            texts.append(f"{fill()} {seed_text()} {fill()}")
            want.append(None)
        for _ in range(5):
            v = value()
            texts.append(f"{fill()} {context(v)} {fill()}")
            want.append((kind, texts[-1].index(v), texts[-1].index(v) + len(v)))
    for _ in range(20):
        texts.append(f"{fill()} order number {digits(rng.choice([9, 13]))} shipped {fill()} on 2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} {fill()}")
        want.append(None)
    return texts, want


def test_bootstrap_recovers_planted_identifiers(spark):
    """Precision and recall over the planted unseen identifiers of all kinds."""
    texts, want = planted(1)
    got = {r.doc_id: [(a.kind, a.start, a.end) for a in r.added] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = sum(w in got[i] for i, w in enumerate(want) if w)
    assert found == sum(w is not None for w in want) == 20
    assert sum(map(len, got.values())) == found


def test_bootstrap_against_brute_force(spark, sf_dir):
    texts = planted(2)[0] + [t for t in TRICKY if len(t or "") < 1000] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["a\tto  x@y.z   b", "x" * 70 + " 4111111111111111", "to     4242424242424242", "call +1 (743) 555-3824 555-38241234567 and 10.0.0.1.7"]
    want = brute_added(texts)
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sum(map(len, want)) == sum(r.n_added for r in rows) > 20
    for r in rows:
        spans = sorted(brute(texts[r.doc_id]) + want[r.doc_id])
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_bootstrap_finds_what_sure_patterns_enclose(spark):
    seeds = ["4111111111111111", "4242424242424242", "5555555555554444", "4012888888881881", "378282246310005"]
    rows = [(i, f"Some talk. Charge card no. {s} today") for i, s in enumerate(seeds)]
    rows += [(10, "Charge card no. 99881234567 today"), (11, "The part 99887766554 is in stock"), (12, "in room 12345678 at noon")]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10].n_added == 1 and got[10].spans == "card:16:27" and got[10].n_card == 0
    assert got[11].n_added == 0 and got[12].n_added == 0
    assert all(got[i].n_card == 1 and got[i].n_added == 0 for i in range(5))


def test_other_columns_may_be_called_anything(clashing):
    docs = clashing([(1, "a@b.c"), (1, "a@b.c"), (None, None), (2, "")])
    assert sorted((str(r.doc_id), r.n_email) for r in pii.report(docs).collect()) == [("1", 1), ("1", 1), ("2", 0), ("None", 0)]
