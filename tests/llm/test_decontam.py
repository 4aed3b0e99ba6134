import random

from tessera.llm import decontam


def edit_distance(pattern, text):
    """Smallest distance of pattern to any part of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(last[j - 1] + (p != c), last[j] + 1, row[-1] + 1))
    return min(row)


def test_myers_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        d = edit_distance(p, t)
        assert decontam.distance(p, t, 1000)[0] == d
        assert (decontam.distance(p, t, d - 1) is None) and decontam.distance(p, t, d)[0] == d


def test_matches_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 40)))) for i in range(12)] + [(90, None), (91, ""), (None, "an item without an id is no item of the benchmark at all")]
    docs = []
    for i in range(40):
        t = items[i % 12][1]
        edits = rng.randint(0, len(t) // 6)
        s = list(t)
        for _ in range(edits):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [s[k], "q"]])
        docs.append((i, " ".join(word() for _ in range(20)) + " " + "".join(s).upper() + "\n " + " ".join(word() for _ in range(20))))
    docs += [(100, None), (101, "")]
    got = {(r.doc_id, r.item_id) for r in decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i) for d, t in docs for i, x in items if x and i is not None and edit_distance(decontam.normal(x), decontam.normal(t)) <= len(decontam.normal(x)) * 8 // 100}
    assert got == want and want


def test_budget_is_the_rate():
    assert [decontam.budget(n) for n in (12, 13, 20, 100, 300, 600)] == [0, 1, 1, 8, 24, 48]


def test_passages_at_the_whole_budget_are_found():
    """Edits spread evenly, so that every piece but one is hit."""
    rng = random.Random(3)
    for n in (60, 100, 300):
        item = "".join(rng.choice("abcdefghij ") for _ in range(n)).replace("  ", "ab").strip() + "x"
        k = decontam.budget(len(item))
        matcher = decontam.Matcher([(1, item)], decontam.ERROR_RATE)
        for spare in range(k + 1):
            s = list(item)
            for p in range(k + 1):
                if p != spare:
                    s[(len(item) * p // (k + 1) + len(item) * (p + 1) // (k + 1)) // 2] = "Z"
            assert matcher.search("before it " + "".join(s) + " after")[0][0] == k
            s[len(item) * spare // (k + 1) + 1] = "Z"
            assert matcher.search("before it " + "".join(s) + " after") == {}


def test_items_of_any_length_and_without_id_remove(spark):
    docs = spark.createDataFrame([(1, "The cat sat"), (2, "dog"), (3, None), (4, "An unnamed passage of the benchmark, whole."), (5, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " Cat "), (None, "unnamed passage of the benchmark"), (8, None), (9, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.distance, r.budget) for r in decontam.matches(docs, items).collect()) == [(1, 7, 0, 0)]
    assert decontam.matches(docs, items, least=20).count() == 0
    assert sorted(r.doc_id for r in decontam.clean(docs, items).collect()) == [2, 3, 5]
    assert sorted(r.doc_id for r in decontam.clean(docs, items, least=20).collect()) == [1, 2, 3, 5]


def test_long_repetitive_texts():
    item = "ab " * 40
    matcher = decontam.Matcher([(1, decontam.normal(item))], decontam.ERROR_RATE)
    assert matcher.search(decontam.normal("ab " * 20000))[0][0] == 0
    assert matcher.search(decontam.normal("ab " * 30 + "xyz " * 5000)) == {}


def test_blocks_and_clean(spark, monkeypatch, edge, empty, clashing):
    items = spark.createDataFrame([(i, f"item number {i} has a passage of its own that nobody else would write {i}") for i in range(6)], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    docs = spark.createDataFrame([(i, f"before. Item  NUMBER {i} has a passage of its own that nobody else would write {i}!", "s") for i in range(6)] + [(9, "clean text", "s")], "doc_id long, text string, other string")
    assert {(r.doc_id, r.item_id, r.distance) for r in decontam.matches(docs, items).where("distance = 0").collect()} == {(i, i, 0) for i in range(6)}
    assert [tuple(r) for r in decontam.clean(docs, items).collect()] == [(9, "clean text", "s")]
    clash = clashing([(1, f"so: {docs.first().text}"), (1, "clean"), (None, None)])
    assert sorted(map(str, decontam.clean(clash, items).collect())) == sorted(map(str, clash.where("text is null or text = 'clean'").collect()))
    assert decontam.clean(edge, items).count() == edge.count() and decontam.clean(empty, items).count() == 0
    assert decontam.matches(edge, items.limit(0)).count() == 0 and decontam.clean(edge, items.limit(0)).count() == edge.count()
