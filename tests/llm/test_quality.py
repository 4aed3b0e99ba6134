from collections import Counter

from tessera.llm import quality


def brute(text):
    words = (text or "").encode().split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
    seen, repeats = set(), 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            repeats += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), repeats, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_against_brute_force(edge, spark, sf_dir):
    docs = edge.select("doc_id", "text", "source").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect())
    assert got == sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())


def test_common_lines(spark):
    body = lambda i: f"text {i} " + " ".join(f"w{i}x{k}" for k in range(20))
    menu = "Home  About Contact " * 10
    rows = [(i, f"{body(i)}\n{menu.upper() if i % 2 else menu}", "h") for i in range(30)] + [(100 + i, f"{menu}\nshort tail {i}", "h") for i in range(3)]
    rows += [(200 + i, body(999), "h") for i in range(40)]  # copies are one text
    got = {r.doc_id: (r.removed_words, r.kept) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0][0] == 0, "the first document keeps its line"
    # the menu repeats within the line, so the base rules reject these documents; what the method removes is still counted
    assert all(got[i][0] == 30 for i in range(1, 30))
    assert all(got[100 + i][0] == 30 and not got[100 + i][1] for i in range(3))
    assert all(got[200 + i] == (0, True) for i in range(40))


def test_depletion_alone_rejects(spark):
    line = " ".join(f"footer{k}" for k in range(30))
    rows = [(i, f"{line}\nown words {i} a b c d e f g h" if i % 2 else f"{line}\n" + " ".join(f"t{i}x{k}" for k in range(100)), None) for i in range(40)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].kept and got[0].removed_words == 0
    assert all(got[i].kept == (i % 2 == 0) and got[i].removed_words == 30 and not got[i].base_failed for i in range(1, 40))


def test_keep(edge, empty):
    judged = quality.judge(edge)
    assert quality.keep(edge).count() == judged.where("kept").count()
    assert quality.keep(edge).columns == edge.columns
    assert quality.keep(empty).count() == 0 and quality.judge(empty).count() == 0


def test_keep_takes_common_lines_out_of_the_text(spark):
    rng = [" ".join(f"t{i}x{k}" for k in range(30)) for i in range(40)]
    footers = [" ".join(f"foot{j}w{k}" for k in range(6)) for j in range(2)]
    rows = [(i, f"{rng[i]}\n\n  {footers[i % 2].upper()}  \nlast {i} line\n{footers[0]}", "h", -1) for i in range(40)]
    rows += [(5, rows[5][1], "h", -1), (100, "Own text of eleven words that holds no line of others", "h", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    norm = lambda x: " ".join(x.split()).lower()
    homes = {}
    for i, t in {(i, t) for i, t, _, _ in rows}:
        for x in {norm(x) for x in t.split("\n") if x.split()}:
            homes.setdefault(x, set()).add((t, i))
    texts = len({t for _, t, _, _ in rows})
    common = {x: min(i for _, i in h) for x, h in homes.items() if len({t for t, _ in h}) >= 20 and len({t for t, _ in h}) > texts * 0.1}
    assert set(common) == set(footers)
    want = []
    for i, t, s, n in rows:
        new = "\n".join(x for x in t.split("\n") if common.get(norm(x), i) == i)
        want.append((i, new, s, n if new == t else len(new)))
    assert sum(w[1] != r[1] for w, r in zip(want, rows, strict=True)) == 40
    kept = quality.keep(docs)
    assert kept.schema == docs.schema
    assert sorted(tuple(r) for r in kept.collect()) == sorted(want)
