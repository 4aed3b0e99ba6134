import hashlib

from pyspark.sql import functions as F

from tessera.llm import chat

TEXTS = ["hi", "", None, "a\\b \\\\ <|turn|> <|end|>\n", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>", "[\\INST] <\\|end|>", "\\", "é😀\n\n", "<|im_start|>user\n", "<<<|end|>>", "[[INST]]", "x" * 20000]


def expect(rows):
    said = "".join(f"{r}\n{t or ''}\n" for r, t in rows)
    loss = "".join(t or "" for r, t in rows if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha(said), len(loss), sha(loss)


def test_round_trip(spark):
    rows = [(c, t, ("user", "assistant", "we\\ird\nrole", "[INST]\\n")[(c + t) % 4], TEXTS[(c * 5 + t) % len(TEXTS)]) for c in range(13) for t in range(c % 5 + 1)]
    rows += [(50, 1, "assistant", "same"), (50, 1, "assistant", "same"), (50, 1, "assistant", "b"), (50, None, "user", "first")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.render(chat.messages(chat.table_events(chat.with_probe(table))))).collect()
    convs = {}
    for c, t, r, x in sorted(rows + [(-7, 0, "user", TEXTS[4]), (-7, 1, "assistant", TEXTS[4])], key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2], r[3] or "")):
        convs.setdefault(c, []).append((r, x))
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {c: expect(v) for c, v in convs.items()}


def test_no_control_string_survives(spark):
    df = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(TEXTS)], "conv_id long, turn long, role string, text string")
    for r in chat.render(chat.messages(chat.table_events(df))).collect():
        inside = r.formatted[len(chat.OPEN) + len("user\n") : -len(chat.CLOSE)]
        assert not any(c in inside for c in chat.CONTROL)


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 3, 1, "delta", None, "lo"), (1, 2, 1, "delta", None, "hel"), (1, 1, 1, "edit", "user", ""),
        (1, 4, 2, "delta", "assistant", "bad draft"), (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "good"), (1, 7, 2, "edit", None, "better"), (1, 8, 2, "delta", None, "!"),
        (1, 9, 3, "delta", "user", "gone"), (1, 10, 3, "delete", None, None),
        (1, 11, 4, "delete", "user", None), (1, 12, 4, "delta", None, "back"),
        (None, 1, 1, None, None, "no kind"),
    ]
    got = chat.messages(spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string")).collect()
    assert sorted((str(r.conv_id), r.msg, r.role, r.text) for r in got) == [("1", 1, "user", "hello"), ("1", 2, "assistant", "better!"), ("1", 4, "user", "back"), ("None", 1, "", "no kind")]


def test_empty_and_other_columns(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, mask string, seq long")
    assert chat.digests(chat.render(chat.messages(chat.table_events(df)))).count() == 0
    one = spark.createDataFrame([(1, 0, None, None, "m", 9)], "conv_id long, turn long, role string, text string, mask string, seq long")
    assert chat.digests(chat.render(chat.messages(chat.table_events(one)))).select(F.col("n_turns")).first()[0] == 1


def test_long_conversations_and_spans_over_parts(spark, clashing):
    rows = [(1, i, "assistant" if i % 2 else "user", "😀</s>é" * (i % 700) + f"turn {i}") for i in range(1500)] + [(None, 0, "assistant", None), (None, 0, "assistant", None)]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.render(chat.messages(chat.table_events(log)))).collect()}
    said = "".join(t for _, _, r, t in rows[:1500] if r == "assistant")
    assert got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].loss_chars == len(said) and got[1].n_turns == 1500
    assert got[None].n_turns == 2 and got[None].loss_chars == 0
    assert chat.digests(chat.render(chat.messages(chat.table_events(log.limit(0))))).count() == 0
