"""Chat logs to training text: event-sourced reconstruction, a reversible template and its loss mask; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed

#: Template, fixed: a turn is OPEN role, line feed, text, CLOSE. The escape sign is a backslash.
OPEN, CLOSE, ESCAPE = "<|turn|>", "<|end|>\n", "\\"
#: Strings that steer a chat model: escaped wherever a text or role has them.
CONTROL = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")

#: Any control string, as its first character and the rest.
_PATTERN = "([<\\[])(" + "|".join(c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in CONTROL) + ")"


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _PATTERN, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def escape_role(role: Column) -> Column:
    """As escape(), with line feeds, which end the role in the template, as a backslash and n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Pairs of backslashes are told apart first, from the left; then backslash n is a line feed and other backslashes go."""
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit("")))
    return F.array_join(parts, "\\")


def messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of an event log (conv_id, seq, msg, kind, role, text).

    Kinds, by seq within a message: `delta` appends, `edit` replaces the text so far, `regenerate` empties it (and appends its own text, if any),
    `delete` drops the message until a later event restarts it; the last role that isn't null counts. Equal seq: by kind and
    text. A null text appends nothing; an unknown or null kind counts as a delta. A message is one fold, so its events stay together;
    conversations spread over tasks.
    """
    event = F.struct("seq", F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    log = events.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(event)).alias("log"))
    # only what follows the last event that restarts the text matters
    restart = lambda e: e["kind"].isin("edit", "regenerate", "delete")
    last = F.aggregate(F.transform("log", lambda e, i: F.when(restart(e), i).otherwise(F.lit(-1))), F.lit(-1), lambda a, i: F.greatest(a, i))
    log = log.withColumn("last", last).withColumn("live", F.slice("log", F.greatest(F.col("last"), F.lit(0)) + 1, F.size("log")))
    dead = (F.size("live") == 1) & (F.col("live")[0]["kind"] == "delete")
    role = F.try_element_at(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull()), F.lit(-1))
    return log.where(~dead).select("conv_id", "msg", F.coalesce(role, F.lit("")).alias("role"), F.array_join(F.transform("live", lambda e: e["text"]), "").alias("text"))


def render(final: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask): the text of each conversation by msg and the spans [start, end) of its assistant texts, in code points of `formatted`.

    Messages with one msg go by role and text; repeats stay; null roles and texts are empty; a null conv_id is a conversation; an empty table gives
    no rows; other columns are ignored. A conversation is one row of output, so its messages meet in one task; they never exceed what a row can hold.
    Starts are running sums, so work is linear in a conversation's length.
    """
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    rows = final.select("conv_id", "msg", (F.col("role") == "assistant").alias("on"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("piece", F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE)))
    before = Window.partitionBy("conv_id").orderBy("msg", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)).cast("int"))
    start = F.col("at") + len(OPEN) + F.char_length("role") + 1
    span = F.when(F.coalesce("on", F.lit(False)), F.struct(start.alias("start"), (start + F.char_length("text")).alias("end")))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("turns"), F.array_sort(F.collect_list(span)).alias("mask"))
    return turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), "mask")


#: Characters of the parts that a text is cut into once, so that a span is taken out of few of them.
PART = 1024


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The characters [start, end) of a text given as its parts of PART characters."""
    first = F.floor(start / PART).cast("int")
    return F.substring(F.array_join(F.slice(parts, first + 1, F.floor(end / PART).cast("int") - first + 1), ""), start - first * PART + 1, end - start)


def parse(formatted: Column) -> Column:
    """The turns (role, text) back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.char_length(F.substring_index(p, "\n", 1)) + 2, F.char_length(p) - F.char_length(F.substring_index(p, "\n", 1)) - 1 - len(CLOSE))).alias("text")))


def digests(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from (formatted, mask).

    A row for each row of rendered; without a mask the loss is empty. Empty table: no rows. Work is linear in a conversation's length.
    """
    turns = rendered.withColumns({"turns": parse(F.col("formatted")), "parts": F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))})
    masked = F.array_join(F.transform("mask", lambda m: unescape(cut(F.col("parts"), m["start"], m["end"]))), "")
    turns = turns.withColumn("loss", masked)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def table_events(conversations: DataFrame) -> DataFrame:
    """Events of a table (conv_id, turn, role, text): each row is a message that starts with an edit and streams the rest as a delta.

    Rows of a conversation go by turn (null first), role and text; equal rows are messages of their own.
    """
    key = ["turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    rows = boxed(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("msg", F.row_number().over(Window.partitionBy("conv_id").orderBy(*key)))
    half = (F.char_length("text") / 2).cast("int")
    parts = F.array(
        F.struct((F.col("msg") * 2).alias("seq"), F.lit("edit").alias("kind"), F.col("role").alias("role"), F.substring(F.col("text"), F.lit(1), half).alias("text")),
        F.struct((F.col("msg") * 2 + 1).alias("seq"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.substring(F.col("text"), half + 1, F.char_length("text")).alias("text")),
    )
    return rows.select("conv_id", "msg", F.explode(parts).alias("e")).select("conv_id", "e.seq", "msg", "e.kind", "e.role", "e.text")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -7, whose texts are control strings."""
    probe = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return boxed(conversations, "conv_id", "turn", "role", "text").drop("row").unionByName(probe)
