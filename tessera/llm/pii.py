"""Personal data in text: base expressions, then bootstrapped contextual extraction; DataFrame functions only.

The bootstrap co-trains two views. Base spans are the seeds; candidates are parts of a text of a like form that no base span touches: numbers in
one or more groups, dotted numbers, addresses with a written-out sign. An instance (a value) has spelling patterns, its shape, and lexical ones: one or two
words before it, after it, or one on both sides. A pattern's confidence in a kind is the kind's part of what is known of its instances; an instance's
comes from the sure patterns that it is found with. Both are scored in turn until nothing changes, and candidates that are sure become spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize

KINDS = ("email", "ip", "card", "phone")

#: The base expressions, fixed. Possessive where a run can't be given back anyway, so that no text makes them slow or deep:
#: the next character never belongs to the run. An e-mail address starts where its run of characters does, or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for an expression to be tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.char_length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    term = lambda i: F.when(i % 2 == 0, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(found, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    return F.when(F.char_length(digits).between(14, 19), _luhn(digits)).otherwise(False)


def _located(text: Column, pattern: str, valid) -> Column:
    """Valid matches of a pattern as structs (start, end, value), in code points: the lengths of the pieces between matches give the starts."""
    gaps, hits = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(gaps, hits, lambda g, h: F.struct(F.char_length(g).alias("gap"), h.alias("value"))), lambda x: x["value"].isNotNull())
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string>>")

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.char_length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(valid(x["value"]), F.concat(a["found"], F.array(span))).otherwise(a["found"]).alias("found"))

    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), step)["found"]).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans of a text as structs (start, nth, end, kind, value) in order; nth is the kind's place in KINDS."""
    every = []
    for nth, kind in enumerate(KINDS):
        found = _located(text, BASE[kind], lambda v, k=kind: _valid(k, v))
        if kind in NEEDS:
            found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string>>"))
        every.append(F.transform(found, lambda x: F.struct(x["start"], F.lit(nth).alias("nth"), x["end"], F.lit(kind).alias("kind"), x["value"])))  # noqa: B023
    return F.array_sort(F.concat(*every))


#: White space and the rest, as in WORD.
_WS, _INK = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Candidates: addresses (an at sign or a written one), dotted numbers (dots may be in brackets), numbers of groups, single numbers.
_AT, _DOT = r"(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)", r"(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)"
CANDIDATE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++" + _AT + r"[A-Za-z0-9-]++(?:" + _DOT + r"[A-Za-z0-9-]++)++"
    r"|(?<![A-Za-z0-9])[0-9]{1,5}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,5}){3,5}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])[+(]{0,2}[0-9]{1,6}(?:[\x20()./-]{1,2}[0-9]{1,6}){1,7}+(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])\+?[0-9]{6,19}+(?![A-Za-z0-9])"
)
#: Digits that a number needs to be a candidate.
LEAST_DIGITS = 7
#: Characters beside an instance that are looked at, the longest word and the longest gap of a pattern; words that are longer make no pattern.
REACH, LONGEST, GAP = 144, 64, 4

_CANDIDATES = "array<struct<start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.char_length(F.regexp_replace(value, "[^0-9]", ""))


def _address(value: Column) -> Column:
    return F.regexp_like(value, F.lit(_AT))


def _dotted(value: Column) -> Column:
    return F.regexp_like(value, F.lit(r"\A[0-9]+(?:[\[(]?\.[\])]?[0-9]+){3,5}\z"))


def _may_be(kind: Column, value: Column) -> Column:
    """Whether a candidate's form allows the kind."""
    number = ~_address(value) & ~_dotted(value)
    return F.when(kind == "email", _address(value)).when(kind == "ip", _dotted(value)).when(kind == "card", number & (_digits(value) >= 8)).otherwise(number)


def candidates(text: Column, base: Column) -> Column:
    """Candidates of a text that overlap none of its base spans, as structs (start, end, value)."""
    found = _located(text, CANDIDATE, lambda v: _address(v) | (_digits(v) >= LEAST_DIGITS))
    none = F.from_json(F.lit("[]"), _CANDIDATES)
    event = lambda x, turn: F.struct(x["start"], F.lit(turn).alias("turn"), x["end"], x["value"])
    events = F.array_sort(F.concat(F.transform(base, lambda x: event(x, 0)), F.transform(found, lambda x: event(x, 1))))

    def step(a: Column, x: Column) -> Column:
        """A base span takes back the last candidate if that reaches into it; a candidate counts if the base spans so far end before it."""
        kept = a["kept"]
        back = F.when((F.size(kept) > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0)) > x["start"]), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        more = F.when(x["start"] >= a["reach"], F.concat(kept, F.array(F.struct(x["start"], x["end"], x["value"])))).otherwise(kept)
        return F.struct(F.when(x["turn"] == 0, F.greatest(a["reach"], x["end"])).otherwise(a["reach"]).alias("reach"), F.when(x["turn"] == 0, back).otherwise(more).alias("kept"))

    clear = F.aggregate(events, F.struct(F.lit(0).alias("reach"), none.alias("kept")), step)["kept"]
    return F.when(F.size(found) == 0, none).when(F.size(base) == 0, found).otherwise(clear)


def _patterns(text: Column, span: Column) -> Column:
    """The patterns of a span: l1, l2, r1, r2, b (words before, after, on both sides, lower-cased, digits as 0) and s (the shape of its value)."""
    size = F.char_length(text)
    left = F.concat(F.when(span["start"] <= REACH, "\n").otherwise(""), F.substring(text, F.greatest(span["start"] - (REACH - 1), F.lit(1)), F.least(span["start"], F.lit(REACH))))
    right = F.concat(F.substring(text, span["end"] + 1, F.lit(REACH)), F.when(span["end"] + REACH >= size, "\n").otherwise(""))
    word, gap = f"{_INK}{{1,{LONGEST}}}", f"{_WS}{{1,{GAP}}}"
    maybe = f"{_WS}{{0,{GAP}}}"
    plain = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), f"{_WS}+", " "), "[0-9]", "0")
    before = lambda e: plain(F.regexp_extract(left, f"(?<={_WS})({e}{maybe})\\z", 1))
    after = lambda e: plain(F.regexp_extract(right, f"\\A({maybe}{e})(?={_WS})", 1))
    l1, r1 = before(word), after(word)
    value = span["value"]
    shape = F.when(_address(value), F.regexp_replace(value, "[A-Za-z0-9_%+-]+", "a")).when(_dotted(value), F.regexp_replace(value, "[0-9]+", "0")).otherwise(F.regexp_replace(value, "[0-9]", "0"))
    named = [("l1", l1), ("l2", before(f"{word}{gap}{word}")), ("r1", r1), ("r2", after(f"{word}{gap}{word}")), ("b", F.when((l1 != "") & (r1 != ""), F.concat_ws(" _ ", l1, r1)).otherwise("")), ("s", shape)]
    return F.filter(F.array(*(F.when(p != "", F.concat(F.lit(f"{n}:"), p)) for n, p in named)), lambda p: p.isNotNull())


def _with_patterns(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["kind"], x["value"], _patterns(F.col("text"), x).alias("patterns")))


def bootstrap(seen: DataFrame, rounds: int = 8, support: int = 3, sure: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Sure patterns (pattern, kind, confidence) and instances (value, kind, sureness) of a graph (pattern, value, kind); kind is null where value isn't a seed.

    A pattern's confidence in a kind: the sureness of its instances in the kind, summed up, over that in all kinds plus one; it is sure from
    `sure`, with `support` different instances that are sure themselves. An instance's sureness in a kind that its form allows: 1 - the product of (1 - confidence)
    over its sure patterns; seeds keep 1. Rounds end when the sure instances stay the same, or after `rounds`.
    """
    graph = materialize(seen.select("pattern", "value").distinct(), "pattern_graph")
    seeds = materialize(seen.where("kind is not null").select("value", "kind", F.lit(1.0).alias("sureness")).distinct(), "seeds")
    unseen = materialize(graph.join(seeds.select("value").distinct(), "value", "left_anti"), "unseen")
    instances, patterns, before = seeds, None, None
    for _ in range(rounds):
        scored = graph.join(instances, "value").groupBy("pattern", "kind").agg(F.sum("sureness").alias("held"), F.count_if(F.col("sureness") >= sure).alias("backed"))
        totals = scored.groupBy("pattern").agg(F.sum("held").alias("all_held"), F.max(F.struct("held", "kind", "backed")).alias("x"))
        patterns = totals.select("pattern", F.col("x.kind").alias("kind"), (F.col("x.held") / (F.col("all_held") + 1)).alias("confidence"), F.col("x.backed").alias("backed"))
        patterns = materialize(patterns.where((F.col("backed") >= support) & (F.col("confidence") >= sure)).select("pattern", "kind", "confidence"), "sure_patterns")
        found = unseen.join(patterns, "pattern").where(_may_be(F.col("kind"), F.col("value"))).groupBy("value", "kind").agg((1 - F.exp(F.sum(F.ln(1 - F.col("confidence"))))).alias("sureness"))
        instances = materialize(seeds.unionByName(found), "instances")
        now = instances.where(F.col("sureness") >= sure).agg(F.count("*"), F.bit_xor(F.xxhash64("value", "kind"))).first()
        if now == before:
            break
        before = now
    return patterns, instances.where(F.col("sureness") >= sure)


def find(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, base, added) for every row: spans as structs (start, nth, end, kind, value) in order, in code points of the whole text.

    Added are the candidates whose value is sure; its kind is the surest, then the first of KINDS. A null text is empty. Repeated rows get equal spans. An empty
    table gives no rows. Other columns are ignored. Work grows with a text's length times the identifiers in it.
    """
    rows = boxed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("maybe", F.when(F.regexp_like("text", F.lit("[0-9@]|[(\\[\\x20]at[)\\]\\x20]")), candidates(F.col("text"), F.col("base"))).otherwise(F.from_json(F.lit("[]"), _CANDIDATES)))
    maybe = F.transform("maybe", lambda x: F.struct(x["start"], x["end"], F.lit(None).cast("string").alias("kind"), x["value"]))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "base", _with_patterns(F.col("base")).alias("seeds"), _with_patterns(maybe).alias("maybe"))
    rows = materialize(rows, "spans")
    seen = rows.select(F.explode(F.concat("seeds", "maybe")).alias("s")).select(F.explode("s.patterns").alias("pattern"), "s.value", "s.kind")
    _, instances = bootstrap(seen, **options)
    nth = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int") - 1
    best = instances.groupBy("value").agg(F.max(F.struct("sureness", (-nth).alias("order"), "kind")).alias("k")).select(F.col("value").alias("v"), F.struct((-F.col("k.order")).alias("nth"), "k.kind").alias("k"))
    new = rows.where("size(maybe) > 0").select("doc_id", "text_hash", F.explode("maybe").alias("m")).join(best, F.col("m.value") == F.col("v"))
    new = new.select("doc_id", "text_hash", F.struct(F.col("m.start").alias("start"), F.col("k.nth").alias("nth"), F.col("m.end").alias("end"), F.col("k.kind").alias("kind"), F.col("m.value").alias("value")).alias("x")).distinct()
    new = new.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("x")).alias("added")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "added")
    out = rows.select("doc_id", "text_hash", "base").join(new, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    return out.select("doc_id", "base", F.coalesce("added", F.slice("base", 1, 0)).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans, with those the bootstrap added."""
    found = find(docs, **options)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = {f"n_{k}": count(k) for k in KINDS}
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").alias("n_added"))
