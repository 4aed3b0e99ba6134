"""URL filter: host and path rules, then the log-likelihood ratio of two character models; DataFrame functions only.

The models are Markov models of ORDER characters with interpolated smoothing down to shorter contexts: one of accepted and one of rejected URLs.
N-grams are exact: a table with a row for each different window of ORDER characters, as large as the URLs make it. Shorter n-grams are sums of its
rows. A URL's windows are joined to the table's log ratios; frequent windows are dealt to SALTS keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize

#: Characters of a window: one and the longest context before it.
ORDER = 4
#: Weight of the shorter context in the smoothing, as counts, and the share of a character without any context.
PRIOR, FLAT = 4.0, 1 / 128
#: Marks the start of a URL for the first characters.
PAD = "\x02" * (ORDER - 1)
#: Keys that the rows of one window, or of one URL, are dealt to in joins.
SALTS = 8


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


#: The rules of the registered query, fixed.
RULES = (Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"))
#: Words in a host that mark rejected training URLs, beside those that a rule blocks.
BAD_WORDS = ("casino", "pills", "spam", "adult", "bets", "ads-", "porn", "viagra")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: the host runs from after the first :// up to / ? # or the end, A-Z lower-cased, the path from there up to ? # or the end."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule (host and path together) that fits, as a struct (rule, verdict), else null. A rule fits its host and all subdomains; of equally long ones the first counts."""
    ordered = sorted(rules, key=lambda r: -len(r.host + r.path))
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    return F.coalesce(*(F.when(fits(r), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered))


def windows(url: Column) -> Column:
    """The windows of ORDER characters that end at each character of a URL, lower-cased, padded at its start. One pass over the URL."""
    chars = F.regexp_extract_all(F.concat(F.lit(PAD), F.lower(url)), F.lit("(?s)."), F.lit(0))
    return F.when(url == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(ORDER), F.greatest(F.size(chars), F.lit(ORDER))), lambda i: F.array_join(F.slice(chars, i - (ORDER - 1), F.lit(ORDER)), "")))


def ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio) for every row of (gram, a, r): log P(last character | those before) of the accepted minus that of the rejected.

    a and r are the window's counts in the classes; windows that no class has must be rows too if they are asked for. The probability under k
    characters of context is (count + PRIOR * that under k - 1) / (count of the context + PRIOR), and FLAT under less than none.
    """
    every = counts.select("gram", "a", "r", *(F.substring("gram", ORDER - k + 1, k).alias(f"g{k}") for k in range(1, ORDER + 1)))
    total = counts.agg(F.sum("a").alias("ca"), F.sum("r").alias("cr")).select("ca", "cr", F.lit(1).alias("one"))
    known = None
    for k in range(1, ORDER + 1):
        own = every.groupBy(f"g{k}").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        if k == 1:
            # one row of totals, as the context of no characters
            own = own.withColumn("one", F.lit(1)).join(total, "one").withColumns({"sa": F.lit(FLAT), "sr": F.lit(FLAT)})
        else:
            own = own.withColumns({"context": F.substring(f"g{k}", 1, k - 1), "suffix": F.substring(f"g{k}", 2, k - 1)})
            contexts = own.groupBy("context").agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
            shorter = known.select(F.col("gram").alias("suffix"), F.col("pa").alias("sa"), F.col("pr").alias("sr"))
            own = own.join(contexts, "context").join(shorter, "suffix")
        known = own.select(F.col(f"g{k}").alias("gram"), *(((F.col(c) + PRIOR * F.col(f"s{c}")) / (F.col(f"c{c}") + PRIOR)).alias(f"p{c}") for c in "ar"))
    return known.select("gram", F.ln(F.col("pa") / F.col("pr")).alias("ratio"))


def scores(urls: DataFrame) -> DataFrame:
    """(url, score) for every row of distinct URLs (url, a, r): the mean over its characters of the log ratio, null for an empty URL.

    a and r say how often the URL counts as accepted and as rejected in training; with both 0 it is only scored. Without any row of a class there is no score.
    """
    # a few megabytes of URLs make many windows: they are spread before
    tasks = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = urls.where("url <> ''").repartition(tasks, "url").select(F.xxhash64("url").alias("id"), F.crc32(F.col("url").cast("binary")).alias("check"), "a", "r", F.posexplode(windows(F.col("url"))).alias("at", "gram"))
    counts = materialize(parts.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "windows")
    both = counts.agg(F.min(F.least("a", "r")), F.sum("a"), F.sum("r")).first()
    if not both[1] or not both[2]:
        return urls.select("url", F.lit(None).cast("double").alias("score"))
    dealt = materialize(ratios(counts), "ratios").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = parts.withColumn("salt", F.pmod(F.xxhash64("id", "at"), F.lit(SALTS)).cast("int")).join(dealt, ["gram", "salt"])
    found = found.groupBy("id", "check").agg(F.avg("ratio").alias("score"))
    named = urls.select("url", F.xxhash64("url").alias("id"), F.crc32(F.col("url").cast("binary")).alias("check"))
    return named.join(found, ["id", "check"], "left").select("url", "score")


def limit_of(scored: DataFrame, lose: float = 0.01) -> float:
    """The score under which `lose` of the URLs (score) fall, and zero at most; zero without any."""
    limit = scored.agg(F.percentile_approx("score", F.lit(lose), F.lit(10000))).first()[0]
    return min(0.0, limit) if limit is not None else 0.0


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, bad_words: Sequence[str] = BAD_WORDS, key: str = "page_id", lose: float = 0.01) -> DataFrame:
    """(key, host, path, rule, verdict, score) for every row: the longest fitting rule's verdict, else that of the models.

    Rejected are URLs that a rule blocks or whose host holds one of bad_words, accepted all others. Of both a fifth, by hash of the URL, is
    held out of the training; the held-out accepted ones calibrate: a URL without a rule is blocked if it scores below all but `lose` of
    them and below zero. Null, empty and scheme-less URLs have empty host and path. URLs without a score (null, empty) are
    allowed, and so is every URL without a rule if one of the classes has no row. Repeated rows train repeatedly and get equal verdicts. A URL is
    scored whole, in time linear in its length. An empty table gives no rows, other columns are ignored.
    """
    host, path = parts(F.col("url"))
    rows = boxed(pages, key, "url").select(F.col(key).cast("long").alias(key), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
    distinct = rows.where("url <> ''").groupBy("url").agg(F.count("*").alias("n")).withColumns({"host": host, "path": path})
    blocked = F.coalesce(rule_of(F.col("host"), F.col("path"), rules)["verdict"] == "block", F.lit(False))
    distinct = distinct.withColumn("rejected", reduce(lambda x, w: x | F.col("host").contains(w), bad_words, blocked))
    distinct = materialize(distinct.select("url", "n", "rejected", (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held_out")), "urls")
    weight = lambda rejected: F.when(~F.col("held_out") & (F.col("rejected") == rejected), F.col("n")).otherwise(0)
    scored = materialize(scores(distinct.select("url", weight(False).alias("a"), weight(True).alias("r"))), "scores")
    calibrating = distinct.where("held_out and not rejected").select("url").join(scored, "url")
    limit = limit_of(calibrating, lose)
    # a URL that a third of the rows have is dealt to SALTS keys
    dealt = scored.select("url", "score", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    some = rows.where("url <> ''").withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")).join(dealt, ["url", "salt"]).select(key, "url", "score")
    every = some.unionAll(rows.where("url = ''").select(key, "url", F.lit(None).cast("double").alias("score")))
    every = every.withColumns({"host": host, "path": path}).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    by_model = F.when(F.coalesce(F.col("score") < limit, F.lit(False)), "block").otherwise("allow")
    return every.select(key, "host", "path", F.col("found")["rule"].alias("rule"), F.coalesce(F.col("found")["verdict"], by_model).alias("verdict"), "score")
