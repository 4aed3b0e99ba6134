"""Bioactivity terms in free text: seed expressions, discovered terms, merged and collapsed flags."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Seed expressions by flag; they are matched without case.
SEEDS = {
    "antimicrobial": r"\bantimicrobial\b|\bamp\b(?![a-z])|\bantimicrobial peptide\b",
    "antibacterial": r"\bantibacterial\b|\banti[-\s]?bacter",
    "antiviral": r"\bantiviral\b|\banti[-\s]?virus",
    "antifungal": r"\bantifungal\b|\banti[-\s]?fung",
    "antiparasitic": r"\bantiparasitic\b|\banti[-\s]?paras",
    "antiprotozoal": r"\bantiprotozoal\b",
    "antimycobacterial": r"\banti[-\s]?mycobact",
    "bacteriocin": r"\bbacteriocin(s)?\b",
    "defensin": r"\bdefensin(s)?\b",
    "toxin": r"\btoxin(s)?\b|\bneurotoxin(s)?\b|\bcytotoxin(s)?\b|\bdermato\w*toxin\w*\b",
    "hemolytic": r"\bhemolytic\b|\bhaemolytic\b|\bhemolysin(s)?\b|\bhaemolysin(s)?\b",
    "venom": r"\bvenom(ous)?\b|\bvenom[-\s]?peptide\b",
    "anticancer": r"\banti[-\s]?cancer\b|\banti[-\s]?tumor\b",
    "anti_inflammatory": r"\banti[-\s]?inflamm",
    "immunomodulatory": r"\bimmunomodulat|\bimmune modulat|\bimmunostimulat|\bimmunosuppress",
    "inhibitor": r"\binhibitor(s)?\b|\binhibit(s|ed|ing)?\b",
    "enzyme_inhibitory": r"\bprotease inhibitor|\bribonuclease inhibitor|\bkinase inhibitor",
    "binding": r"\breceptor[-\s]?binding\b|\bprotein[-\s]?binding\b|\bbinding\b",
    "cell_penetrating": r"\bcell[-\s]?penetrating\b|\bcpp\b(?![a-z])",
    "signal": r"\bsignal peptide\b|\bsignalling?\b|\bsignaling\b",
    "hormonal": r"\bhormone(s)?\b|\bhormonal\b|\bneuropeptide(s)?\b|\bpeptide hormone\b",
    "antioxidant": r"\bantioxidant(s)?\b",
    "angiogenic": r"\banti[-\s]?angiogen|\bpro[-\s]?angiogen|angiogenic",
    "antidiabetic": r"\banti[-\s]?diabet|\bglucose[-\s]?regulat",
    "antihypertensive": r"\banti[-\s]?hypertens|\bace[-\s]?inhibitor",
    "antibiofilm": r"\banti[-\s]?biofilm\b|\banti[-\s]?adhes",
    "wound_healing": r"\bwound[-\s]?healing\b|\bskin repair\b",
    "skin_related": r"\bskin\b|\bdermato\w+",
    "chemoattractant": r"\bchemotactic\b|\bchemoattract",
    "analgesic": r"\banalgesic\b|\bantinocicept",
}
# What a discovered term is, ends with or holds, and the flags that are one.
KEYWORDS = (
    "defensin", "bacteriocin", "inhibitor", "binding", "venom", "capsid", "ribosome-inactivating", "ribonuclease", "protease", "kinase", "phosphatase", "transport", "carrier", "channel",
    "hemolysin", "haemolysin", "dermatoxin", "skin", "antimicrobial", "antiviral", "antifungal", "antibacterial",
)
SUFFIXES = ("toxin", "lysin", "lytic", "cidal", "cidin", "cins", "icin", "mycin", "kinin", "peptide", "lectin", "insulin", "hormone")
PARTS = ("binding", "inhibitor", "defensin", "bacteriocin", "venom")
ALIASES = {
    "antimicrobial": ("anti_microbial", "antimicrobial_peptide", "amp", "auto_antimicrobial", "auto_amp"),
    "antibacterial": ("anti_bacterial", "antibacterial_peptide", "anti_bacter"),
    "antiviral": ("anti_viral", "antiviral_peptide", "anti_virus"),
    "antifungal": ("anti_fungal", "antifungal_peptide", "anti_fung"),
    "antiparasitic": ("anti_parasitic", "anti_paras"),
    "antimycobacterial": ("anti_mycobacterial",),
    "defensin": ("defensins",),
    "bacteriocin": ("bacteriocins",),
    "hemolytic": ("haemolytic", "hemolysin", "haemolysin"),
    "toxin": ("neurotoxin", "cytotoxin", "dermatoxin"),
    "binding": ("receptor_binding", "protein_binding", "ligand_binding"),
    "inhibitor": ("enzyme_inhibitory", "protease_inhibitor", "kinase_inhibitor"),
    "cell_penetrating": ("cpp",),
    "anti_inflammatory": ("antiinflammatory",),
    "hormonal": ("peptide_hormone", "neuropeptide"),
    "skin_related": ("skin", "dermato", "dermatoxin"),
    "antibiofilm": ("anti_adhes",),
}
#: Flags that are cases of antimicrobial.
COLLAPSED = ("antibacterial", "antiviral", "antifungal", "antiparasitic", "antimycobacterial")
#: Rows that have to hold a term, the longest term in words, terms that become columns at most.
LEAST, MOST, COLUMNS = 15, 3, 5000
#: Words whose grams are counted at a time, rows of a batch that leaves a task.
SLICE, ROWS = 1 << 20, 1 << 16


def flags(text: Column, patterns: Mapping[str, str] = SEEDS, extra: Mapping[str, str] | None = None) -> dict[str, Column]:
    """0 or 1 for every expression, without case; extra patterns add to or replace the seeds."""
    return {k: F.coalesce(text.rlike(f"(?iU){p}"), F.lit(False)).cast("int") for k, p in {**patterns, **(extra or {})}.items()}


def ngrams(text: Column, most: int = 3) -> Column:
    """The different 1- to most-grams of the lower-cased words of letters."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    grams = [_ngram(words, n) for n in range(1, most + 1)]
    return F.array_distinct(F.concat(*grams))


def _ngram(words: Column, n: int, between: str = " ") -> Column:
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), between))
    return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))


def _sliced(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.ListArray]:
    """The first column of the batches in slices of about `words` words, or of one row."""
    for batch in batches:
        lists, start = batch.column(0), 0
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while start < len(lists):
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + words, side="right")))
            yield lists.slice(start, end - start)
            start = end


def _gram_rows(lists: pa.ListArray, most: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """For n from 1 to `most`, the different n-grams of lists of words and the number of lists that hold each. Empty words are none.

    An n-gram's key is the number of its first n - 1 words' gram, times the number of words, plus its last word's: exact for any number of words.
    """
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    real = pc.not_equal(flat, "")
    flat, row = flat.filter(real), row[real.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    word, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    gram, at, names = np.zeros(len(word), np.int64), np.arange(len(word)), None
    for n in range(1, most + 1):
        if n > 1:
            fits = at + n - 1 < len(row)
            fits[fits] = row[at[fits]] == row[at[fits] + n - 1]
            gram, at = gram[fits], at[fits]
        if not len(at):
            return
        key = gram * size + word[at + n - 1]
        order = np.argsort(key, kind="stable")  # rows ascend among equal keys
        key, of = key[order], row[at[order]]
        first = np.r_[True, key[1:] != key[:-1]]
        number = np.cumsum(first) - 1
        held = np.bincount(number[first | np.r_[True, of[1:] != of[:-1]]])
        last = coded.dictionary.take(pa.array(word[at[order[first]] + n - 1]))
        names = last if names is None else pc.binary_join_element_wise(names.take(pa.array(gram[order[first]])), last, " ")
        gram = np.empty_like(number)
        gram[order] = number
        yield names, held


def token_mining(df: DataFrame, text: str, least: int = 2, most: int = 3) -> DataFrame:
    """(token, n_rows) of the n-grams that lie in `least` rows. Slices of rows number their words and count the grams by numbers; each different gram of a slice becomes a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _sliced(batches, SLICE):
            for names, held in _gram_rows(lists, most):
                for s in range(0, len(names), ROWS):
                    yield pa.RecordBatch.from_arrays([names[s : s + ROWS], pa.array(held[s : s + ROWS])], names=["token", "n"])

    words = df.select(F.split(F.lower(F.col(text)), r"[^\p{L}]+").alias("w"))
    return words.mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n_rows")).where(F.col("n_rows") >= least)


def merge_aliases(df: DataFrame, aliases: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """Each target becomes the largest of itself and its aliases, which go."""
    for target, names in aliases.items():
        have = [c for c in (target, *names) if c in df.columns]
        if have:
            df = df.withColumn(target, F.greatest(*have) if len(have) > 1 else F.col(have[0])).drop(*[c for c in have if c != target])
    return df


def terms(df: DataFrame, text: str, least: int = LEAST, most: int = MOST, known: Sequence[str] = ()) -> DataFrame:
    """(term, n): what occurs at least `least` times in all texts, looks like an activity and isn't `known`.

    Texts are cut at brackets, commas, semicolons, bars and slashes; within a piece every run of one to `most` words of letters and hyphens counts,
    each time. It looks like one if it is a keyword, ends or holds one of the fixed parts; dermato..toxin is dermatoxin. Null texts have none. One shuffle of terms, counted before it.
    """
    pieces = df.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[;,|()\[\]{}/]+")).alias("piece"))
    words = pieces.select(F.regexp_extract_all("piece", F.lit(r"[a-z][a-z\-]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    grams = words.select(F.explode(F.concat(*(_ngram(F.col("w"), n) for n in range(1, most + 1)))).alias("t"))
    like = F.col("t").isin(*KEYWORDS)
    for told in (*(F.col("t").endswith(x) for x in SUFFIXES), *(F.col("t").contains(x) for x in PARTS)):
        like = like | told
    skin = F.col("t").startswith("dermato") & F.col("t").contains("toxin")
    term = F.when(F.char_length("t") >= 3, F.when(like, F.col("t")).when(skin, "dermatoxin"))
    found = grams.select(term.alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("n"))
    return found.where((F.col("n") >= least) & ~F.col("term").isin(*known, ""))


def column_names(found: Sequence[str], taken: Sequence[str]) -> Iterator[tuple[str, str]]:
    """(column, term) for terms in their order: letters and digits joined by underscores, with auto_ before a name that is taken."""
    names = set(taken)
    for term in sorted(found):
        name = re.sub(r"[^a-z0-9]+", "_", term).strip("_")
        name = f"auto_{name}" if name in names else name
        names.add(name)
        yield name, term


def annotate(df: DataFrame, text: str = "description", extra: Mapping[str, str] | None = None, least: int = LEAST, collapse: bool = False) -> DataFrame:
    """df with a column of 0 and 1 for every seed, extra expression and discovered term, aliases merged, and with `collapse` the cases of antimicrobial in it too.

    Two passes: the first finds the terms, of which there are at most COLUMNS, or a ValueError says so (raise `least`); the schema follows from them. A discovered term
    matches with spaces or hyphens between its words, or neither, not inside a longer word. Columns of df that are called like a flag are replaced. The second pass is a projection;
    flags of one row are told in one expression each. A missing text column raises KeyError; null texts have zeros.
    """
    if text not in df.columns:
        raise KeyError(text)
    seeds = {**SEEDS, **(extra or {})}
    found = [r["term"] for r in terms(df, text, least, known=[*df.columns, *seeds]).limit(COLUMNS + 1).collect()]
    if len(found) > COLUMNS:
        raise ValueError(f"over {COLUMNS} terms have {least} occurrences: raise `least`")
    patterns = dict(seeds)
    for name, term in column_names(found, [*df.columns, *seeds]):
        patterns[name] = r"(?<![a-z0-9])" + r"[-\s]?".join(re.escape(w) for w in term.split(" ")) + r"(?![a-z0-9])"
    held = F.lower(F.coalesce(F.col(text), F.lit("")))
    merged = {name: [name] for name in patterns}
    for target, names in ALIASES.items():  # in their order: an alias of two targets counts for the first
        have = [c for c in (target, *names) if c in merged]
        if have:
            united = list(dict.fromkeys(p for c in have for p in merged.pop(c)))
            merged[target] = united
    if collapse and (cases := [c for c in COLLAPSED if c in merged]):
        merged["antimicrobial"] = list(dict.fromkeys([*merged.get("antimicrobial", ()), *(p for c in cases for p in merged[c])]))
    out = {name: _any(held, [patterns[p] for p in of]).cast("int") for name, of in merged.items()}
    return df.select(*(c for c in df.columns if c not in out), *(c.alias(name) for name, c in out.items()))


def flagged(df: DataFrame, key: str, text: str = "description", extra: Mapping[str, str] | None = None, least: int = LEAST, collapse: bool = False) -> DataFrame:
    """(key, flag): annotate()'s ones as rows, each once under a key, for any number of terms.

    Terms are a table and never columns: where one matches, the letters and digits of whole neighbouring words, put together, are the term's own. So the runs of
    words meet the terms in a join on that, and only what meets is matched by the term's expression. Work grows with the texts, not with texts times terms.
    """
    seeds = {**SEEDS, **(extra or {})}
    target: dict[str, str] = {}
    for goal, names in ALIASES.items():
        for name in (goal, *names):
            target.setdefault(name, goal)
    name = F.regexp_replace(F.regexp_replace("term", "[^a-z0-9]+", "_"), "^_+|_+$", "")
    nth = F.row_number().over(Window.partitionBy("name").orderBy("term"))
    found = terms(df, text, least, known=[*df.columns, *seeds]).select("term", name.alias("name"))
    found = found.select("term", F.when(F.col("name").isin(*df.columns, *seeds) | (nth > 1), F.concat(F.lit("auto_"), "name")).otherwise(F.col("name")).alias("name"))
    pattern = F.concat(F.lit("(?iU)(?<![a-z0-9])"), F.replace(F.replace("term", F.lit("-"), F.lit("\\-")), F.lit(" "), F.lit(r"[-\s]?")), F.lit("(?![a-z0-9])"))
    goals = F.create_map(*(F.lit(x) for pair in target.items() for x in pair))
    parts = F.size(F.filter(F.split("term", "[ -]+"), lambda w: w != ""))
    found = materialize(found.select(F.regexp_replace("term", "[ -]", "").alias("letters"), pattern.alias("pattern"), F.coalesce(F.try_element_at(goals, F.col("name")), F.col("name")).alias("flag"), parts.alias("parts")), "terms")
    most = found.agg(F.max("parts").alias("n")).first()["n"] or 0

    held = df.select(F.col(key), F.explode(F.array(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("held"))
    of: dict[str, list[str]] = {}
    for name_, pattern_ in seeds.items():
        of.setdefault(target.get(name_, name_), []).append(pattern_)
    seen = held.select(key, F.explode(F.filter(F.array(*(F.when(_any(F.col("held"), patterns), flag) for flag, patterns in of.items())), lambda x: x.isNotNull())).alias("flag"))
    if most:
        # the two letters beside a to z that match without case; separators are what the expression decides
        words = F.filter(F.split(F.translate("held", "\u017f\u0131", "si"), "[^a-z0-9]+"), lambda w: w != "")
        runs = held.select(key, "held", words.alias("w")).select(key, "held", F.explode(F.array_distinct(F.concat(*(_ngram(F.col("w"), n, "") for n in range(1, most + 1))))).alias("letters"))
        seen = seen.unionAll(runs.join(found, "letters").where(F.rlike("held", "pattern")).select(key, "flag"))
    if collapse:
        both = F.when(F.col("flag").isin(*COLLAPSED), F.array("flag", F.lit("antimicrobial"))).otherwise(F.array("flag"))
        seen = seen.select(key, F.explode(both).alias("flag"))
    return seen.distinct()


def _any(text: Column, patterns: Sequence[str]) -> Column:
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))
