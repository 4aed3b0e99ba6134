"""Documents about a dataset's making: what each step kept, who contributed, what came out. Summaries only reach the driver."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.labels import consensus_bin
from ..functions.sequences import MAX_LENGTH, MIN_LENGTH, is_canonical, length_ok
from ..session import materialize


def _rows(seen: Observation) -> int:
    """What was counted; 0 where the plan was found empty before it ran, so that there was nothing to observe."""
    try:
        return seen.get["n"]
    except Py4JJavaError as error:
        if "assertion failed" not in str(error):
            raise
        return 0


class Steps:
    """Filters and reductions of a table, one after the other, counted as they run.

    Rows before and after every step are observed metrics of the one job that run() starts, so no step is counted by a job of its own. What is observed can't be
    pushed past: each count is of what its step saw.
    """

    def __init__(self, df: DataFrame):
        self._steps: list[tuple[str, dict, Observation]] = []
        self._first, self._df = self._seen(df, "start")

    @staticmethod
    def _seen(df: DataFrame, name: str) -> tuple[Observation, DataFrame]:
        seen = Observation(f"{name} {uuid.uuid4().hex}")
        return seen, df.observe(seen, F.count(F.lit(1)).alias("n"))

    def then(self, name: str, step: Callable[[DataFrame], DataFrame], **parameters: object) -> Steps:
        """One more step, any function that uses the table it gets once, with the parameters that the log says it has."""
        seen, self._df = self._seen(step(self._df), name)
        self._steps.append((name, parameters, seen))
        return self

    def keep(self, name: str, condition: Column, **parameters: object) -> Steps:
        """Rows for which the condition holds; where it is null they go."""
        return self.then(name, lambda df: df.where(condition), **parameters)

    def distinct(self, name: str, *by: str) -> Steps:
        """One row of each key, any of them."""
        return self.then(name, lambda df: df.dropDuplicates(list(by)), by=list(by))

    def run(self, name: str = "steps") -> tuple[DataFrame, list[dict]]:
        """(table, log): the result, written once, and a record (method, parameters, n_before, n_after) of every step."""
        out, log = materialize(self._df, name), []
        before = _rows(self._first)
        for method, parameters, seen in self._steps:
            after = _rows(seen)
            log.append({"method": method, "parameters": parameters, "n_before": before, "n_after": after})
            before = after
        return out, log


def quality_steps(sequences: DataFrame, low: int = MIN_LENGTH, high: int = MAX_LENGTH, column: str = "sequence") -> Steps:
    """The resource's own steps on a column of normalised sequences: present, canonical, of a length, different."""
    s = F.col(column)
    steps = Steps(sequences).keep("present", s.isNotNull()).keep("canonical_residues", is_canonical(s))
    return steps.keep("length_filter", length_ok(s, low, high), min_length=low, max_length=high).distinct("different", column)


def _stamp(stamp: bool) -> str | None:
    return datetime.now(UTC).isoformat() if stamp else None


def _first(df: DataFrame) -> dict:
    return df.first().asDict()


def dataset_document(task: str, rows: DataFrame, votes: DataFrame, kept: DataFrame, log: Sequence[dict], extra: dict | None = None, stamp: bool = True) -> dict:
    """How a dataset came about: different sequences of each source, the steps, lengths, classes, and the bins of ambiguous sequences.

    rows (sequence, source), votes as evidence.label_votes() gives them, kept and log from Steps.run(). Each section is one aggregate; sources and bins are the
    only rows that are listed. Empty tables give zeros and nulls.
    """
    n = F.char_length("sequence")
    ambiguous = ~F.col("positive") & ~F.col("negative") & ~F.col("only_unlabel")
    count = lambda c: F.count_if(c)
    classes = _first(votes.agg(
        F.count("*").alias("total_sequences_final"), count(F.col("positive")).alias("positive_and_unlabel"), count(F.col("exclusive_1")).alias("only_positive"), count(F.col("negative")).alias("negative_and_unlabel"),
        count(F.col("exclusive_0")).alias("only_negative"), count(F.col("only_unlabel")).alias("only_unlabel"), count(ambiguous).alias("ambiguous")))
    bins = votes.where(ambiguous).groupBy(consensus_bin(F.col("percentage_1")).alias("bin")).agg(F.count("*").alias("n"))
    steps = {s["method"]: {"before": s["n_before"], "after": s["n_after"], **s["parameters"]} for s in log}
    out = {
        "task": task,
        "generated_at": _stamp(stamp),
        "sources": {"n_unique_sequences": {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count_distinct("sequence").alias("n")).collect()}},
        "filters": {s["method"]: {"applied": True, **s["parameters"]} for s in log},
        "sequence_statistics": {**steps, "length_distribution": _first(kept.agg(F.min(n).alias("min"), F.max(n).alias("max"), F.round(F.avg(n), 2).alias("mean"), F.round(F.median(n), 2).alias("median")))},
        "statistics": {
            "total_sequences_final": classes["total_sequences_final"],
            "positive": {k: classes[k] for k in ("positive_and_unlabel", "only_positive")},
            "negative": {k: classes[k] for k in ("negative_and_unlabel", "only_negative")},
            "only_unlabel": classes["only_unlabel"],
            "ambiguous": {"n_sequences": classes["ambiguous"], "category_pbb": {r["bin"]: r["n"] for r in bins.collect()}},
        },
    }
    return out | ({"extra": extra} if extra else {})


def redundancy_document(task: str, effect: str, sources: dict, log: Sequence[dict], stamp: bool = True) -> dict:
    """The reductions of one effect's datasets, in the order they ran."""
    return {"task": task, "generated_at": _stamp(stamp), "effect": effect, "source_datasets": sources, "reductions": list(log)}


# Categories of sequences that are mapped to toxic labels, to therapeutic activities, or to both.
CATEGORIES = {
    "toxic_only_positive": "is_toxic_positive and not is_therapeutic",
    "toxic_only_negative": "is_toxic_negative and not is_therapeutic",
    "therapeutic_only": "not is_toxic_positive and not is_toxic_negative and is_therapeutic",
    "therapeutic_toxic_positive": "is_toxic_positive and is_therapeutic",
    "therapeutic_toxic_negative": "is_toxic_negative and is_therapeutic",
}
GENERAL = {"toxic_only": ("toxic_only_positive", "toxic_only_negative"), "therapeutic_only": ("therapeutic_only",), "therapeutic_toxic": ("therapeutic_toxic_positive", "therapeutic_toxic_negative")}


def mapping_document(toxic: DataFrame, therapeutic: DataFrame, sources: dict | None = None, stamp: bool = True) -> dict:
    """Sequences by what they are mapped to: toxic (sequence, effect, label 0 or 1), therapeutic (sequence, activity).

    Both tables are summed up by sequence once, and the sums once more; label spaces are sorted and hold no null. A sequence with both labels is in both detailed categories.
    """
    yes = lambda label: F.max(F.col("label") == label)
    told = toxic.groupBy("sequence").agg(F.coalesce(yes(1), F.lit(False)).alias("is_toxic_positive"), F.coalesce(yes(0), F.lit(False)).alias("is_toxic_negative"))
    both = told.join(therapeutic.select("sequence").distinct().withColumn("is_therapeutic", F.lit(True)), "sequence", "full").na.fill(False)
    counts = _first(both.agg(
        F.count_distinct("sequence").alias("total"), *(F.count_if(F.expr(rule)).alias(c) for c, rule in CATEGORIES.items()),
        *(F.count_if(F.expr(" or ".join(f"({CATEGORIES[c]})" for c in of))).alias(f"general_{g}") for g, of in GENERAL.items())))
    space = lambda c, when: F.sort_array(F.collect_set(F.when(when, F.col(c).cast("string"))))
    positive, negative = F.col("label") == 1, F.col("label") == 0
    one = _first(toxic.agg(
        F.count("*").alias("rows"), F.count_if(positive).alias("positive"), F.count_if(negative).alias("negative"), F.count_distinct("sequence").alias("unique"), space("effect", F.lit(True)).alias("effects"),
        space("effect", positive).alias("effects_positive"), space("effect", negative).alias("effects_negative"), space("label", F.lit(True)).alias("labels")))
    two = _first(therapeutic.agg(F.count("*").alias("rows"), F.count_distinct("sequence").alias("unique"), space("activity", F.lit(True)).alias("activities")))
    return {
        "task": "toxicity_therapeutic_mapping",
        "generated_at": _stamp(stamp),
        "source_datasets": sources or {},
        "categories_general": {g: {"logic": f"category_detailed in {list(of)}"} for g, of in GENERAL.items()},
        "categories_detailed": {c: {"logic": rule} for c, rule in CATEGORIES.items()},
        "label_spaces": {"toxic_effects_all": one["effects"], "toxic_effects_positive": one["effects_positive"], "toxic_effects_negative": one["effects_negative"], "therapeutic_activities": two["activities"], "toxic_labels": [int(x) for x in one["labels"]]},
        "statistics": {
            "n_unique_sequences_total": counts["total"],
            "input_tables": {"toxic_rows_total": one["rows"], "toxic_positive_rows": one["positive"], "toxic_negative_rows": one["negative"], "therapeutic_rows_total": two["rows"], "toxic_unique_sequences": one["unique"], "therapeutic_unique_sequences": two["unique"]},
            "global_categories_general": {g: counts[f"general_{g}"] for g in GENERAL},
            "global_categories_detailed": {c: counts[c] for c in CATEGORIES},
        },
    }


def flattened(document: dict, prefix: str = "") -> list[tuple[str, str]]:
    """(path, text) of every value that isn't null; lists are joined by commas."""
    out: list[tuple[str, str]] = []
    for key, value in document.items():
        path = f"{prefix}.{key}" if prefix else str(key)
        if isinstance(value, dict):
            out += flattened(value, path)
        elif value is not None:
            out.append((path, ",".join(map(str, value)) if isinstance(value, list) else str(value)))
    return out
