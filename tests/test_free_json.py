"""Texts of any shape against Python's own JSON."""

import json
import re

from pyspark.sql import functions as F

from tessera.operators import free_json


def renamed(value):
    if isinstance(value, dict):
        out = {}
        for k in sorted(value):
            name = re.sub("[^0-9A-Za-z]+", "_", k).strip("_").lower()
            out[free_json.SOURCE_ALIASES.get(name, name)] = renamed(value[k])
        return out
    return [renamed(v) for v in value] if isinstance(value, list) else value


def flat(value, path=""):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in flat(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in flat(v, f"{path}[{i}]")]
    return [(path, value)]


deep = {"X y": 1}
for i in range(12):
    deep = [{"Level -- up": deep}] if i % 2 else {f"n{i}": deep, "other": [i, [], {}]}
VALUES = [{"Source Name": "a \"quoted\" 'é' 😀\n", "Type source": {"A b": [1, 2.5, None, True, {"C.D": []}]}}, deep, [], {}, "text", 3, None, [[[1]]], {"Same key": 1, "same-key": 2}, {"": {"_x_": 0}}]


def test_against_json(spark):
    rows = [(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(VALUES)] + [(100, "not json"), (101, None), (102, "")]
    walked = free_json.nodes(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    got = {r["key"]: json.loads(r["json"]) for r in free_json.rebuilt(walked).collect()}
    assert got == {i: renamed(v) for i, v in enumerate(VALUES)}
    unlike = {i for i, v in enumerate(VALUES) if v == VALUES[8]}  # of two members with one name both are leaves
    leaves = sorted(((r["key"], r["path"], json.loads(r["value"])) for r in free_json.leaves(walked).collect() if r["key"] not in unlike), key=str)
    assert leaves == sorted(((i, p, x) for i, v in enumerate(VALUES) if i not in unlike for p, x in flat(renamed(v))), key=str)
    empty = free_json.nodes(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert empty.count() == free_json.rebuilt(empty).count() == free_json.leaves(empty).count() == 0


def test_keys(spark):
    names = [" Year of  Publication ", "staticDynamic", "__a--B__", "static/dynamic", "é"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(free_json.metadata_key(F.col("n"), free_json.SOURCE_ALIASES)).collect()]
    assert got == ["publication_year", "staticdynamic", "a_b", "resource_behavior", ""]


def test_leaves_are_told_by_their_node(spark):
    text = '{"a": [null], "b": [], "c": {}, "d": [[], {}, [{"e": {}}]], "f": null}'
    walked = free_json.nodes(spark.createDataFrame([(1, text), (2, "[]"), (3, "{}")], "k long, t string"), "k", "t")
    plan = free_json.leaves(walked)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # no group or join, so a task's memory doesn't grow with the table
    got = sorted((r["key"], r["path"], r["value"]) for r in free_json.leaves(walked).collect())
    assert got == [(1, "a[0]", "null"), (1, "b", "[]"), (1, "c", "{}"), (1, "d[0]", "[]"), (1, "d[1]", "{}"), (1, "d[2][0].e", "{}"), (1, "f", "null"), (2, "", "[]"), (3, "", "{}")]
