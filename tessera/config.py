"""Configuration: typed overrides, seeds, YAML sections, strategy parameters, settings of the sequence-card layer."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Collection, Mapping
from pathlib import Path

# Words that stand for a missing value, for true and for false in an override.
MISSING = ("", "none", "null", "nan", "na", "-")
TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")

#: What a text may spell, and how that is read; the first that fits the whole text counts.
READERS: tuple[tuple[str, Callable[[str], object]], ...] = (
    ("|".join(map(re.escape, MISSING)), lambda _: None),
    ("|".join(TRUE), lambda _: True),
    ("|".join(FALSE), lambda _: False),
    (r"[+-]?\d+(?:_\d+)*", int),
    (r"[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|[+-]?inf(?:inity)?", float),
)


def typed(value: object) -> object:
    """What a text spells by READERS, without the space around it, else the text; other values stay."""
    if not isinstance(value, str):
        return value
    text = value.strip()
    return next((read(text) for spelt, read in READERS if re.fullmatch(spelt, text, re.IGNORECASE)), text)


def has_value(value: object) -> bool:
    """Whether a configured value says anything."""
    return typed(value) is not None


def with_overrides(config: Mapping, sections: Collection[str]) -> tuple[dict, list[str]]:
    """The configuration with its keys `section__name` put in their sections as typed values, and the keys of unknown sections, which change nothing."""
    marked = {key: tuple(key.split("__", 1)) for key in config if "__" in key}
    unknown = [key for key, (section, _) in marked.items() if section not in sections]
    given = {s: {name: typed(config[key]) for key, (section, name) in marked.items() if section == s} for s in sections}
    flat = [s for s, values in given.items() if values and not isinstance(config.get(s) or {}, Mapping)]
    if flat:
        raise ValueError(f"not a section: {', '.join(flat)}")
    merged = {s: dict(config.get(s) or {}) | values for s, values in given.items() if values}
    return {k: dict(v) if isinstance(v, Mapping) else v for k, v in config.items()} | merged, unknown


def load_yaml(path: str) -> dict:
    """A YAML file as a dict; an empty one is an empty dict."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load_seeds(spark, path: str, column: str = "seed") -> list[int]:
    """The seeds of a CSV file in its order, without repeats and missing values: configuration, so a list on the driver."""
    rows = spark.read.csv(path, header=True).select(column).collect()
    return list(dict.fromkeys(int(typed(r[0])) for r in rows if has_value(r[0])))


def strategy_parameters(strategy: str, seed: int, given: Mapping | None = None, representation: Mapping | None = None) -> dict:
    """The parameters of a split strategy as a document {strategy: {..}}: defaults, what is given, and the seed.

    A distance-aware strategy needs a representation: feature_mode, metric, embeddings_path, ids_path, and for descriptors their prefix.
    """
    given = dict(given or {})
    common = {"n_splits": int(given.get("n_splits", 5)), "seed": int(seed), "val_size": float(given.get("val_size", 0.1))}
    if strategy == "random_kfold":
        return {strategy: common | {"shuffle": bool(typed(given.get("shuffle", True)))}}
    if strategy == "stratified_kfold":
        extra = {k: bool(typed(given.get(k, d))) for k, d in (("shuffle", True), ("dropna", True), ("cast_to_str", False))}
        return {strategy: common | extra | {"label_col": given.get("label_col", "label")}}
    if strategy == "distance_aware_kfold":
        if not representation:
            raise ValueError("a distance-aware strategy needs a representation")
        out = common | {"shuffle_ties": bool(typed(given.get("shuffle_ties", True)))} | {k: representation[k] for k in ("feature_mode", "metric", "embeddings_path", "ids_path")}
        if out["feature_mode"] == "descriptors":
            out |= {"descriptor_prefix": representation["prefix"], "standardize_descriptors": bool(typed(representation.get("standardize", True)))}
        return {strategy: out}
    raise ValueError(f"unknown strategy: {strategy}")


def write_parameters(document: dict, path: str) -> None:
    """The document as YAML, its keys in their order."""
    import yaml

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        yaml.safe_dump(document, f, sort_keys=False, allow_unicode=True)
    os.replace(f"{path}.part", path)


# The card layer's settings, where its inputs lie under the root; of several places the first that exists.
CARD_SETTINGS = {
    "output": ("sequence_profiles",),
    "master": ("processed_data/processed_data/{resource}_sequence_pivot.csv",),
    "measurements": ("processed_data/processed_data/{resource}_toxicity_measurements.csv",),
    "negative_evidence": ("raw_data/evidence_negative_dataset.csv",),
    "targets": ("raw_data/tasks_by_source.csv",),
    "representations": ("numerical_representation_data/{resource}",),
    "descriptors": tuple(f"{up}dataset_{word}/sequence_descriptors.csv" for up in ("", "processed_data/") for word in ("characterization", "caracterization")),
}


def card_settings(root: str, resource: str = "resource", **given: str) -> dict[str, str]:
    """Every setting of the card layer, by name: absolute paths, and the release. What isn't given follows from the root.

    `resource` is the word that the names of the layer's files begin with. An unknown setting raises TypeError.
    """
    if unknown := given.keys() - CARD_SETTINGS.keys() - {"version"}:
        raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
    base = Path(root).expanduser().resolve()
    out = {"root": str(base), "version": given.pop("version", None) or project_version(base)}
    for name, places in CARD_SETTINGS.items():
        tried = [Path(given[name]).expanduser()] if given.get(name) else [base / place.format(resource=resource) for place in places]
        out[name] = str(next((t for t in tried if t.exists()), tried[0]).resolve())
    return out


#: The first `version` in the [project] section of a project file.
_VERSION = re.compile(r"^\[project\][^\n]*\n(?:(?!\[)[^\n]*\n)*?version\s*=\s*[\"']([^\"']+)[\"']", re.MULTILINE)


def project_version(root: str | Path, without: str = "development") -> str:
    """The release that the project file under root states."""
    file = Path(root) / "pyproject.toml"
    stated = _VERSION.search(file.read_text(encoding="utf-8")) if file.is_file() else None
    return stated[1] if stated else without
