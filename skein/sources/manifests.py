"""Dependency manifests as rows (name, version, category), and their union."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Manifests in the order in which the first entry of a name and category wins.
ORDER = ("Cargo.toml", "package.json", "pyproject.toml", "requirements.txt", "go.mod")
Entry = tuple[str, str, str]


def split_requirement(spec: str) -> tuple[str, str]:
    m = re.match(r"^(.*?)((?:==|>=|<=|~=|<|>).*)?$", spec.strip())
    return m[1].strip(), (m[2] or "").strip()


def _toml(text: str) -> dict:
    import tomllib

    return tomllib.loads(text)


def _table(t: dict, category: str) -> Iterator[Entry]:
    for name, spec in t.items():
        version = spec if isinstance(spec, str) else spec.get("version", "") if isinstance(spec, dict) else ""
        yield name, version if isinstance(version, str) else "", category


def cargo(text: str) -> Iterator[Entry]:
    t = _toml(text)
    yield from _table(t.get("dependencies", {}), "cargo")
    yield from _table(t.get("dev-dependencies", {}), "cargo-dev")
    yield from _table(t.get("workspace", {}).get("dependencies", {}), "cargo")


def cargo_lock(text: str) -> dict[str, str]:
    return {p["name"]: p.get("version", "") for p in _toml(text).get("package", []) if "name" in p}


def npm(text: str) -> Iterator[Entry]:
    t = json.loads(text)
    yield from _table(t.get("dependencies", {}), "npm")
    yield from _table(t.get("devDependencies", {}), "npm-dev")


def pyproject(text: str) -> Iterator[Entry]:
    p = _toml(text).get("project", {})
    for spec in p.get("dependencies", []):
        yield (*split_requirement(spec), "python")
    for group in p.get("optional-dependencies", {}).values():
        for spec in group:
            yield (*split_requirement(spec), "python")


def requirements(text: str) -> Iterator[Entry]:
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith(("#", "-r ", "-e ", "--")):
            yield (*split_requirement(line), "python")


def go_mod(text: str) -> Iterator[Entry]:
    inside = False
    for line in map(str.strip, text.splitlines()):
        line = line.split("//")[0].strip()
        if line.startswith("require ("):
            inside = True
        elif inside and line == ")":
            inside = False
        elif line and (inside or line.startswith("require ")):
            parts = line.removeprefix("require ").split()
            if parts:
                yield parts[0], parts[1] if len(parts) > 1 else "", "go"


PARSERS = dict(zip(ORDER, (cargo, npm, pyproject, requirements, go_mod), strict=True))


def parse(files: DataFrame) -> DataFrame:
    """(manifest, priority, pos, name, version, category) of files (path, text); a manifest that cannot be read gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                name = path.rsplit("/", 1)[-1]
                if name in PARSERS:
                    try:
                        got = list(PARSERS[name](text))
                    except (ValueError, AttributeError, TypeError):
                        got = []
                    rows += [(path, ORDER.index(name), i, *e) for i, e in enumerate(got)]
            yield pd.DataFrame(rows, columns=["manifest", "priority", "pos", "name", "version", "category"])

    return files.select("path", "text").mapInPandas(run, "manifest string, priority int, pos int, name string, version string, category string")


def tech_stack(entries: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    """(category, name, version, manifest): the first entry of each name and category by priority and position; versions of locked (name, version) replace."""
    w = Window.partitionBy("name", "category").orderBy("priority", "pos", "manifest")
    out = entries.withColumn("r", F.row_number().over(w)).where("r = 1")
    if locked is not None:
        out = out.join(locked.select("name", F.col("version").alias("lock")), "name", "left").withColumn("version", F.when(F.col("category").startswith("cargo"), F.coalesce("lock", "version")).otherwise(F.col("version")))
    return out.select("category", "name", "version", "manifest")
