"""Generation state, snapshots, plans and configuration."""

from __future__ import annotations

import json
import os
import re
import tempfile
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.files import glob_regex

SNAPSHOT = ("documents", "cards", "modules")


def save_state(path: str, state: dict) -> None:
    """A JSON document with sorted keys, put in place in one step."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_suffix(".tmp")
    with draft.open("w") as f:
        f.write(as_json(state))
        f.flush()
        os.fsync(f.fileno())
    draft.replace(target)


def as_json(state: dict) -> str:
    return json.dumps(state, sort_keys=True, indent=1)


def load_state(path: str) -> dict:
    """The state, empty where there is none or it cannot be read."""
    try:
        return parse_state(Path(path).read_text())
    except (OSError, ValueError):
        return {}


def parse_state(text: str | None) -> dict:
    """The state in a document, empty where there is none or it is no JSON object."""
    try:
        got = json.loads(text or "{}")
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def fingerprints(spark: SparkSession, state: dict, name: str = "file_fingerprints") -> DataFrame:
    return spark.createDataFrame(sorted(state.get(name, {}).items()), "path string, hash string")


def state_of(files: DataFrame) -> DataFrame:
    """(path, hash) of scanned files (path, sha256)."""
    return files.select("path", F.col("sha256").alias("hash"))


def write_snapshot(root: str, **tables: DataFrame) -> None:
    for name in SNAPSHOT:
        tables[name].write.mode("overwrite").parquet(f"{root}/{name}")


def read_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}") for name in SNAPSHOT}


def merge(base: dict, overlay: dict) -> dict:
    """Tables merge key by key; any other value replaces the one below it."""
    out = dict(base)
    for k, v in overlay.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(*paths: str) -> dict:
    """Layers of TOML files, later ones over earlier ones; missing files are skipped."""
    out: dict = {}
    for p in paths:
        if Path(p).exists():
            out = merge(out, tomllib.loads(Path(p).read_text()))
    return out


@dataclass
class Plan:
    version: int = 1
    notes: list[str] = field(default_factory=list)
    documents: list[dict] = field(default_factory=list)
    templates: dict = field(default_factory=dict)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)


def load_plan(path: str) -> Plan | None:
    """The plan of a YAML or JSON file, None where there is none; the version must be 1 and scope patterns must hold."""
    if not Path(path).exists():
        return None
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        raw = json.loads(text)
    else:
        raw = yaml.safe_load(text)
    raw = raw or {}
    if raw.get("version") != 1:
        raise ValueError(f"plan version {raw.get('version')!r}; only 1 is known")
    scope = raw.get("scope") or {}
    for p in [*(scope.get("include") or []), *(scope.get("exclude") or [])]:
        if not isinstance(p, str) or not p.strip("/"):
            raise ValueError(f"scope pattern {p!r}")
        glob_regex(p)
    return Plan(1, raw.get("notes") or [], raw.get("documents") or [], raw.get("templates") or {}, scope.get("include") or [], scope.get("exclude") or [])


def checkpoint_folder(spark: SparkSession) -> None:
    """The session's folder for checkpoints: spark.checkpoint.dir; where it is unset a local master gets one of its own (tests), and a cluster an error."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
