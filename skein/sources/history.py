"""Version history as tables: the last commits with the files they touch, files as they were, the head. Reads a repository by the git command, where that is installed."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources import parsers

RECENT = 20
_STATUS = {"A": "added", "D": "deleted"}


def _git(root: str, *args: str) -> bytes | None:
    """What git prints, None where there is no git, no repository or no such object."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=300, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def head(root: str) -> str | None:
    out = _git(root, "rev-parse", "HEAD")
    return out.decode().strip() if out else None


def work_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path) of files that differ from the head or are not known to it."""
    out = (_git(root, "status", "--porcelain", "-z", "--no-renames") or b"").decode("utf-8", "replace")
    return spark.createDataFrame([(x[3:],) for x in out.split("\0") if x], "path string")


def commits(spark: SparkSession, root: str, most: int = RECENT, output: str | None = None) -> DataFrame:
    """(place, commit, path, status) of the last `most` commits, the oldest at place 0, against the one before each; files in the output folder are left out, and a commit that touches
    nothing else has one row without path."""
    hashes = (_git(root, "rev-list", f"--max-count={most}", "HEAD") or b"").decode().split()[::-1]
    rows = []
    for place, commit in enumerate(hashes):
        out = (_git(root, "diff-tree", "--root", "-r", "-z", "--no-commit-id", "--name-status", "--no-renames", commit) or b"").decode("utf-8", "replace").split("\0")
        touched = [(p, _STATUS.get(s, "modified")) for s, p in zip(out[::2], out[1::2], strict=False) if p and not (output and p.startswith(output.strip("/") + "/"))]
        rows += [(place, commit, p, s) for p, s in touched] or [(place, commit, None, None)]
    return spark.createDataFrame(rows, "place long, commit string, path string, status string")


def old_files(spark: SparkSession, root: str, commit: str, paths: list[str]) -> DataFrame:
    """(path, source) of files as they were at a commit; those that were not there, or are no text, are left out."""
    rows = []
    for p in paths:
        blob = _git(root, "show", f"{commit}:{p}")
        if blob is not None:
            try:
                rows.append((p, blob.decode()))
            except UnicodeDecodeError:
                continue
    return spark.createDataFrame(rows, "path string, source string")


def old_entities(spark: SparkSession, root: str, commit: str, paths: list[str]) -> DataFrame:
    """Entities of files as they were at a commit."""
    from skein.sources.files import language

    return parsers.entities(old_files(spark, root, commit, paths).withColumn("language", language(F.col("path"))))
