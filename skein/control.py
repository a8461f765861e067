"""Around the tables: what may be plugged in, retries, the lock of a run, the cache of query vectors, checks of the environment, and a run from sources to outputs."""

from __future__ import annotations

import importlib.util
import os
import random
import shutil
import socket
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol, TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import clustering, codegraph, graph, incremental
from skein.sources import files as S
from skein.sources import history, output, parsers, state
from skein.sources.state import checkpoint_folder

R = TypeVar("R")


class Embedder(Protocol):
    """Gives vectors of one length for texts, in their order."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class LanguageModel(Protocol):
    """Completes a prompt; budget is the characters that it takes."""

    budget: int

    def complete(self, system: str, user: str) -> str: ...


class LanguageProcessor(Protocol):
    """Entities and imports of a source text."""

    name: str
    extensions: tuple[str, ...]

    def parse(self, source: str) -> tuple[list, list]: ...


class Chunker(Protocol):
    """Blocks of a source text."""

    def chunk(self, source: str, path: str, language: str) -> list: ...


class SemanticSearch(Protocol):
    """An index of vectors: add, find, remove by file, clear, count."""

    def add(self, rows: DataFrame) -> None: ...
    def search(self, query: str, limit: int) -> DataFrame: ...
    def remove(self, files: DataFrame) -> int: ...
    def clear(self) -> None: ...
    def count(self) -> int: ...


class Canned:
    """A language model without a model: answers by the first prefix of the prompt that it knows, else with nothing."""

    def __init__(self, answers: dict[str, str], budget: int = 8000):
        self.answers, self.budget = answers, budget

    def complete(self, system: str, user: str) -> str:
        return next((a for p, a in self.answers.items() if user.startswith(p)), "")


class Transient(Exception):
    """A failure that may pass: too many requests, an error of the server, no answer in time."""


def retry(call: Callable[[], R], tries: int = 3, longest: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> R:
    """The result of a call that is made again after Transient failures, after waits that double and vary, `longest` seconds at most; the last failure is raised."""
    for n in range(tries):
        try:
            return call()
        except Transient:
            if n == tries - 1:
                raise
            sleep(min(longest, 0.5 * 2**n) * random.uniform(0.5, 1.0))
    raise ValueError("no tries")


class Busy(Exception):
    """Another run holds the lock."""


def _left_behind(path: Path) -> bool:
    """Whether a lock's owner was a process of this machine that is no more."""
    try:
        host, _, process = path.read_text().partition(" ")
        os.kill(int(process), 0)
    except ProcessLookupError:
        return host == socket.gethostname()
    except (OSError, ValueError):
        return False
    return False


@contextmanager
def run_lock(folder: str, wait_s: float = 0.0, skip: bool = False) -> Iterator[bool]:
    """Hold the lock of an output folder: True while it is held. Where another run holds it: wait up to wait_s, then give False (skip) or raise Busy.
    The lock of a run of this machine whose process is gone is taken over."""
    path, until = Path(folder) / ".lock", time.monotonic() + wait_s
    path.parent.mkdir(parents=True, exist_ok=True)
    while True:
        try:
            with os.fdopen(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                f.write(f"{socket.gethostname()} {os.getpid()}")
            break
        except FileExistsError:
            if _left_behind(path):
                path.unlink(missing_ok=True)
                continue
            if time.monotonic() >= until:
                if skip:
                    yield False
                    return
                raise Busy(str(path)) from None
            time.sleep(0.05)
    try:
        yield True
    finally:
        path.unlink(missing_ok=True)


class QueryVectors:
    """The last `most` vectors of queries, by model and query."""

    def __init__(self, embed: Embedder, model: str, most: int = 256):
        self.embed, self.model, self.most = embed, model, most
        self.kept: OrderedDict[tuple[str, str], list[float]] = OrderedDict()

    def __call__(self, query: str) -> list[float]:
        key = (self.model, query)
        if key not in self.kept:
            self.kept[key] = self.embed([query])[0]
        self.kept.move_to_end(key)
        if len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return self.kept[key]


def doctor(spark: SparkSession, root: str, embed: Embedder | None = None) -> DataFrame:
    """(name, ok, detail): whether a run can work here."""
    rows = [("java", True, spark.sparkContext._jvm.System.getProperty("java.version")), ("spark", True, spark.version)]
    rows += [(m, importlib.util.find_spec(m) is not None, m) for m in ("pyarrow", "pandas", "numpy")]
    rows.append(("git", shutil.which("git") is not None, history.head(root) or "no repository"))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    rows.append(("checkpoint folder", bool(shared) or spark.sparkContext.master.startswith("local["), shared or "not set"))
    try:
        n = S.every_file(spark, root).limit(1).count()
        rows.append(("sources", n > 0, root))
    except Exception as problem:  # a path that isn't there is what this check is for
        rows.append(("sources", False, str(problem).splitlines()[0]))
    try:
        size = len(embed(["test"])[0]) if embed else 0
        rows.append(("embedder", size > 0 or embed is None, f"{size} components" if embed else "none: text search only"))
    except Exception as problem:  # any failure of what is plugged in is a finding
        rows.append(("embedder", False, str(problem)))
    return spark.createDataFrame(rows, "name string, ok boolean, detail string")


@dataclass
class Run:
    """What a run has read and made."""

    nodes: DataFrame
    edges: DataFrame
    members: DataFrame
    files: DataFrame
    scope: DataFrame | None = None
    skipped: bool = False
    timings: dict[str, int] = field(default_factory=dict)


def assemble(spark: SparkSession, sources: DataFrame) -> Run:
    """The code graph of scanned files (path, language, source, sha256) with its modules. Files are numbered by path within hashes of their directories, so no task sorts them all."""
    ranged = sources.select("path", "language", "source", "sha256").withColumn("prefix", F.xxhash64(T.directory(F.col("path"))).bitwiseAND(F.lit(1023)))
    n = ranged.groupBy("prefix").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    before = n.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")  # at most 1024 rows
    numbered = ranged.join(before, "prefix").withColumn("file", F.col("before") + F.row_number().over(Window.partitionBy("prefix").orderBy("path")))
    files = numbered.select("file", "path", "source", "sha256", "language")
    bodies = T.body_slice(F.col("source"), F.col("line_start"), F.col("line_end"))
    entities = parsers.entities(files).join(files.select("file", "path", "source"), "path").select("file", "pos", "name", "kind", "line_start", "line_end", "doc", "signature", "visibility", bodies.alias("body"))
    imports = parsers.imports(files).join(files.select("file", "path"), "path").select("file", F.col("source").alias("target"))
    checkpoint_folder(spark)
    files, entities, imports = files.checkpoint(), entities.checkpoint(), imports.checkpoint()  # sources are read and parsed once
    every, edges = codegraph.build(files.select("file", "path"), entities, imports, write=True)
    placed = graph.directory_communities(files.select("path"))
    named = graph.community_names(placed).join(placed, "community").select("path", F.col("name").alias("module"))
    members = every.where("path is not null").select(F.col("id").alias("node"), "path").join(named, "path").select("node", "path", "module")
    return Run(every, edges, members.checkpoint(), files)


def run(spark: SparkSession, root: str, out: str, force: bool = False) -> Run | None:
    """From sources below a root to pages, diagrams, fingerprints and state below `out`; None where another run holds the lock.

    A run with nothing to do is skipped. Otherwise only the pages of modules that the changes reach are written again, all of them with `force`, the first time, or
    where the changes are too many.
    """
    started = time.monotonic()
    with run_lock(out, skip=True) as held:
        if not held:
            return None
        folder = output.Folder(spark, out)
        known = state.parse_state(folder.get("state.json"))
        sources = S.scan(spark, root, exclude=[os.path.relpath(out, root)] if out.startswith(root) else [])
        now = state.state_of(sources)
        old = state.fingerprints(spark, known)
        got = assemble(spark, sources)
        got.timings["scan"] = int(1000 * (time.monotonic() - started))
        diff = incremental.fingerprint_diff(old, now)
        if not force and known and not known.get("failed_modules") and diff.isEmpty():
            got.skipped = True
            return got
        cards = got.members.select("path", "module").distinct()
        everything = force or not known
        if not everything:
            sized = got.files.select("path", F.octet_length("source").alias("size")).join(diff.select("path", F.lit(True).alias("hit")), "path", "left").select("size", F.coalesce("hit", F.lit(False)).alias("changed"))
            everything = incremental.full_rebuild(sized).first().rebuild
        modules = cards.select("module").distinct()
        if not everything:
            none = spark.createDataFrame([], "file string, change string")
            failed = spark.createDataFrame([(m,) for m in known.get("failed_modules", [])], "module string")
            got.scope = incremental.update_scope(old, now, none, got.nodes.select(F.col("id").alias("node"), "path", "module"), got.edges, cards, failed, spark.createDataFrame([], "page string, text string"), spark.createDataFrame([], "path string"))
            modules = cards.join(got.scope.select("path"), "path", "left_semi").select("module").distinct()
        pages = module_pages(got).join(modules, "module", "left_semi")
        written = pages.select(F.concat(F.lit("wiki/en/"), F.replace("module", F.lit("::"), F.lit("_")), F.lit(".md")).alias("path"), "module", "content")
        written = written.withColumn("path", F.regexp_replace("path", r"[^A-Za-z0-9_./-]", "_"))
        output.write_files(written, out)
        deps = graph.dependency_lists(codegraph.uses(got.edges), got.members)
        parts = codegraph.architecture_map(got.members, deps, spark.createDataFrame([], "module string, description string"))
        lines = parts.select(F.lit(1).alias("part"), F.col("module").alias("place"), F.col("overview").alias("line")).union(parts.select(F.lit(2), "module", "dependencies"))
        output.write_lines(lines, out, "architecture-map.md", "# Architecture map\n")
        got.timings["total"] = int(1000 * (time.monotonic() - started))
        output.write_timings(spark, out, got.timings)
        folder.put("state.json", state.as_json({"file_fingerprints": {r.path: r.hash for r in now.toLocalIterator()}, "last_commit_hash": history.head(root), "failed_modules": []}))
        return got


def module_pages(got: Run) -> DataFrame:
    """(module, content): a page for each module with its entities and what it depends on."""
    names = got.members.join(got.nodes.where("line_start is not null").select(F.col("id").alias("node"), "kind", "name", "line_start"), "node")
    line = F.concat(F.lit("- `"), "name", F.lit("` ("), "kind", F.lit(") — "), "path", F.lit(":"), F.col("line_start").cast("string"))
    listed = names.groupBy("module").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "line_start", line.alias("line")))), lambda x: x["line"]), "\n").alias("entities"))
    deps = graph.dependency_lists(codegraph.uses(got.edges), got.members)
    dep = F.when(F.size("uses") > 0, F.concat(F.lit("\n\n## Dependencies\n\n"), F.array_join(F.transform("uses", lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")
    return got.members.select("module").distinct().join(listed, "module", "left").join(deps, "module").select("module", F.concat(F.lit("# "), "module", F.lit("\n\n## Entities\n\n"), F.coalesce("entities", F.lit("")), dep, F.lit("\n")).alias("content"))


def communities_of(got: Run) -> DataFrame:
    """(path, community, place) by the Potts model over imports and calls between files."""
    own = got.nodes.where("path is not null").select(F.col("id").alias("node"), F.col("file"))
    lifted = got.edges.where("kind in ('Imports', 'Calls')").join(own.select(F.col("node").alias("src"), F.col("file").alias("s")), "src").join(own.select(F.col("node").alias("dst"), F.col("file").alias("t")), "dst")
    weights = lifted.where("s <> t").groupBy("s", "t").agg(F.sum("weight").alias("weight"))
    return clustering.communities(got.files.select(F.col("file").alias("node"), "path"), weights)
