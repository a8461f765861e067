"""What a tool or a person calls: search, symbols, dependencies, status."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph as G
from skein.operators import retrieval as R

MOST, ENGINES = 50, ("text", "semantic", "hybrid")
Embed = Callable[[str], list[float]]


def clamp(top_k: int) -> int:
    return max(1, min(MOST, top_k))


def segment(name: str) -> str:
    """A name that is one path segment, else an error."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError(f"not one segment: {name!r}")
    return name


def search(query: str, *, postings: DataFrame | None = None, vectors: DataFrame | None = None, embed: Embed | None = None, engine: str = "hybrid", top_k: int = 10) -> DataFrame:
    """(query, node, score, rank) of one query. hybrid looks twice as deep among vectors and, without them, is text alone; a missing index is an error."""
    if engine not in ENGINES:
        raise ValueError(f"engine {engine!r}; there are {', '.join(ENGINES)}")
    k = clamp(top_k)
    some = postings if postings is not None else vectors
    if some is None or (engine == "text" and postings is None) or (engine == "semantic" and (vectors is None or embed is None)):
        raise LookupError(f"no index for {engine}")
    spark = some.sparkSession
    if not query.strip():
        return spark.createDataFrame([], "query int, node long, score double, rank long")
    hits = []
    engines = []
    if engine != "semantic" and postings is not None:
        terms = spark.createDataFrame([(query,)], "q string").select(F.lit(1).alias("query"), F.explode(T.tokens(F.lower("q"))).alias("term"))
        engines.append(lambda: R.bm25(postings, terms, k))
    if engine != "text" and vectors is not None and embed is not None:
        engines.append(lambda: _semantic(spark, query, vectors, embed, k if engine == "semantic" else 2 * k))
    for one in engines:
        try:
            # a result is k rows; taking it here lets a failing engine drop out alone
            rows = one()
            hits.append(spark.createDataFrame(rows.collect(), rows.schema))
        except Exception:
            if engine != "hybrid" or one is engines[-1] and not hits:
                raise
    return hits[0] if engine != "hybrid" else R.fuse(hits, k)


def _semantic(spark, query: str, vectors: DataFrame, embed: Embed, k: int) -> DataFrame:
    q = spark.createDataFrame([(1, embed(query))], "query int, q array<double>")
    return R.neighbours(vectors, q, k).select("query", "node", (1 - F.col("distance")).alias("score"), "rank")


def enriched(hits: DataFrame, nodes: DataFrame, index: DataFrame, source: str) -> DataFrame:
    """Hits with the name of their node (node, name), its callers and callees, and the engine's name."""
    return R.tagged(R.enrich(hits.join(nodes.select("node", "name"), "node", "left"), index), source)


def dependencies(edges: DataFrame, members: DataFrame, module: str) -> DataFrame:
    return G.dependency_lists(edges, members).where(F.col("module") == module)


def status(nodes: DataFrame, edges: DataFrame, pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(what, n): how many nodes, edges, pages and issues there are."""
    out = None
    for what, df in (("nodes", nodes), ("edges", edges), ("pages", pages), ("issues", issues)):
        part = df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = part if out is None else out.union(part)
    return out
