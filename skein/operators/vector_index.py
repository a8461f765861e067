"""A stored vector index: coarse lists with residual bounds, and an exact threshold and top-k search that reads the lists it must."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import retrieval as R
from skein.operators.index import Index
from skein.sources.scratch import Scratch

#: Vectors that fit the lists, lists at most, vectors of a list on average at least, lists of a query that are read first, and the list of vectors without direction.
SAMPLE, LISTS, EACH, FIRST, NOWHERE = 20_000, 1024, 64, 2, -1


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def fit(sample: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Centres of the sample's directions, by a few rounds of means."""
    x = _unit(sample[np.abs(sample).max(axis=1) > 0])
    if not len(x):
        return np.zeros((1, sample.shape[1]))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(8):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(count > 0, sums / np.maximum(count, 1), centres)
    return centres


def _pieces(b: pa.RecordBatch, cells: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose rows have R.CELLS cells at most together, `cells` each."""
    step = max(1, R.CELLS // max(1, cells))
    for at in range(0, b.num_rows, step):
        yield b.slice(at, step)


def placed(batch: pa.RecordBatch, centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(file, node, v, far, list) of vectors (file, node, v): the nearest centre and the distance from it."""
    for b in _pieces(batch, centres.size):
        x = _matrix(b["v"])
        u = _unit(x)
        near = np.argmin((centres * centres).sum(axis=1)[None] - 2 * u @ centres.T, axis=1)
        far = np.linalg.norm(u - centres[near], axis=1)
        near = np.where(np.abs(x).max(axis=1) > 0, near, NOWHERE).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b["file"], b["node"], b["v"], pa.array(far), pa.array(near)], ["file", "node", "v", "far", "list"])


def reached(batch: pa.RecordBatch, centres: np.ndarray, radii: dict[int, float], farthest: float) -> Iterator[pa.RecordBatch]:
    """(query, q, list, low, place) of queries (query, q): the lists that may hold vectors within `farthest`, by how near these could be."""
    lists = np.array(sorted(x for x in radii if x != NOWHERE), dtype=np.int64)
    r = np.array([radii[x] for x in lists.tolist()])
    for b in _pieces(batch, centres.size):
        x = _matrix(b["q"])
        d = np.sqrt(np.maximum(0, ((_unit(x)[:, None] - centres[lists][None]) ** 2).sum(axis=2))) if len(lists) else np.zeros((len(x), 0))
        low = np.maximum(0, d - r[None] - 1e-9) ** 2 / 2
        low[np.abs(x).max(axis=1) == 0] = 1.0  # a query without direction is at distance 1 from all
        order = np.argsort(np.argsort(low + 1e-12 * d, axis=1, kind="stable"), axis=1)
        i, j = np.nonzero(low <= farthest + 1e-6)
        which, bound, place = lists[j], low[i, j], order[i, j]
        if NOWHERE in radii and farthest >= 1:
            i, which = np.append(i, np.arange(len(x))), np.append(which, np.full(len(x), NOWHERE))
            bound, place = np.append(bound, np.ones(len(x))), np.append(place, np.full(len(x), len(lists)))
        at = pa.array(i)
        yield pa.RecordBatch.from_arrays([b["query"].take(at), b["q"].take(at), pa.array(which.astype(np.int32)), pa.array(bound.astype(float)), pa.array(place.astype(np.int32))], ["query", "q", "list", "low", "place"])


class VectorIndex:
    """Vectors (file, node, v) of one length below a folder, in segments whose folders are lists.

    Each vector lies in the list of its nearest centre, with its exact distance from it; a table of each segment has the lists' sizes and the largest of these distances. Adding writes a segment with
    the centres as they are, removing writes names of files, compact() fits new centres.
    """

    def __init__(self, spark: SparkSession, path: str, node_type: str = "long", model: str = ""):
        self.spark, self.path = spark, path.rstrip("/")
        self.index = Index(spark, f"{self.path}/rows", f"file string, node {node_type}, v array<double>, far double, list int", model=model, by="list")

    def _centres(self, version: int) -> np.ndarray:
        got = self.spark.read.schema("list int, centre array<double>").parquet(f"{self.path}/centres/{version}").orderBy("list").toArrow()["centre"]  # LISTS rows at most
        return _matrix(got.combine_chunks())

    def _placed(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        node = rows.schema["node"].dataType.simpleString()
        shared = self.spark.sparkContext.broadcast(centres)  # LISTS vectors at most

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from placed(b, shared.value)

        v = F.transform("v", lambda x: x.cast("double"))
        return rows.select("file", "node", v.alias("v")).where("v is not null").mapInArrow(place, f"file string, node {node}, v array<double>, far double, list int")

    def _add(self, rows: DataFrame, fresh: bool) -> None:
        m = self.index.manifest()
        scratch = Scratch(self.spark, "vectors")
        rows = scratch.save(rows.where("v is not null").select("file", "node", "v"))
        dims = self.index._dims(rows, "v", m["dims"])
        if fresh or self.index.needs_rebuild() or not m["segments"] or dims != m["dims"]:
            fresh, n = True, rows.count()
            sample = rows.orderBy(F.xxhash64("file", "node"), "node").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
            centres = fit(_matrix(sample) if n else np.zeros((1, 1)), max(1, min(LISTS, math.isqrt(n), n // EACH)))
            version = m["version"] + 1
            self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/centres/{version}")
        else:
            version = self._fitted(m)
            centres = self._centres(version)
        placed = scratch.save(self._placed(rows, centres))
        sizes = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("radius")).withColumn("version", F.lit(version).cast("long"))
        sizes.coalesce(1).write.parquet(f"{self.path}/lists/segment-{m['version'] + 1}")
        # many tasks write to one list's folder only where the list is large
        (self.index.rebuild if fresh else self.index.add)(placed.repartition("list", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.lit(rows.count() // (R.VECTORS * LISTS))))), "v")
        scratch.drop(rows, placed)

    def _fitted(self, manifest: dict) -> int:
        return self.spark.read.parquet(f"{self.path}/lists/{manifest['segments'][0]}").select("version").first()[0]

    def add(self, rows: DataFrame) -> None:
        """Append vectors; a first time, and for vectors of another length, the index is made anew."""
        self._add(rows, False)

    def rebuild(self, rows: DataFrame) -> None:
        self._add(rows, True)

    def remove(self, files: DataFrame) -> int:
        return self.index.remove(files)

    def update(self, rows: DataFrame, changed: DataFrame) -> None:
        """Delete the changed files (file) and add the vectors of theirs that rows has."""
        self.remove(changed)
        new = rows.join(changed.select("file").distinct(), "file", "left_semi")
        if not new.isEmpty():
            self.add(new)

    def compact(self) -> None:
        """One segment with new centres, without what was removed."""
        self.rebuild(self.index.rows().select("file", "node", "v"))

    def search(self, queries: DataFrame, k: int = 10, farthest: float = R.FARTHEST, told: dict | None = None) -> DataFrame:
        """(query, node, distance, rank) as neighbours() of all vectors would give them, for queries (query, q).

        On unit vectors the cosine distance is half the squared distance, and a query can be no nearer to a list's vectors than to its centre, less the list's radius. Lists beyond `farthest` are
        never read for a query; the FIRST nearest are read first, and their kth distance rules out more of the rest. Nothing that could be among the k nearest is ruled out. `told` takes
        the numbers of pairs of queries and lists, and of those that met.
        """
        m = self.index.manifest()
        scratch = Scratch(self.spark, "near")
        asked = queries.where("q is not null").select("query", F.transform("q", lambda x: x.cast("double")).alias("q")).where(F.size("q") == (m["dims"] or 0))
        held = self.index.rows()
        empty = queries.select("query").where("false").join(held.select("node").where("false")).select("query", "node", F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("rank"))
        if not m["segments"]:
            return empty
        sizes = self.spark.read.parquet(*(f"{self.path}/lists/{s}" for s in m["segments"])).groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()  # LISTS + 1 rows at most
        radius = {r["list"]: r["radius"] for r in sizes}
        blocks = {r["list"]: -(-r["n"] // R.VECTORS) for r in sizes}
        shared = self.spark.sparkContext.broadcast((self._centres(self._fitted(m)), radius))
        query_type = asked.schema["query"].dataType.simpleString()

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from reached(b, *shared.value, farthest)

        pairs = scratch.save(asked.repartition(max(1, self.spark.sparkContext.defaultParallelism)).mapInArrow(reach, f"query {query_type}, q array<double>, list int, low double, place int"))
        per = F.element_at(F.create_map(*(F.lit(x) for p in blocks.items() for x in p)), F.col("list"))
        met = []

        def distances(some: DataFrame) -> DataFrame:
            lists = [r[0] for r in some.select("list").distinct().collect()]  # LISTS + 1 at most
            met.append(some.count() if told is not None else 0)
            if not lists:
                return empty.drop("rank")
            v = held.where(F.col("list").isin(lists)).select("node", "v", "list", F.pmod(F.xxhash64("node"), per).cast("int").alias("block"))
            share = F.pmod(F.xxhash64("query"), F.lit(max(1, -(-some.count() // (R.QUERIES * len(lists)))))).cast("int")
            q = some.select("query", "q", "list", F.explode(F.sequence(F.lit(0), per - 1)).alias("block"), share.alias("share"))
            shares = q.select("list", "block", F.col("share").alias("s")).distinct()
            v = v.join(shares, ["list", "block"]).select("node", "v", *((F.col(c) + 0).alias(n) for c, n in (("list", "list"), ("block", "block"), ("s", "share"))))  # names of their own
            return R._meet(q, v, ("list", "block", "share"), k, farthest)

        best = Window.partitionBy("query").orderBy("distance", "node")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
        start = scratch.save(ranked(distances(pairs.where(F.col("place") < FIRST))))
        kth = start.where(F.col("rank") == k).select("query", F.col("distance").alias("kth"))
        rest = scratch.save(pairs.where(F.col("place") >= FIRST).join(kth, "query", "left").where("kth is null or low <= kth + 1e-6").select("query", "q", "list"))
        out = scratch.save(ranked(start.drop("rank").union(distances(rest))))
        if told is not None:
            told |= {"pairs": asked.count() * len(radius), "met": sum(met)}
        scratch.drop(pairs, start, rest)
        return out
