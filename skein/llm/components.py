"""Connected components of links, for graphs that no single machine holds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop_table, write_table


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find within one partition: (node, root) instead of all its links. A new forest begins after a million nodes."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> pa.RecordBatch:
        rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["u", "v"])

    for b in batches:
        for x, y in zip(b["u"].to_pylist(), b["v"].to_pylist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
        if len(parent) > 1_000_000:
            yield out()
            parent.clear()
    yield out()


#: Links that one task may join by itself; about 20 MB.
LOCAL = 100_000


def components(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """(id, component) for every id that a link of `links` (u, v: long) names; component is the smallest id reachable.

    Union-find inside each partition first leaves a forest; then large-star and small-star steps alternate until
    nothing changes, which takes a number of rounds logarithmic in the longest chain. A forest of at most `local` links is joined by one
    more union-find in a single task instead. Every step is a min per node, combined
    before the shuffle, and a join whose large keys Spark can split. Null ends and loops are ignored.
    """
    ends = links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = write_table(ends.mapInArrow(_forest, "u long, v long").distinct(), "links")
    state = None
    if edges.count() <= local:
        done, edges = edges, write_table(edges.coalesce(1).mapInArrow(_forest, "u long, v long"), "links")
        drop_table(done)
        state = ()
    while state != ():
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).union(edges.select(F.col("v").alias("n"), F.col("u").alias("x")))
        least = write_table(both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m")), "links-large")
        large = write_table(both.where("x > n").join(least, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), "links")
        small = write_table(large.groupBy("u").agg(F.min("v").alias("m")), "links-small")
        turned = large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = write_table(turned.where("u <> v").distinct(), "links")
        drop_table(edges, least, large, small)
        edges = new
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
