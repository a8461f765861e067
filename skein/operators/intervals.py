"""Tightest containing interval, without meeting every interval of a file with every node of it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.scratch import Scratch

#: Nodes and blocks of one key that one task takes.
MOST = 100_000


def dominated(x: np.ndarray, y: np.ndarray, value: np.ndarray, at: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """For each query (at, upto) the least value of points with x <= at and y >= upto; len(value) where there is none. Values are numbers from 0 on, each once.

    Points and queries are ordered by x; in each of the halvings of that order, the queries of right halves see the points of left halves in the order of y, by a running minimum.
    """
    m, n = len(x), len(x) + len(at)
    kind = np.repeat([0, 1], [m, len(at)])
    order = np.lexsort((kind, np.concatenate([x, at])))
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    height, own = np.concatenate([y, upto]), np.concatenate([value, np.full(len(at), m)])
    best = np.full(n, m)
    down = np.lexsort((kind, -height))  # once: each halving keeps this order inside its segments
    span = 1
    while span < n:
        segment = place[down] // (2 * span)
        by = down[np.argsort(segment, kind="stable")]
        left = (place[by] // span) % 2 == 0
        # a later segment's numbers are all smaller, so the minimum starts anew with it
        shift = (place[by] // (2 * span)) * (m + 1)
        run = np.minimum.accumulate(np.where(left, own[by], m) - shift) + shift
        best[by] = np.where(left, best[by], np.minimum(best[by], run))
        span *= 2
    return best[m:]


def _meet(queries: pa.Table, points: pa.Table) -> pa.Table:
    keys = pa.chunked_array([*queries["k"].chunks, *points["k"].chunks], pa.string()).combine_chunks().dictionary_encode()
    code = keys.indices.to_numpy().astype(np.int64)
    ask, own = code[: queries.num_rows], code[queries.num_rows :]

    def joint(name: str) -> tuple[np.ndarray, np.ndarray]:
        """Ranks by key and number: points of another key are either beyond x or short of y."""
        a, b = (t[name].to_numpy() for t in (queries, points))
        ranks = np.unique(np.concatenate([a, b]), return_inverse=True)[1].astype(np.int64)
        ranks += np.concatenate([ask, own]) * (len(ranks) + 1)
        return ranks[: len(a)], ranks[len(a) :]

    (at, x), (upto, y) = joint("x"), joint("y")
    value = np.empty(points.num_rows, dtype=np.int64)
    ordered = points.append_column("i", pa.array(np.arange(points.num_rows))).sort_by([("len", "ascending"), ("block", "ascending")])["i"].to_numpy()
    value[ordered] = np.arange(points.num_rows)
    best = dominated(x, y, value, at, upto) if points.num_rows else np.full(queries.num_rows, 0)
    hit = np.flatnonzero(best < points.num_rows)
    which = pa.array(ordered[best[hit]])
    return pa.table([*(queries[c].take(pa.array(hit)) for c in ("k", "x", "y")), points["len"].take(which), points["block"].take(which)], names=["k", "x", "y", "len", "block"])


def _least(points: DataFrame, queries: DataFrame, total: int, most: int) -> DataFrame:
    """(k, x, y, len, block): for each query (k, x, y) the least (len, block) of the points (k, x, y, len, block) of its key with x not beyond and y not short of its own."""
    buckets = -(-total // most) + 1
    deal = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)))
    schema = f"k string, x long, y long, len long, block {points.schema['block'].dataType.simpleString()}"
    return deal(queries).groupBy("bucket").cogroup(deal(points).groupBy("bucket")).applyInArrow(_meet, schema)


def _contain(scratch: Scratch, q: DataFrame, blocks: DataFrame, most: int) -> DataFrame:
    """(p, a, b, len, block) of distinct queries (p, a, b) in blocks (p, ba, bb, len, block).

    A path with more than `most` rows is cut into ranges of lines. Then a block that contains a query either starts in the range where the query does, or ends in the range where
    the query does, or starts in an earlier range and ends in a later one. The first two meet in one range; for the last, only the least block of each pair of ranges counts, and the question
    is the same one among ranges instead of lines.
    """
    per = q.groupBy("p").agg(F.count("*").alias("n")).union(blocks.groupBy("p").agg(F.count("*"))).groupBy("p").agg(F.sum("n").alias("n"))
    per = scratch.save(per)
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = per.where(F.col("n") > most).select("p")
    points = lambda df, k, x: df.select(F.col(k).alias("k"), F.col(x).alias("x"), F.col("bb").alias("y"), "len", "block")
    asks = lambda df, k, x: df.select(F.col(k).alias("k"), F.col(x).alias("x"), F.col("b").alias("y")).distinct()
    if large.isEmpty():
        return _least(points(blocks, "p", "ba"), asks(q, "p", "a"), total, most).select(F.col("k").alias("p"), F.col("x").alias("a"), F.col("y").alias("b"), "len", "block")
    inside = lambda df: df.join(large, "p", "left_semi")
    rest = _contain(scratch, q.join(large, "p", "left_anti"), blocks.join(large, "p", "left_anti"), most)
    q, blocks = scratch.save(inside(q)), scratch.save(inside(blocks))
    ends = q.select("p", F.explode(F.array("a", "b")).alias("line")).union(blocks.select("p", F.explode(F.array("ba", "bb")))).groupBy("p", "line").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("p").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ranges = scratch.save(ends.select("p", "line", F.floor(before / most).alias("r")))  # a row for each line of a path that something starts or ends in

    def ranged(df: DataFrame, line: str, r: str) -> DataFrame:
        return df.join(ranges.select("p", F.col("line").alias(line), F.col("r").alias(r)), ["p", line])

    key = lambda r, what: F.concat_ws("\0", "p", F.col(r).cast("string"), F.lit(what))
    q = scratch.save(ranged(ranged(q, "a", "ra"), "b", "rb").withColumns({"starts": key("ra", "s"), "ends": key("rb", "e"), "to": F.col("ra") - 1, "from": F.col("rb") + 1}))
    blocks = scratch.save(ranged(ranged(blocks, "ba", "sr"), "bb", "er").withColumns({"starts": key("sr", "s"), "ends": key("er", "e")}))
    own = points(blocks, "starts", "ba").union(points(blocks.where("sr < er"), "ends", "sr"))
    asked = asks(q, "starts", "a").union(asks(q, "ends", "to"))
    met = scratch.save(_least(own, asked, total, most))
    cells = blocks.where("er > sr + 1").groupBy("p", F.col("sr").alias("ba"), F.col("er").alias("bb")).agg(F.min(F.struct("len", "block")).alias("v")).select("p", "ba", "bb", "v.len", "v.block")
    above = _contain(scratch, q.select("p", F.col("to").alias("a"), F.col("from").alias("b")).distinct(), scratch.save(cells), most)
    on = lambda k, x: met.select(F.col("k").alias(k), F.col("x").alias(x), F.col("y").alias("b"), "len", "block")
    parts = q.join(on("starts", "a"), ["starts", "a", "b"]).select("p", "a", "b", "len", "block")
    parts = parts.union(q.join(on("ends", "to"), ["ends", "to", "b"]).select("p", "a", "b", "len", "block"))
    parts = parts.union(q.select("p", F.col("a").alias("qa"), F.col("b").alias("qb"), F.col("to").alias("a"), F.col("from").alias("b")).join(above, ["p", "a", "b"]).select("p", "qa", "qb", "len", "block"))
    found = parts.groupBy("p", "a", "b").agg(F.min(F.struct("len", "block")).alias("v")).select("p", "a", "b", "v.len", "v.block")
    return rest.union(found)


def tightest(nodes: DataFrame, blocks: DataFrame, most: int = MOST) -> DataFrame:
    """(node, block) of nodes (node, path, a, b) in blocks (block, path, ba, bb): the shortest that contains the node, then the first; null without one or without path. Of a node that stands in several rows, each row gets the least of all.

    No task takes more than about `most` rows of a path, and nothing but one least block meets a node for each of a few questions: time grows with nodes plus blocks, times the logarithm of `most`.
    """
    scratch = Scratch(nodes.sparkSession, "intervals")
    path = F.col("path").cast("string").alias("p")
    line = lambda c, n: F.col(c).cast("long").alias(n)
    q = scratch.save(nodes.where("path is not null and a is not null and b is not null").select(path, line("a", "a"), line("b", "b")).distinct())
    b = blocks.where("path is not null and ba is not null and bb is not null").select(path, line("ba", "ba"), line("bb", "bb"), "block")
    b = scratch.save(b.groupBy("p", "ba", "bb").agg(F.min("block").alias("block")).select("p", "ba", "bb", (F.col("bb") - F.col("ba")).alias("len"), "block"))
    found = _contain(scratch, q, b, most).select("p", F.col("a").alias("qa"), F.col("b").alias("qb"), "len", "block")
    each = nodes.select("node", path, line("a", "qa"), line("b", "qb"))
    inside = each.join(found, ["p", "qa", "qb"]).groupBy("node").agg(F.min_by("block", F.struct("len", "block")).alias("block"))
    return nodes.join(inside, "node", "left").select("node", "block")
