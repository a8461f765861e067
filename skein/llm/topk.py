"""Exact top-k search by inner product: a ball tree for each shard, searched by branch and bound.

The inner product of a query q with any vector of a ball is at most q . centre + |q| * radius. Nodes whose bound is below the query's current
kth score are cut off with all below them; leaves are read in the order of their bounds. A first eighth of the shards gives every query
a kth score that all other shards share from the start.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ann import matrix
from .base import drop_table, table, write_table
from .vectors import best, classes, first_of, usable

#: Vectors of a shard, shards at least, vectors of a leaf, queries that meet one copy of a shard's tree, those of them that are searched at a time, and the share of shards of the first wave.
SHARD, SHARDS, LEAF, QUERIES, BATCH, WAVE = 16_384, 16, 32, 16_384, 512, 8


class BallTree:
    """Nodes level by level, each a centre, a radius and a range of the reordered rows; the two below node n are 2n + 1 and 2n + 2."""

    def __init__(self, x: np.ndarray):
        self.depth = max(0, math.ceil(math.log2(max(1, len(x) / LEAF))))
        self.order = np.arange(len(x))
        spans = [(0, len(x))]
        self.levels = []
        for level in range(self.depth + 1):
            if level:
                halves = []
                for a, b in spans:
                    own = self.order[a:b]
                    mid = (b - a) // 2
                    if b - a > 1:
                        axis = np.argmax(np.ptp(x[own], axis=0))
                        self.order[a:b] = own[np.argpartition(x[own, axis], mid)]
                    halves += [(a, a + mid), (a + mid, b)]
                spans = halves
            centre = np.array([x[self.order[a:b]].mean(axis=0) if b > a else np.zeros(x.shape[1]) for a, b in spans])
            radius = np.array([np.sqrt(((x[self.order[a:b]] - c) ** 2).sum(axis=1).max()) if b > a else -np.inf for (a, b), c in zip(spans, centre, strict=True)])
            self.levels.append((centre, radius))
        self.spans = spans

    def bounds(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """(queries, leaves): the least bound on the way to each leaf; minus infinity where a node on it was cut off."""
        length = np.sqrt((q * q).sum(axis=1))
        up = None
        for centre, radius in self.levels:
            reach = q @ centre.T + length[:, None] * np.maximum(radius, 0)[None]
            reach += 1e-9 * (np.abs(reach) + length[:, None] * np.sqrt((centre * centre).sum(axis=1))[None]) + 1e-6
            reach[:, ~np.isfinite(radius)] = -np.inf
            up = reach if up is None else np.minimum(np.repeat(up, 2, axis=1), reach)
            up[up < kth[:, None]] = -np.inf
        return up


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered doubles: as doubles where no sum can leave their exact range, else as integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    if most < 2.0**53:
        return (x @ q).astype(np.int64)
    a = [int(c) for c in q]
    return np.array([max(-(2**63), min(2**63 - 1, sum(u * int(c) for u, c in zip(a, row, strict=True)))) for row in x], dtype=np.int64)


def branch_and_bound(q: np.ndarray, kth: np.ndarray, x: np.ndarray, names: np.ndarray, k: int, tree: BallTree | None = None, shared: bool = False) -> list[list[tuple[int, int]]]:
    """For each query its k best (score, row of x), ties to smaller names, among those not below its kth score so far; where rows may share a name, the best of each."""
    tree = tree or BallTree(x)
    reach = tree.bounds(q, kth)
    order = np.argsort(-reach, axis=1, kind="stable")
    out = []
    for i in range(len(q)):
        floor, score, row = kth[i], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, order.shape[1], 8):
            leaves = order[i, at : at + 8]
            leaves = leaves[reach[i, leaves] >= max(floor, np.finfo(float).min)]
            if not len(leaves):
                break
            rows = np.concatenate([tree.order[slice(*tree.spans[n])] for n in leaves])
            got = products(q[i], x[rows])
            keep = got >= floor
            score, row = np.concatenate([score, got[keep]]), np.concatenate([row, rows[keep]])
            first = np.lexsort((names[row], -score))
            first = (first_of(names[row], first) if shared else first)[:k]
            score, row = score[first], row[first]
            if len(score) == k:
                floor = max(floor, float(score[-1]))
        out.append(list(zip(score.tolist(), row.tolist(), strict=True)))
    return out


def search(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of floor(scale * x) for each row whose id is divisible by `every`.

    Exact. Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without id; vectors are compared
    with those of their own length; equal rows count once; of an id with several vectors the best pair counts, as query and as
    candidate, and it is found once; scores beyond 64 bits stop at their ends; other columns are ignored; with
    fewer than k candidates all are given; an empty table gives an empty result.
    """
    used = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null").where(usable(F.col("v")))
    whole = F.transform("v", lambda x: _floor(x.cast("double") * F.lit(float(scale))))
    used = used.select("id", whole.alias("v")).where(usable(F.col("v")))
    reps, members, odd = classes(used, k)
    asked = members.where(F.col("id") % every == 0)
    wanted = write_table(asked.select("rep").distinct().join(reps.select("rep", "v"), "rep"), "queries")
    found, left = _search(reps, wanted, k, odd)
    out = best(found, asked, reps, k, odd)
    drop_table(wanted, *left)
    return out


def _floor(x):
    """The floor of a double as a double; beyond 2**52 doubles are whole already."""
    return F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)


def _search(reps: DataFrame, wanted: DataFrame, k: int, odd: bool) -> tuple[DataFrame, list[DataFrame]]:
    """(rep, hit, owner, score), and written tables of which it is made."""
    rows, queries = reps.count(), wanted.count()
    shards, shares = max(SHARDS, math.ceil(rows / SHARD)), max(1, math.ceil(queries / QUERIES))
    keys = ("dims", "shard", "share")
    dealt = reps.select("rep", "owner", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"))

    def task(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and held.num_rows:
            who, q, kth = asked["rep"].to_numpy(), matrix(asked["v"]), asked["kth"].to_numpy()
            x, names, owners = matrix(held["v"]), held["rep"].to_numpy(), held["owner"].to_numpy()
            tree = BallTree(x)
            for at in range(0, len(q), BATCH):
                some = slice(at, at + BATCH)
                best_of = branch_and_bound(q[some], kth[some], x, owners, k + 1, tree, odd)
                out += [(int(w), int(names[row]), int(owners[row]), score) for w, hits in zip(who[some], best_of, strict=True) for score, row in hits]
        return pa.table({n: pa.array([o[c] for o in out], pa.int64()) for c, n in enumerate(("rep", "hit", "owner", "score"))})

    def wave(queries_: DataFrame, first: bool) -> DataFrame:
        def now(shard):
            return (shard % WAVE == 0) if first else (shard % WAVE != 0)

        share = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(shares)).cast("int")
        asks = queries_.withColumn("dims", F.size("v")).withColumn("share", share).withColumn("shard", F.explode(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), now)))
        held = dealt.where(now(F.col("shard"))).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        return asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(task, "rep long, hit long, owner long, score long")

    start = write_table(wave(wanted.select("rep", "v", F.lit(float("-inf")).alias("kth")), True), "first-wave")
    # the (k + 1)th score so far, by a count of the better ones that stops at k + 1 before the shuffle
    order = Window.partitionBy("rep").orderBy(F.col("score").desc(), "hit")
    seen = start.groupBy("rep", F.col("owner").alias("hit")).agg(F.max("score").alias("score")) if odd else start
    kth = seen.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("rep").agg(F.min("score").alias("s"), F.count("*").alias("n"))
    kth = kth.select("rep", F.when(F.col("n") > k, F.col("s").cast("double")).otherwise(F.lit(float("-inf"))).alias("kth"))
    rest = write_table(wave(wanted.join(kth, "rep", "left").select("rep", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("kth")), False), "second-wave")
    return start.union(rest), [start, rest]


#: All pairs of queries and candidates.
ORACLE = """with v as (select distinct vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, max(cast(list_inner_product(q.v, c.v) as bigint)) as score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v) group by all)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from p
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5"""


def query(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))
