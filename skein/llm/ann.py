"""Approximate nearest neighbours: an inverted file whose lists are scanned by adaptive dimension sampling.

Vectors are rotated at random, so that the first columns of a difference are a fair sample of all. A candidate's distance over the first d of D columns,
scaled by D / d, is tested against the query's bound: if it is beyond the bound by more than (1 + EPSILON / sqrt(d)) the candidate is
abandoned with an error of known rate; the rest are read a column block further. What survives is scored on the original vectors.

Lists are dealt out in blocks of bounded size, each with bounded blocks of the queries that probe the list, so a list that
holds a third of all vectors is the work of many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import table, write_table
from .vectors import best, classes, first_of, usable

#: Vectors that fit the lists and the queries' first bounds: a bounded sample, the smallest by hash.
SAMPLE = 16_384
#: Lists at most; rows of a list at least and of one task's part of a list; queries that meet it at a time.
LISTS = 1024
BLOCK, QUERIES, COLUMNS, EPSILON, RECALL = 4096, 512, 16, 2.1, 0.98
#: Queries that meet one copy of a part of a list.
SHARE = 16_384


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, whatever their scale."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, rows: int, k: int, seed: int = 7) -> dict:
    """Rotation, list centres, the sample itself, and as many probes as gave RECALL on queries of the sample."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    x = _unit(sample) @ turn
    lists = max(1, min(len(x), LISTS, math.isqrt(rows), rows // BLOCK))  # of BLOCK rows at least
    centres = x[rng.permutation(len(x))[:lists]]
    for _ in range(8):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    near = np.argmax(x @ centres.T, axis=1)
    q = x[:256]
    score = q @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    kth = min(k, max(1, len(x) - 1))
    true = np.argpartition(-score, kth - 1, axis=1)[:, :kth]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)  # when each list is probed
    when = np.take_along_axis(place, near[true], axis=1).reshape(-1)
    probes = int(np.quantile(when, RECALL, method="higher")) + 1 if len(when) else lists
    return {"turn": turn, "centres": centres, "sample": x, "near": near, "probes": min(lists, max(8, math.ceil(1.5 * probes))), "k": k}


def scan(q: np.ndarray, bound: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, cosine): for each query the k best candidates, of each owner the best, that its bound on the squared distance doesn't rule out."""
    a, b = _unit(q) @ turn, _unit(x) @ turn
    dims = a.shape[1]
    limit = bound * (1 + 1e-9) + 1e-12
    d = min(COLUMNS, dims)
    part = (a[:, :d] ** 2).sum(axis=1)[:, None] + (b[:, :d] ** 2).sum(axis=1)[None] - 2 * a[:, :d] @ b[:, :d].T
    i, j = np.nonzero(part * (dims / d) <= (limit * ((1 + EPSILON / math.sqrt(d)) ** 2 if d < dims else 1.0))[:, None])
    far = part[i, j]
    while d < dims:
        e = min(d + COLUMNS, dims)
        far = far + ((a[i, d:e] - b[j, d:e]) ** 2).sum(axis=1)
        keep = far * (dims / e) <= limit[i] * ((1 + EPSILON / math.sqrt(e)) ** 2 if e < dims else 1.0)
        i, j, far, d = i[keep], j[keep], far[keep], e
    score = cosine(q, x, i, j)
    order = np.lexsort((j, -score, i))
    order = order if owner is None else first_of(owner[j], order, i)
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], score[rank < k]


def cosine(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (i, j) in double precision on the vectors as they are."""
    out = np.zeros(len(i))
    nq, nx = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    for at in range(0, len(i), 65_536):
        s = slice(at, at + 65_536)
        with np.errstate(all="ignore"):
            out[s] = np.einsum("ij,ij->i", q[i[s]], x[j[s]]) / (nq[i[s]] * nx[j[s]])
        odd = ~np.isfinite(out[s])  # squares beyond the range of doubles
        if odd.any():
            out[s][odd] = np.einsum("ij,ij->i", _unit(q[i[s][odd]]), _unit(x[j[s][odd]]))
    return out


def search(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found, by cosine, of each row whose id is divisible by `every`.

    All rows are indexed; SAMPLE rows fit the lists. Vectors that are null, empty, zero or hold a null or non-finite component
    take no part, nor do rows without id; vectors are compared with those of their own length; equal rows count once; of an
    id with several vectors the best pair counts, as query and as candidate, and it is found once; other columns are ignored; with fewer than k candidates all are found; an empty table gives an empty result.
    """
    v = F.transform(F.col("v"), lambda x: x.cast("double"))
    used = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null").where(usable(F.col("v")))
    used = used.where(F.exists("v", lambda x: x != 0)).select("id", v.alias("v"))
    reps, members, odd = classes(used, k)
    asked = members.where(F.col("id") % every == 0)
    wanted = write_table(asked.select("rep").distinct().join(reps.select("rep", "v"), "rep"), "queries")
    found = None
    for (dims,) in reps.select(F.size("v")).distinct().collect():
        part = _search(reps.where(F.size("v") == dims), wanted.where(F.size("v") == dims), k, odd)
        found = part if found is None else found.union(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "rep long, hit long, score double")
    return best(found, asked, reps, k, odd)


def _search(reps: DataFrame, wanted: DataFrame, k: int, odd: bool) -> DataFrame:
    spark = reps.sparkSession
    rows, queries = reps.count(), wanted.count()
    sample = matrix(reps.where("main").select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow()["v"])
    model = spark.sparkContext.broadcast(fit(sample, rows, k + odd))  # at most SAMPLE + 1024 vectors
    lists, probes = len(model.value["centres"]), model.value["probes"]

    def assign(batches):
        m = model.value
        for b in batches:
            if b.num_rows:
                near = np.argmax(_unit(matrix(b["v"])) @ m["turn"] @ m["centres"].T, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), b["rep"], b["owner"], b["v"]], ["list", "rep", "owner", "v"])

    index = write_table(reps.select("rep", "owner", "v").mapInArrow(assign, "list int, rep long, owner long, v array<double>"), "lists")
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most LISTS rows
    blocks = [math.ceil(sizes.get(i, 0) / BLOCK) for i in range(lists)]
    shares = max(1, math.ceil(queries * probes / lists / SHARE))

    def probe(batches):
        m = model.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                q = _unit(matrix(c["v"])) @ m["turn"]
                picks = np.argsort(-(q @ m["centres"].T), axis=1, kind="stable")[:, :probes]
                probed = np.zeros((len(q), lists), dtype=bool)
                np.put_along_axis(probed, picks, True, axis=1)
                score = np.where(probed[:, m["near"]], q @ m["sample"].T, -np.inf)  # a bound that candidates of the probed lists keep
                score[score > 1 - 1e-12] = -np.inf  # the query itself may be in the sample
                kth = min(m["k"], score.shape[1]) - 1
                near = -np.partition(-score, kth, axis=1)[:, kth] if score.shape[1] > m["k"] else np.full(len(q), -1.0)
                bound = np.where(np.isfinite(near), 2 - 2 * near, 4.0) + 1e-9
                out = [(i, int(p), s) for i, row in enumerate(picks) for p in row for s in range(blocks[p])]
                if out:
                    i = pa.array([o[0] for o in out])
                    yield pa.RecordBatch.from_arrays([pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), c["rep"].take(i), c["v"].take(i), pa.array(bound).take(i)], ["list", "block", "rep", "v", "bound"])

    asks = wanted.select("rep", "v").mapInArrow(probe, "list int, block int, rep long, v array<double>, bound double")
    asks = asks.withColumn("share", F.pmod(F.xxhash64("rep"), F.lit(shares)).cast("int"))
    per = F.element_at(F.array(*map(F.lit, blocks)), F.col("list") + 1)
    dealt = index.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), per).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))

    def task(asked: pa.Table, held: pa.Table) -> pa.Table:
        m = model.value
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and held.num_rows:
            held = held.sort_by("owner")  # ties go to the smaller id
            x, names, who = matrix(held["v"]), held["rep"].to_numpy(), asked["rep"].to_numpy()
            q, bound = matrix(asked["v"]), asked["bound"].to_numpy()
            for at in range(0, len(q), QUERIES):
                i, j, score = scan(q[at : at + QUERIES], bound[at : at + QUERIES], x, m["turn"], k + 1, held["owner"].to_numpy() if odd else None)
                out.append((who[at + i], names[j], score))
        return pa.table({"rep": np.concatenate([o[0] for o in out]), "hit": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    keys = ("list", "block", "share")
    return asks.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(task, "rep long, hit long, score double")


def query(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))
