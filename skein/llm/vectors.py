"""What the two vector searches share: usable vectors, classes of equal vectors, and the k best of each query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import write_table


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def unused(rows: DataFrame, id_col: str) -> tuple[int, int]:
    """(start, step) of whole numbers, as many as a table may have rows, that no id of `rows` is."""
    low, high = rows.agg(F.min(id_col), F.max(id_col)).first()
    if low is None or low > -(1 << 62):
        return min(low or 0, 0) - 1, -1
    if high < 1 << 62:
        return high + 1, 1
    raise ValueError("ids take up the whole range of 64 bits")


def classes(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame, bool]:
    """(representatives, members, whether some id has several vectors) of rows (id long, v array<double>).

    Equal vectors have equal scores, so a search among the distinct ones is a search among all: representatives is (rep, owner, main, v, ids)
    with the k + 1 smallest ids of each class, which is as many as any query's result can take from it, its own left out;
    members is (id, rep) for every id. The k + 1 smallest are found before the shuffle, so a vector that a third of all rows share moves k + 1 rows a task.

    Repeated rows are one. An id with several vectors has a representative of its own for each, all with the id as owner and one of them `main`; for the others owner and rep are the same.
    """
    each = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("v").alias("w"))
    several = write_table(each.where("v <> w").select("id", F.col("v").alias("w")), "several-vectors")
    odd = not several.isEmpty()
    by = Window.partitionBy("v").orderBy("id")
    rows, plain = rows.select("id", "v"), each.where("v = w").select("id", "v")
    top = plain.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    reps = top.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))
    reps = reps.select("rep", F.col("rep").alias("owner"), F.lit(True).alias("main"), "v", "ids")
    if odd:
        start, step = unused(rows, "id")
        own = write_table(rows.join(several, "id").groupBy("id", "v").agg(F.first("w").alias("w")), "own-vectors")
        numbered = own.withColumn("rep", F.lit(start) + step * F.monotonically_increasing_id())
        reps = reps.union(numbered.select("rep", "id", F.col("v") == F.col("w"), "v", F.array("id")))
    reps = write_table(reps, "vectors")
    members = plain.join(reps.where("rep = owner").select("v", "rep"), "v").select("id", "rep")
    if odd:
        members = members.union(reps.where("rep <> owner").select("owner", "rep"))
    return reps, members, odd


def first_of(owner: np.ndarray, order: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """`order` with the first of each owner, in each group, alone."""
    keys = owner[order] if group is None else np.stack([group[order], owner[order]])
    return order[np.sort(np.unique(keys, axis=-1, return_index=True)[1])]


def best(found: DataFrame, members: DataFrame, reps: DataFrame, k: int, odd: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query, given (rep, hit, score) of representatives.

    `found` holds at least the best representatives of k + 1 owners for each query's own; each stands for the smallest ids of its class. A query
    never finds its id; equal scores go to the smaller id. With several vectors under one id the best pair counts, on either side.
    """
    order = Window.partitionBy("rep").orderBy(F.col("score").desc(), "vec_id")
    hits = found.join(reps.select(F.col("rep").alias("hit"), "ids"), "hit").select("rep", "score", F.explode("ids").alias("vec_id")).groupBy("rep", "vec_id").agg(F.max("score").alias("score"))
    hits = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    if odd:
        pairs = members.join(write_table(hits, "hits"), "rep").where("vec_id <> id").groupBy(F.col("id").alias("query_id"), "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    lists = write_table(hits.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))).alias("hits")), "hits")
    own = members.join(lists, "rep").select(F.col("id").alias("query_id"), F.expr(f"slice(filter(hits, h -> h.vec_id <> id), 1, {k})").alias("hits"))
    return own.select("query_id", F.posexplode("hits").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
