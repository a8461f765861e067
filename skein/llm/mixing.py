"""Mixing sources to target weights, with DataFrame operations only.

Each document gets a hash-random key. Within its source, documents are ranged by that key (two digits of the key give
the range, the whole key orders documents inside it), and prefix sums of token counts are computed in three levels: range totals
within a source, finer range totals within a range, and running sums inside a fine range. No window ever holds more than
`16 ** digits` totals or the documents of one fine range, so a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, drop_table, free, quoted, write_table


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """One row per source: sid, weight, target words.

    `totals` has (source, source_size). Sources are ordered by code point, null last, and take the weights in turn. They share
    the total of all sizes by weight; a target stops at max_repeats times its source's size and the excess is shared
    again among the rest. That fixed point is found in closed form: in the order of cap / weight, the saturated
    sources are a prefix, and the first unsaturated one gives the common level.
    """
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", "sid").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w)
    t = t.withColumn("cap", F.col("source_size") * max_repeats).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    t = t.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    t = t.withColumn("level", F.col("left").cast("double") / F.sum("weight").over(after))
    t = t.withColumn("full", F.col("ratio") <= F.col("level"))
    t = t.withColumn("at", F.max(F.when(~F.col("full"), F.struct(-F.col("ratio"), -F.col("sid"), F.col("level")))).over(everything)["level"])
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("at"))
    return t.select("source", "sid", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    digits: int = 2,
    seed: str = "",
) -> DataFrame:
    """(id_col, size, source_size, target, repeats, taken) for every row of docs.

    A source's whole documents are repeated floor(target / size of the source) times; the remaining budget is filled in
    key order, and the document that the budget falls into is taken if at least half of it fits.
    Defined cases: null text counts 0 words and takes 0; null source is a source of its own, the last; null ids hash as
    the empty string; equal rows get equal keys and are taken one after the other; an empty table gives an empty result; other
    columns are ignored. The same rows and seed give the same mix, whatever the partitioning.
    """
    rows, _ = _placed(docs, id_col, text_col, source_col, weights, max_repeats, digits, seed)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def take(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeats: int = 3,
    digits: int = 2,
    seed: str = "",
) -> DataFrame:
    """The rows of docs, with all their columns and whatever these are named, as often as the mix takes them.

    In key order the documents that fill up a source's budget are its first ones, so the last of them tells for every row whether it is taken: rows meet
    one row of their source and texts stay where they are. Rows that repeat an id and a size are taken alike. Cases are those of mix.
    """
    rows, done = _placed(docs, id_col, text_col, source_col, weights, max_repeats, digits, seed)
    size_, key_, of, whole, last, times = free(docs.columns, "size", "key", "of", "whole", "last", "times")
    cuts = rows.groupBy("sid").agg(F.max("whole").alias(whole), F.max(F.when(F.col("extra") == 1, F.struct("key", "id", "size"))).alias(last))
    cuts = write_table(done[1].select("sid", F.col("source").alias(of)).join(cuts, "sid").drop("sid"), "mix-cuts")
    drop_table(*done)
    out = docs.withColumns({size_: word_count(F.col(quoted(text_col))), key_: _key(id_col, seed)}).join(cuts, F.col(quoted(source_col)).eqNullSafe(F.col(of)))
    extra = F.coalesce(F.struct(F.col(key_).alias("key"), F.col(quoted(id_col)).alias("id"), F.col(size_).alias("size")) <= F.col(last), F.lit(False))
    repeats = F.when(F.col(size_) > 0, F.col(whole) + extra.cast("long")).otherwise(0)
    out = out.withColumn(times, repeats.cast("int")).where(F.col(times) > 0).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*map(quoted, docs.columns))


def _key(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit(""))))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], max_repeats: int, digits: int, seed: str) -> tuple[DataFrame, list[DataFrame]]:
    """The rows with their place in the mix, and written tables of which they are made, the plan of the sources last."""
    base = write_table(docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"), word_count(F.col(quoted(text_col))).alias("size"), _key(id_col, seed).alias("key")), "mix")
    plan = write_table(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeats), "mix-targets")
    rows = base.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(
        "id", "size", "key", "sid", "source_size", "target", F.substring("key", 1, digits).alias("hi"), F.substring("key", digits + 1, digits).alias("lo")
    )
    fine = rows.groupBy("sid", "hi", "lo").agg(F.sum("size").alias("n"))
    wide = rows.groupBy("sid", "hi").agg(F.sum("size").alias("n"))

    def earlier(by: tuple[str, ...], *order: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    wide = wide.select("sid", "hi", earlier(("sid",), "hi").alias("off_hi"))
    fine = fine.select("sid", "hi", "lo", earlier(("sid", "hi"), "lo").alias("off_lo")).join(wide, ["sid", "hi"])
    inner = Window.partitionBy("sid", "hi", "lo").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("off", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(fine, ["sid", "hi", "lo"])
    rows = rows.withColumn("before", F.col("off") + F.col("off_lo") + F.col("off_hi"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("whole", whole)
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    extra = ((F.col("size") > 0) & (2 * F.col("before") + F.col("size") <= 2 * rest)).cast("long")
    rows = rows.withColumn("extra", extra).withColumn("repeats", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(F.lit(0).cast("long")))
    return rows, [base, plan]


#: DuckDB's words of a text.
_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint"

ORACLE = f"""
with d as (select doc_id, source, {_SIZE} as size, md5(coalesce(doc_id::varchar, '')) as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, row_number() over (order by source nulls last) as sid from s),
v as (select *, case (sid - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, source_size * 3 as cap from w),
r as (select *, cap::double / weight as ratio, sum(source_size) over () as total from v),
l as (select *, (total - coalesce(sum(cap) over (order by ratio, sid rows between unbounded preceding and 1 preceding), 0))::double
        / (sum(weight) over (order by ratio, sid rows between current row and unbounded following))::double as level from r),
f as (select *, ratio <= level as is_full from l),
g as (select arg_min(level, struct_pack(a := ratio, b := sid)) as lev from f where not is_full),
t as (select source, source_size, case when is_full then cap::double else weight * (select lev from g) end as target from f),
p as (select doc_id, size, source_size, target,
        coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before,
        case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (case when size > 0 then (whole + case when 2 * before + size <= 2 * (target - whole * source_size) then 1 else 0 end) * size else 0 end)::bigint as taken
from p
"""


def query(spark, sf_dir):
    from .base import table

    return mix(table(spark, sf_dir, "documents")).drop("repeats")
