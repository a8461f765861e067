"""Valid-time enrichment: facts take the version of their key that held when they happened, in a stateful Structured Streaming query.

The state is keyed by hash bucket, not by entity: a bucket holds the versions of all its keys as sorted columns and the facts that wait. Each batch
brings every bucket one tick with the batch's watermarks, so a bucket is called once a batch, also where it has no rows, and works on whole columns:
facts are resolved by searchsorted over ranks composed of key and time. A key with many rows is cut into slices of time,
each with a place in the buckets of its own; what a slice can't know of the earlier and later ones (which version came last before it, and which
survivors of pruning a later survivor outlived) is told by one summary row a slice and batch, joined after the stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from .base import _file_system, drop_table, free, quoted, shared_dir, table, write_table

#: Rows of the stream: a batch's tick, a version, a fact.
TICK, VERSION, FACT = 0, 1, 2
#: Bits of `flags`: which of id, seq, key and at are there; the key is cut into slices; the tick is the last.
ID, SEQ, KEY, AT, SLICED, LAST = 1, 2, 8, 16, 32, 64
FEED = "kind int, bucket long, id long, key long, part int, at long, seq long, flags int, payload string, batch int"
#: rec is `fact`, `late`, or `slice` for a summary. `old`: the version that the last pruning left. n: versions of the key, or of the slice.
FOUND = "rec string, id long, batch long, key long, part int, sliced boolean, timed boolean, n long, olds long, old boolean, hit boolean, version_id long, payload string"
#: A start runs one batch, so a store is closed after it and leaves no files; logs aren't preallocated, and a commit writes what changed.
STORE = {
    "stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "stateStore.unloadOnCommit": "true",
    "stateStore.rocksdb.allowFAllocate": "false",
    "stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "minBatchesToRetain": "2",
}
_COLUMNS = {"id": pa.int64(), "key": pa.int64(), "part": pa.int32(), "at": pa.int64(), "seq": pa.int64(), "flags": pa.int32(), "payload": pa.string()}


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp as its clock shows it, in no zone."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    return F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000 + clock.cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


class Bucket(StatefulProcessor):
    """The versions and waiting facts of one bucket."""

    def init(self, handle) -> None:
        self._held = handle.getValueState("held", "versions binary, waiting binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        tick = new[new["kind"] == TICK].iloc[0]
        flags, batch = int(tick["flags"]), int(tick["batch"])
        pruned, below, until = (int(tick[c]) if flags & bit else None for c, bit in (("id", ID), ("seq", SEQ), ("at", AT)))
        held = self._held.get()
        versions, waiting = (_read(b) for b in held) if held else (_read(None), _read(None))
        versions["old"] = versions["at"] <= pruned if pruned is not None else False
        come, facts = new[new["kind"] == VERSION], pd.concat([waiting, new.loc[new["kind"] == FACT, list(_COLUMNS)]], ignore_index=True)
        late = come["at"] < below if below is not None else np.zeros(len(come), bool)
        yield _frame(len(come[late]), rec="late", id=(come["id"][late], come["flags"][late] & ID), batch=batch)
        come = come.loc[~late & ((come["flags"] & KEY) > 0), list(_COLUMNS)].assign(old=False)
        versions = _sorted(pd.concat([versions, come], ignore_index=True))
        due = (facts["flags"] & AT) == 0
        if until is not None:
            due |= facts["at"] < until
        yield from _resolve(facts[due], versions, batch)
        facts = facts[~due]
        if until is not None:
            done = (versions["at"] <= until).to_numpy()
            following = np.append(done[1:] & _same(versions), False)  # what comes later for the same key is done too
            versions = versions[~(done & following)]
        if flags & LAST:
            versions = versions.assign(old=(versions["at"] <= until) if until is not None else False)
            yield from _resolve(facts, versions, batch + 1)
            facts = facts[:0]
        self._held.update((_written(versions), _written(facts)))

    def close(self) -> None:
        pass


def _same(v: pd.DataFrame) -> np.ndarray:
    """Whether each row but the first has the key and slice of the one before."""
    k, p = v["key"].to_numpy(), v["part"].to_numpy()
    return (k[1:] == k[:-1]) & (p[1:] == p[:-1])


def _sorted(v: pd.DataFrame) -> pd.DataFrame:
    """By key, slice, time, sequence and id; nulls first."""
    f = v["flags"].to_numpy()
    order = np.lexsort((v["id"], f & ID, v["seq"], f & SEQ, v["at"], v["part"], v["key"]))
    return v.iloc[order].reset_index(drop=True)


def _read(data: bytes | None) -> pd.DataFrame:
    if not data:
        return pd.DataFrame({c: pd.Series(dtype=object if pa.types.is_string(t) else t.to_pandas_dtype()) for c, t in _COLUMNS.items()})
    return pa.ipc.open_stream(data).read_all().to_pandas()


def _written(v: pd.DataFrame) -> bytes:
    if not len(v):
        return b""
    out, sink = pa.table({c: pa.array(v[c], t) for c, t in _COLUMNS.items()}), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(out)
    return sink.getvalue().to_pybytes()


def _frame(size: int, **values) -> pd.DataFrame:
    """`size` rows of FOUND; a pair is (values, which are there)."""
    out = {}
    for name, kind in (f.split(" ") for f in FOUND.split(", ")):
        x = values.get(name)
        there = np.full(size, x is not None)
        if isinstance(x, tuple):
            x, there = np.asarray(x[0]), np.asarray(x[1]).astype(bool)
        if kind in ("long", "int"):
            out[name] = pd.arrays.IntegerArray(np.broadcast_to(np.asarray(0 if x is None else x, dtype=np.int64), size).copy(), ~there)
        elif kind == "boolean":
            out[name] = np.broadcast_to(np.asarray(bool(x) if x is None else x, dtype=bool), size)
        else:
            out[name] = np.where(there, np.broadcast_to(np.asarray(x, dtype=object), size), None)
    return pd.DataFrame(out, columns=list(out))


def _resolve(facts: pd.DataFrame, v: pd.DataFrame, batch: int) -> Iterator[pd.DataFrame]:
    """The facts with the last version of their key and slice at their time, and a summary of each slice of a key that is cut into slices."""
    at, part, flags = v["at"].to_numpy(), v["part"].to_numpy(np.int64), v["flags"].to_numpy()
    keys, times = np.unique(v["key"].to_numpy()), np.unique(at)
    parts = np.unique(np.concatenate([part, facts["part"].to_numpy(np.int64)]))
    group = np.searchsorted(keys, v["key"].to_numpy()) * len(parts) + np.searchsorted(parts, part)
    rank = group * (len(times) + 1) + np.searchsorted(times, at, side="right")
    want, known = facts["key"].to_numpy(), (facts["flags"].to_numpy() & KEY) > 0
    place = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
    known = known & (keys[place] == want) if len(keys) else np.zeros(len(facts), bool)
    own = place * len(parts) + np.searchsorted(parts, facts["part"].to_numpy(np.int64))
    first, end = np.searchsorted(group, own), np.searchsorted(group, own, side="right")
    upto = np.searchsorted(rank, own * (len(times) + 1) + np.searchsorted(times, facts["at"].to_numpy(), side="right"), side="right") - 1
    hit = known & ((facts["flags"].to_numpy() & AT) > 0) & (upto >= first) if len(v) else np.zeros(len(facts), bool)
    upto = np.where(hit, upto, 0)
    take = (lambda c: v[c].to_numpy()[upto]) if len(v) else (lambda c: np.zeros(len(facts), object if c == "payload" else np.int64))
    f = facts["flags"].to_numpy()
    yield _frame(
        len(facts), rec="fact", id=(facts["id"], f & ID), batch=batch, key=(want, f & KEY), part=facts["part"], sliced=(f & SLICED) > 0, timed=(f & AT) > 0, n=np.where(known, end - first, 0),
        old=hit & take("old").astype(bool), hit=hit, version_id=(take("id"), hit & ((take("flags") & ID) > 0)), payload=(take("payload"), hit),
    )
    cut = (flags & SLICED) > 0
    starts = np.flatnonzero(np.append(True, ~_same(v)) & cut) if len(v) else np.zeros(0, int)
    if len(starts):
        ends = np.searchsorted(group, group[starts], side="right")
        old = np.append(0, np.cumsum(v["old"].to_numpy().astype(int)))
        last = v.iloc[ends - 1]
        yield _frame(
            len(starts), rec="slice", batch=batch, key=last["key"], part=last["part"], n=ends - starts, olds=old[ends] - old[starts], old=last["old"], hit=np.ones(len(starts), bool),
            version_id=(last["id"], last["flags"] & ID), payload=last["payload"],
        )


#: Slots of the filter that tells rows of keys with many rows before they are counted by grain; a bit each.
SLOTS = 1 << 13


def _cut(feed: DataFrame, most: int) -> DataFrame:
    """(key, grain_no, part) of the keys with more than `most` rows, their time cut into parts of about that many.

    A key's window holds a row for each grain of its time, whatever its rows. A row without time is dealt to one of 64 grains before all times.
    """
    slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS)).cast("int")
    busy = write_table(feed.where("key is not null").groupBy("key").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > most).select("key"), "busy-keys")
    marks = [0] * (SLOTS // 32)
    for (x,) in busy.select(slot).distinct().collect():  # SLOTS at most
        marks[x // 32] |= 1 << x % 32
    words = F.array(*(F.lit(m).cast("long") for m in marks))
    told = feed.where("key is not null").withColumn("slot", slot).withColumn("word", F.get(words, F.floor(F.col("slot") / 32).cast("int")))
    grains = told.where(F.col("word").bitwiseAND(F.expr("shiftleft(1L, slot % 32)")) != 0).groupBy("key", "grain_no").agg(F.count("*").alias("n_rows")).join(busy.hint("merge"), "key", "left_semi")
    before = F.sum("n_rows").over(Window.partitionBy("key").orderBy("grain_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_rows")
    parts = write_table(grains.select("key", "grain_no", F.floor(before / most).cast("int").alias("part")), "slices")
    drop_table(busy)
    return parts


def enrich(
    facts: DataFrame, versions: DataFrame, *, id_col: str, key_col: str, at_col: str, version_id: str, version_key: str, valid_col: str, seq_col: str, payload: dict[str, Column],
    fact_batch: Column, version_batch: Column, batches: int = 8, delay_s: int = 12 * 3600, most: int = 20_000, grain_s: int = 60,
) -> DataFrame:
    """(rec, id, batch, n_held, version_id, payload...) for each fact and each late version, from a streaming query that is started anew for each batch on one checkpoint.

    `fact_batch` and `version_batch` give the batch numbers; a table's watermark is its largest time of earlier batches less `delay_s`, and the horizon the smaller of both. In
    each batch versions below their watermark are late; facts without time or before the horizon are emitted, the rest wait; then of each key's versions up to the horizon all
    but the last (by time, sequence, id, nulls first) are pruned. A fact takes the last version of its key, not pruned, that was valid at its time. What waits at the end is emitted as batch
    number `batches`. `rec` is `fact` or `late`; `payload` maps the names of columns of the versions that facts take to expressions.

    A key with more than `most` rows is cut into slices of about as many, at grains of `grain_s` seconds. No watermark, count or cut but what is bounded by
    `batches` reaches the driver, and nothing is broadcast: all joins are hinted to sort and merge. Batches are written once, below spark.checkpoint.dir, and moved into the folder that the stream reads one at a time.
    Defined cases: batch numbers below 0 count as 0, null ones and those beyond the last as the last. Versions without time are ignored; those without key can be late, but no fact takes them. Facts
    without key or time take nothing; repeated rows of either table each count (drop repeats before); a null sequence or id orders first; empty tables and batches give
    what the rest gives; other columns are ignored, whatever their names.
    """
    spark = facts.sparkSession
    number = lambda b: F.least(F.greatest(F.coalesce(b, F.lit(batches - 1)), F.lit(0)), F.lit(batches - 1)).cast("int")
    col = lambda c: F.col(quoted(c))
    none = lambda t: F.lit(None).cast(t)
    rows = versions.select(F.lit(VERSION).alias("kind"), col(version_id).cast("long").alias("id"), col(version_key).cast("long").alias("key"), micros(col(valid_col)).alias("at"), col(seq_col).cast("long").alias("seq"), F.to_json(F.struct(*(c.alias(n) for n, c in payload.items()))).alias("payload"), number(version_batch).alias("batch"))
    rows = rows.where("at is not null")
    rows = rows.union(facts.select(F.lit(FACT), col(id_col).cast("long"), col(key_col).cast("long"), micros(col(at_col)), none("long"), none("string"), number(fact_batch)))
    rows = rows.withColumn("grain_no", F.coalesce(F.floor(F.col("at") / (grain_s * 1_000_000)), -F.lit(1 << 60) + F.pmod(F.xxhash64("id"), F.lit(64))))
    rows = write_table(rows, "valid-time-rows")
    largest = {(r["kind"], r["batch"]): (r["top"], r["n_rows"]) for r in rows.groupBy("kind", "batch").agg(F.max("at").alias("top"), F.count("*").alias("n_rows")).collect()}
    ticks, seen, before = [], {VERSION: None, FACT: None}, None
    for b in range(batches):
        below = {k: None if t is None else t - delay_s * 1_000_000 for k, t in seen.items()}
        until = None if None in below.values() else min(below.values())
        ticks.append((before, below[VERSION], until))
        before = until
        seen = {k: max([x for x in (t, largest.get((k, b), (None, 0))[0]) if x is not None], default=None) for k, t in seen.items()}
    cuts = _cut(rows, most)
    sliced = not cuts.isEmpty()
    dealt = rows.join(cuts.hint("merge"), ["key", "grain_no"], "left")
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(n for _, n in largest.values()) // most))
    flags = sum((F.when(F.col(c).isNotNull(), bit).otherwise(0) for c, bit in (("id", ID), ("seq", SEQ), ("key", KEY), ("at", AT), ("part", SLICED))), F.lit(0))
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    # facts without key go anywhere
    home = F.when(F.col("key").isNull(), F.xxhash64("id", F.lit(7))).otherwise(F.xxhash64("key", F.coalesce("part", F.lit(0))))
    feed = dealt.select("kind", F.pmod(home, F.lit(buckets)).alias("bucket"), zero("id", "long"), zero("key", "long"), zero("part", "int"), zero("at", "long"), zero("seq", "long"), flags.alias("flags"), "payload", "batch")
    at = lambda i: F.element_at(F.array(*(F.lit(t[i]).cast("long") for t in ticks)), F.col("batch") + 1)
    tick = spark.range(buckets * batches).select((F.col("id") % batches).cast("int").alias("batch"), F.floor(F.col("id") / batches).alias("bucket"))
    tick = tick.select("batch", "bucket", at(0).alias("p"), at(1).alias("c"), at(2).alias("h"))
    bits = F.when(F.col("p").isNotNull(), ID).otherwise(0) + F.when(F.col("c").isNotNull(), SEQ).otherwise(0) + F.when(F.col("h").isNotNull(), AT).otherwise(0) + F.when(F.col("batch") == batches - 1, LAST).otherwise(0)
    feed = feed.unionByName(tick.select(F.lit(TICK).alias("kind"), "bucket", zero("p", "long").alias("id"), F.lit(0).cast("long").alias("key"), F.lit(0).alias("part"), zero("h", "long").alias("at"), zero("c", "long").alias("seq"), bits.alias("flags"), none("string").alias("payload"), "batch"))
    found = _stream(spark, feed, batches, (rows, cuts))
    fields = StructType([f for f in versions.select(*(c.alias(n) for n, c in payload.items())).schema])
    own = free(["rec", "id", "batch", "n_held", "version_id", *payload], "taken")[0]
    whole = found.where("rec <> 'slice' and not sliced")
    if sliced:
        whole = whole.select("rec", "id", "batch", "n", "version_id", "payload").union(_joined(found))
    out = whole.select("rec", "id", "batch", F.when(F.col("rec") == "fact", F.col("n")).alias("n_held"), "version_id", F.from_json("payload", fields).alias(own))
    return out.select("rec", "id", "batch", "n_held", "version_id", *(F.col(own)[n].alias(n) for n in payload))


def _joined(found: DataFrame) -> DataFrame:
    """The facts of keys that are cut into slices, with the last version before their slice where it has none for them, and all versions of their key.

    Each slice keeps one survivor of pruning; only the one of the latest slice lives, the others don't count. A slice without a version has no summary, and a
    fact there looks at the latest summary before it: both are ordered by slice in one window of a key and batch, in which facts of one slice are one row.
    """
    facts = found.where("rec = 'fact' and sliced")
    slices = found.where("rec = 'slice'").select("key", "batch", "part", "n", "olds", "old", F.struct("version_id", "payload").alias("last"))
    spots = facts.select("key", "batch", "part").distinct()
    whole = Window.partitionBy("key", "batch")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    seen = spots.join(slices.hint("merge"), ["key", "batch", "part"], "full")
    seen = seen.withColumn("latest", F.max(F.when(F.col("olds") > 0, F.col("part"))).over(whole))
    seen = seen.withColumn("held", F.coalesce(F.sum("n").over(whole), F.lit(0)) - F.greatest(F.coalesce(F.sum("olds").over(whole), F.lit(0)) - 1, F.lit(0)))
    lives = F.col("last").isNotNull() & ~(F.col("old") & (F.col("part") < F.col("latest")))
    seen = seen.withColumn("earlier", F.last(F.when(lives, F.col("last")), True).over(before)).select("key", "batch", "part", "latest", "held", "earlier")
    both = facts.join(seen.hint("merge"), ["key", "batch", "part"])
    here = F.col("hit") & ~(F.col("old") & (F.col("part") < F.coalesce("latest", F.lit(-1))))
    return both.select("rec", "id", "batch", F.col("held").alias("n"), F.when(here, F.col("version_id")).otherwise(F.when(F.col("timed"), F.col("earlier.version_id"))).alias("version_id"), F.when(here, F.col("payload")).otherwise(F.when(F.col("timed"), F.col("earlier.payload"))).alias("payload"))


def _stream(spark: SparkSession, feed: DataFrame, batches: int, used: tuple[DataFrame, ...]) -> DataFrame:
    """FOUND of the feed, which is written, so that the tables it was made of can go: each batch's files are moved into the folder that the query reads, and the query is started once more."""
    own = f"{shared_dir(spark)}/skein/{spark.sparkContext.applicationId}/valid-time-{uuid.uuid4().hex}"
    feed.write.partitionBy("batch").parquet(f"{own}/staged")
    drop_table(*used)
    files, target = _file_system(spark, own)
    files.deleteOnExit(target)
    path = lambda *at: _file_system(spark, "/".join((own, *at)))[1]
    files.mkdirs(path("feed"))
    conf = {f"spark.sql.streaming.{k}": v for k, v in STORE.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for b in range(batches):
            if not files.rename(path("staged", f"batch={b}"), path("feed", f"batch={b}")):
                raise OSError(f"batch {b} could not be moved below {own}/feed")
            rows = spark.readStream.schema(FEED).parquet(f"{own}/feed").groupBy("bucket")
            out = rows.transformWithStateInPandas(Bucket(), FOUND, "Append", "None")
            run = out.writeStream.format("parquet").option("path", f"{own}/found").option("checkpointLocation", f"{own}/state").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for name in ("staged", "feed", "state"):
        files.delete(path(name), True)
    return spark.read.schema(FOUND).parquet(f"{own}/found")


def batch_of(day: Column, batches: int = 8, first: int = 19_723, days: int = 152) -> Column:
    return F.least(F.lit(batches - 1), F.floor((day - first) * batches / F.lit(days)))


#: The same rows without a stream: a version is pruned once it and a later one of its client are there and not beyond the horizon.
ORACLE = """
with steps as (select n, list_reduce(list_prepend(n, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as t from range(256) r(n)),
crc as (select list(t order by n) as t from steps),
batches as (select b from range(8) r(b)),
c as (select change_id, client_id, seq, op, valid_at, cast(floor(100 * balance + 0.5) as bigint) as cents,
    least(7, floor((date_diff('day', date '1970-01-01', cast(valid_at as date)) + xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(change_id as varchar), ''), lambda d: cast(ascii(d) as bigint))), lambda x, y: xor(t[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) % 4 - 19723) * 8 / 152)) as a
    from (select distinct * from client_changes) cross join crc where valid_at is not null),
s as (select sale_id, client_id, sold_at, least(7, floor((date_diff('day', date '1970-01-01', cast(arrived_at as date)) - 19723) * 8 / 152)) as a from sales),
w as (select b, (select max(sold_at) from s where a < b) - interval 12 hour as ws, (select max(valid_at) from c where a < b) - interval 12 hour as wc from batches),
h as (select b, wc, case when ws is not null and wc is not null then least(ws, wc) end as h from w),
late as (select c.* from c join h on b = a where valid_at < wc),
v as (select c.*, (select min(b) from h where b >= a and valid_at <= h.h) as ready from c join h on b = a where not coalesce(valid_at < wc, false)),
p as (select *, greatest(ready, min(ready) over (partition by client_id order by valid_at, seq nulls first, change_id rows between 1 following and unbounded following)) as later, min(ready) over (partition by client_id order by valid_at, seq nulls first, change_id rows between 1 following and unbounded following) as nxt from v where client_id is not null),
live as (select client_id, change_id, seq, op, valid_at, cents, a, case when ready is not null and nxt is not null then later else 99 end as gone from p),
e as (select s.*, coalesce((select min(b) from h where b >= a and (sold_at is null or sold_at < h.h)), 8) as at from s),
n as (select e.sale_id, e.at, e.sold_at, l.*, row_number() over (partition by e.sale_id order by coalesce(l.valid_at <= e.sold_at, false) desc, l.valid_at desc, l.seq desc nulls last, l.change_id desc) as r, count(*) over (partition by e.sale_id) as n_held
    from e join live l on l.client_id = e.client_id and l.a <= e.at and l.gone >= e.at)
select 'sale' as rec, e.sale_id as id, cast(e.at as bigint) as batch, coalesce(n.n_held, 0) as n_held, case when n.valid_at <= n.sold_at then n.change_id end as change_id,
    case when n.valid_at <= n.sold_at then n.cents end as balance_cents, case when n.valid_at <= n.sold_at then n.op end as op
from e left join n on n.sale_id = e.sale_id and n.r = 1
union all select 'late', change_id, cast(a as bigint), null, null, null, null from late
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, changes = table(spark, sf_dir, "sales"), table(spark, sf_dir, "client_changes").distinct()
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    out = enrich(
        sales, changes, id_col="sale_id", key_col="client_id", at_col="sold_at", version_id="change_id", version_key="client_id", valid_col="valid_at", seq_col="seq",
        payload={"balance_cents": F.floor(100 * F.col("balance") + 0.5), "op": F.col("op")},
        fact_batch=batch_of(day("arrived_at")), version_batch=batch_of(day("valid_at") + F.crc32(F.col("change_id").cast("string")) % 4),
    )
    return out.select(F.when(F.col("rec") == "fact", "sale").otherwise("late").alias("rec"), "id", "batch", "n_held", F.col("version_id").alias("change_id"), "balance_cents", "op")
