"""Near-duplicate documents by SuperMinHash, banding, verification on full sets, and union-find grouping.

SuperMinHash gives each shingle one random permutation of the slots: at step j a shingle offers j plus a fraction to the slot that
is j-th in its permutation. Ranks of one shingle thus differ between slots, which lowers the variance against independent
hashes, and a document is done once every slot holds less than the next step, after few steps for a long text.

Equal sets form one class and are compared once. A bucket of a band first compares its members with one of them, the
hub; what those links join needs no more comparing. Members of different components then make pairs, in small buckets directly and in large
ones through the rarest fifth of their shingles, of which two sets so similar share at least one: of the pairs that share a band, one in 10**7 at similarity 0.8 is lost by the sketch that
precedes the check, no other, and a bucket of many copies never makes all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop_table, release, small_batches, table, write_table
from .bpe import _slices
from .components import components
from .vectors import unused

SLOTS, ROWS = 128, 4
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_U = np.uint64
#: Words whose hashes a task keeps, about 35 MB.
KEPT = 200_000
#: Pairs across components that one bucket makes directly; beyond that its members meet by their rare shingles.
DIRECT = 500
#: Positions by which the frequencies of shingles are counted.
COUNTED = 1 << 20
#: A sketch has 4 bits of each of 128 slots, in columns of 16 slots; at similarity 0.8 slots differ in 24 places, and in more than 48 once in 10**7.
SKETCH, DIFFER = tuple(f"s{c}" for c in range(8)), 48


class _WordHashes(dict):
    """Word to 64-bit hash, computed once while it is kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@cache
def _hashes() -> _WordHashes:
    return _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash): the distinct word k-shingles of each text as 64-bit hashes, sorted by document and hash.

    A-Z count as a-z. A text of fewer than k words has its whole sequence as its one shingle; one without words has none.
    """
    known = _hashes()
    if len(known) > KEPT:
        known.clear()
    parts, lengths = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = (text or "").encode().translate(_LOWER).split()
        lengths[i] = len(words)
        parts.append(np.fromiter(map(known.__getitem__, words), dtype=_U, count=len(words)))
    h = np.concatenate([*parts, np.zeros(k, dtype=_U)])
    doc = np.repeat(np.arange(len(texts)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(doc))
    starts = ends - lengths[doc]
    size = np.minimum(lengths[doc], k)
    begins = np.flatnonzero((at + k <= ends) | ((at == starts) & (lengths[doc] < k)))
    s = _mix(size[begins].astype(_U))
    for j in range(k):
        use = j < size[begins]
        s = np.where(use, _mix(s * _U(0x9E3779B97F4A7C15) + h[begins + j]), s)
    doc = doc[begins]
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    first = np.ones(len(s), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
    return doc[first], s[first]


def signatures(doc: np.ndarray, s: np.ndarray, n: int, slots: int = SLOTS, block: int = 65_536) -> np.ndarray:
    """SuperMinHash of n sets given as (set, element hash): an (n, slots) array whose upper 32 bits are steps."""
    top = np.full((n, slots), np.iinfo(np.uint64).max, dtype=_U)
    flat = top.reshape(-1)
    for a in range(0, len(s), block):
        d, x = doc[a : a + block], s[a : a + block]
        perm = np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(x), slots)).copy()
        for j in range(slots):
            if j:
                open_ = (top.max(axis=1) >> _U(32)) >= _U(j)
                live = open_[d]
                if not live.any():
                    break
                if not live.all():
                    d, x, perm = d[live], x[live], perm[live]
            r = _mix(x + _U((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
            k = j + (((r & _U(0xFFFFFFFF)) * _U(slots - j)) >> _U(32)).astype(np.int64)
            rows = np.arange(len(x))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
            np.minimum.at(flat, d * slots + slot, (_U(j) << _U(32)) | (r >> _U(32)))
    return top


def _sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=_U)
    np.add.at(out, doc, values)
    return out


def _fingerprints(doc: np.ndarray, s: np.ndarray, n: int) -> list[np.ndarray]:
    """Two sums of 64 bits that tell the set of each document."""
    return [_sums(doc, _mix(s ^ _U(c)), n).view(np.int64) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)]


def sign(docs: DataFrame, *, shingle: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """(id, n, f1, f2, *SKETCH, keys): set size, 128-bit fingerprint of the set, a sketch of the slots, and one key a band (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "text"):
            count = b.num_rows
            doc, s = shingle_sets(b["text"].to_pylist(), shingle)
            n = np.bincount(doc, minlength=count)
            top = signatures(doc, s, count, slots)
            keys = np.zeros((count, slots // rows), dtype=_U) + _mix(np.arange(1, slots // rows + 1, dtype=_U))
            for j in range(rows):
                keys = _mix(keys * _U(0x9E3779B97F4A7C15) + top[:, j::rows])
            offsets = np.arange(count + 1, dtype=np.int32) * np.int32(slots // rows)
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=None), pa.array(keys.reshape(-1).view(np.int64)))
            lists = pa.array([None], lists.type).take(pa.array([0] * count)) if not n.any() else pc.if_else(pa.array(n > 0), lists, pa.scalar(None, lists.type))
            four = (_mix(top) & _U(15)).reshape(count, len(SKETCH), -1) << (_U(4) * np.arange(slots // len(SKETCH), dtype=_U))
            sketch = [pa.array(c) for c in np.bitwise_or.reduce(four, axis=2).view(np.int64).T]
            f1, f2 = _fingerprints(doc, s, count)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n.astype(np.int64)), pa.array(f1), pa.array(f2), *sketch, lists], ["id", "n", "f1", "f2", *SKETCH, "keys"])
        _hashes().clear()  # workers go on to other tasks
        release()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "id long, n long, f1 long, f2 long, " + " long, ".join(SKETCH) + " long, keys array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, *, shingle: int, id_col: str, text_col: str, told: bool = False) -> DataFrame:
    """(id, shingles) for the documents whose id is in ids, with f1 and f2 where `told`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "text"):
            doc, s = shingle_sets(b["text"].to_pylist(), shingle)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))]).astype(np.int32)
            marks = [pa.array(f) for f in _fingerprints(doc, s, b.num_rows)] if told else []
            yield pa.RecordBatch.from_arrays([b["id"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.view(np.int64))), *marks], ["id", "shingles", *("f1", "f2")[: len(marks)]])
        _hashes().clear()
        release()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.join(ids, "id", "left_semi").mapInArrow(run, "id long, shingles array<long>" + ", f1 long, f2 long" * told)


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(rep, rarer, shingle) of sets (id, shingles): the first shingles of each set, as many as one of them must be shared by sets so similar, with their places.

    The order is one for all sets: by how often the shingle's position of COUNTED occurs among the sets, then by the shingle. Counts steer only how
    many pairs meet; a position that occurs once holds a shingle that no other set has, which is left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = np.unique(b["shingles"].flatten().to_numpy(zero_copy_only=False).view(_U) % _U(COUNTED), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64))], ["at", "n"])

    got = sets.select("shingles").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # COUNTED rows at most
    counts = np.zeros(COUNTED, dtype=np.int32)
    counts[got["at"].to_numpy()] = np.minimum(got["n"].to_numpy(), 2**31 - 1)
    shared = sets.sparkSession.sparkContext.broadcast(counts)  # 4 * COUNTED bytes

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep, place, shingle = [], [], []
            for i, x in zip(b["id"].to_pylist(), b["shingles"], strict=True):
                s = x.values.to_numpy(zero_copy_only=False)
                k = shared.value[s.view(_U) % _U(COUNTED)]
                order = np.lexsort((s, k))[: len(s) - (percent * len(s) + 99) // 100 + 1]
                at = np.flatnonzero(k[order] > 1)
                rep.append(np.full(len(at), i, dtype=np.int64))
                place.append(at.astype(np.int32))
                shingle.append(s[order[at]])
            if rep:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (rep, place, shingle)], ["rep", "rarer", "shingle"])

    return sets.mapInArrow(first, "rep long, rarer int, shingle long")


def _classes(slim: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((f1, f2, n, lead, rep), links (u, v) of representatives or None): the distinct sets of slim (id, n, f1, f2), with the least id that has them.

    Where every id has one set, the least id represents it. Else each set is represented by a number of its own that is no id, and the sets of one id are linked.
    """
    own = slim.where("n > 0 and id is not null")
    several = own.groupBy("id").agg(*(f(c).alias(f"{k}{c}") for c in ("f1", "f2", "n") for k, f in (("a", F.min), ("b", F.max)))).where("af1 <> bf1 or af2 <> bf2 or an <> bn").select("id")
    several = write_table(several, "several-sets")
    classes = own.groupBy("f1", "f2", "n").agg(F.min("id").alias("lead"))
    if several.isEmpty():
        drop_table(several)
        return write_table(classes.withColumn("rep", F.col("lead")), "classes"), None
    numbers = write_table(classes, "sets-of-ids")
    start, step = unused(own, "id")
    classes = write_table(numbers.withColumn("rep", F.lit(start) + step * F.monotonically_increasing_id()), "classes")
    both = write_table(own.join(several, "id", "left_semi").join(classes, ["f1", "f2", "n"]).select("id", "rep").distinct(), "sets-by-id")
    tied = write_table(both.join(both.groupBy("id").agg(F.min("rep").alias("v")), "id").where("rep <> v").select(F.col("rep").alias("u"), "v"), "tied")
    drop_table(several, numbers, both)
    return classes, tied


def near_duplicates(
    docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, rows: int = ROWS
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row: links where 100 * intersection >= percent * union of the shingle sets.

    With 32 bands of 4 slots a pair at similarity 0.8 shares no band once in 2 * 10**7; every pair that shares one is
    decided on its full sets, unless links already join the two. Sets are held as 64-bit hashes of shingles.
    Defined cases: null and empty texts have no shingles and link with nothing; ids name documents: rows with one id are one document, which all
    its texts link, also where they differ, and each row tells the size of its own set; a row without id links with nothing and is kept; an empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    signed = write_table(sign(docs, shingle=shingle, id_col=id_col, text_col=text_col, slots=slots, rows=rows), "signed")
    own = signed.where("n > 0 and id is not null")
    slim = write_table(signed.select("id", "n", "f1", "f2"), "fingerprints")
    classes, tied = _classes(slim)
    reps = write_table(own.join(classes, ["f1", "f2", "n"]).where("id = lead").select("rep", "n", *SKETCH, "keys").dropDuplicates(["rep"]), "reps")
    drop_table(signed)
    # sizes and sketches stay with the representatives: 32 keys of each are shuffled here, and few share a bucket
    bands = reps.select("rep", F.explode("keys").alias("key"))
    shared = write_table(bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", "hub"), "buckets")
    members = write_table(bands.join(shared, "key").select("key", "rep", "hub"), "members")
    drop_table(shared)

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, shingles) of the representatives in ids (id)."""
        if tied is None:  # an id tells its text
            return full_sets(docs, ids, shingle=shingle, id_col=id_col, text_col=text_col).dropDuplicates(["id"])
        wanted = classes.join(ids.select(F.col("id").alias("rep")), "rep", "left_semi")
        found = full_sets(docs, wanted.select(F.col("lead").alias("id")).distinct(), shingle=shingle, id_col=id_col, text_col=text_col, told=True)
        found = found.withColumn("n", F.size("shingles").cast("long")).join(wanted.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"])
        return found.select(F.col("rep").alias("id"), "shingles").dropDuplicates(["id"])

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that are similar enough."""
        ids = write_table(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), "pair-ids")
        sets = write_table(sets_of(ids), "sets")
        with_u = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
        both = with_u.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
        both = both.withColumn("common", F.size(F.array_intersect("a", "b")))
        found = write_table(both.where(100 * F.col("common") >= percent * (F.size("a") + F.size("b") - F.col("common"))).select("u", "v"), "similar")
        drop_table(ids, sets)
        return found

    hubs = write_table(members.where("rep <> hub").select(F.col("rep").alias("u"), F.col("hub").alias("v")).distinct(), "hub-pairs")
    found = links(hubs)
    found = found if tied is None else found.union(tied)
    comp = write_table(components(found), "components")
    at = members.join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("hub", "component")
    at = write_table(at, "placed")
    drop_table(members, comp)
    per = at.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"))
    mixed = write_table(per.where("all * all > same").select("key", (F.col("all") * F.col("all") - F.col("same") <= 2 * DIRECT).alias("direct")), "mixed")
    unsettled = write_table(at.join(mixed, "key").join(reps.select("rep", "n", *SKETCH), "rep"), "unsettled")
    drop_table(at, mixed, reps)
    differ = [f"(({c} ^ t{c}) | shiftrightunsigned({c} ^ t{c}, 1))" for c in SKETCH]  # bits 0 and 2 of 4: whether two of them differ
    differ = " + ".join(f"bit_count(({d} | shiftrightunsigned({d}, 2)) & 1229782938247303441)" for d in differ)  # 0x1111...
    alike = f"u > v and cu <> cv and 100 * least(n, m) >= {percent} * greatest(n, m) and {100 + percent} * least(n - rarer, m - rarer_too) >= {percent} * (n + m) and {differ} <= {DIFFER}"

    def across(rows: DataFrame, on: str) -> DataFrame:
        """Pairs that share `on`; where it is the first they share, none of the `rarer` shingles is common."""
        here = rows.select(on, F.col("rep").alias("u"), "n", "rarer", *SKETCH, F.col("c").alias("cu"))
        there = rows.select(on, F.col("rep").alias("v"), F.col("n").alias("m"), F.col("rarer").alias("rarer_too"), *(F.col(c).alias(f"t{c}") for c in SKETCH), F.col("c").alias("cv"))
        return here.join(there, on).where(alike).select("u", "v")

    # sets this similar share one of their 20 % rarest shingles, whatever the order of shingles is, if only it is one for all sets
    crowd = write_table(unsettled.where("not direct").select("rep", "n", *SKETCH, "c").distinct(), "crowd")
    told = write_table(sets_of(crowd.select(F.col("rep").alias("id"))), "crowd-sets")
    rare = rare_shingles(told, percent)
    rare = write_table(rare.join(crowd, "rep"), "rare")
    drop_table(told, crowd)
    fresh = across(unsettled.where("direct").withColumn("rarer", F.lit(0)), "key").union(across(rare, "shingle")).distinct().join(hubs, ["u", "v"], "left_anti")
    fresh = write_table(fresh, "fresh")
    more = links(fresh)
    drop_table(unsettled, rare, fresh)
    comp = write_table(components(found.union(more)), "components")
    placed = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("f1", "f2", "n", "lead", F.coalesce("component", "rep").alias("component_id"))
    if tied is not None:  # representatives aren't ids
        placed = write_table(placed, "unnamed")
        names = placed.groupBy("component_id").agg(F.min("lead").alias("named"))
        placed = placed.join(names, "component_id").withColumn("component_id", F.col("named"))
    placed = write_table(placed.select("f1", "f2", "n", "component_id"), "placed")
    drop_table(hubs, found, more, classes, comp, tied)
    out = slim.join(placed, ["f1", "f2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    )


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
