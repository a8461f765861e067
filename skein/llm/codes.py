"""Product codes of vectors, whose codebook entries are found by annular norm pruning.

A vector is cut into parts; each part position has a codebook. The entries of a codebook are sorted by norm: an entry can be no nearer to a part
than their norms differ, so once some entry is known, all that are as near lie in an annulus, an interval of the sorted norms that two binary searches find. Only
entries in it are evaluated, exactly and in integers; its ends belong to it, so that ties are seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import drop_table, lookup, quoted, table, write_table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries beside a part's own place in the order of norms that are evaluated first, and pairs that are evaluated at a time (about 50 MB).
NEAR, PAIRS = 4, 200_000
#: Components up to this keep squared distances and an entry's number in 64 bits for parts of up to 16 components; beyond, Python's integers are used.
SMALL = 1 << 23
_MOST = (1 << 63) - 1


class Codebook:
    """The entries of one part position."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        norms = np.sqrt((entries.astype(float) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], entries[self.order]

    def _best(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, at: list[np.ndarray]) -> None:
        """Set at = [distance, entry] of each row of x where an entry in places low to high (exclusive) is nearer, or as near with a lower number."""
        sizes = np.maximum(high - low, 0)
        begin = 0
        while begin < len(x):
            end = max(begin + 1, int(np.searchsorted(np.cumsum(sizes[begin:]), PAIRS, side="right")) + begin)
            who = np.flatnonzero(sizes[begin:end]) + begin
            begin = end
            if not len(who):
                continue
            n = sizes[who]
            starts = np.cumsum(n) - n
            place = np.arange(n.sum()) - np.repeat(starts, n) + np.repeat(low[who], n)
            gap = np.repeat(x[who], n, axis=0) - self.sorted[place]
            key = (gap * gap).sum(axis=1) * len(self.entries) + self.order[place]
            key = np.minimum.reduceat(key, starts)
            d, e = key // len(self.entries), key % len(self.entries)
            nearer = (d < at[0][who]) | ((d == at[0][who]) & (e < at[1][who]))
            at[0][who[nearer]], at[1][who[nearer]] = d[nearer], e[nearer]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry of each row of integers; ties go to the lower number."""
        big = x.dtype == object or max(np.abs(x).max(initial=0), np.abs(self.entries).max(initial=0)) > SMALL or x.shape[1] > 16
        if big:
            x, self.sorted, self.order = x.astype(object), self.sorted.astype(object), self.order.astype(object)
        norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
        place = np.searchsorted(self.norms, norm)
        low, high = np.maximum(place - NEAR, 0), np.minimum(place + NEAR, len(self.norms))
        kind = object if big else np.int64
        at = [np.full(len(x), 1 << 400 if big else _MOST, dtype=kind), np.zeros(len(x), dtype=kind)]
        self._best(x, low, high, at)
        # the annulus, a little wider than rounding of norms and roots can ask for
        far = np.sqrt(at[0].astype(float))
        slack = 1e-9 * (far + norm) + 1e-9
        inner, outer = np.searchsorted(self.norms, norm - far - slack), np.searchsorted(self.norms, norm + far + slack, side="right")
        self._best(x, inner, np.minimum(low, outer), at)
        self._best(x, np.maximum(high, inner), outer, at)
        return at[1].astype(np.int64), at[0]


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(books: list[np.ndarray], dims: int):
    """A task's sums of the parts at each entry; as many rows as entries, whatever the task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = [Codebook(b) for b in books]
        width = dims // len(books)
        n = np.zeros((len(books), len(books[0])), dtype=np.int64)
        total = np.zeros((*n.shape, width), dtype=object)
        for b in batches:
            x = _vectors(b["v"], dims)
            for p, book in enumerate(codebooks):
                part = x[:, p * width : (p + 1) * width]
                own = book.nearest(part)[0]
                n[p] += np.bincount(own, minlength=n.shape[1])
                add = np.zeros(total.shape[1:], dtype=np.int64 if np.abs(part).max(initial=0) < 1 << 40 and len(part) < 1 << 22 else object)
                np.add.at(add, own, part)
                total[p] += add
        parts, entries = np.nonzero(n)
        sums = pa.array([[str(s) for s in total[p, e]] for p, e in zip(parts, entries, strict=True)], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(entries, pa.int32()), pa.array(n[parts, entries], pa.int64()), sums], ["part", "entry", "n", "sums"])

    return run


def _codes(books: list[np.ndarray], dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = [Codebook(b) for b in books]
        width = dims // len(books)
        digits = np.array([f"{i:02x}" for i in range(max(len(books[0]), 1))], dtype=object)
        for b in batches:
            x = _vectors(b["v"], dims)
            code, error = np.full(len(x), "", dtype=object), np.zeros(len(x), dtype=object)
            for p, book in enumerate(codebooks):
                own, d = book.nearest(x[:, p * width : (p + 1) * width])
                code, error = code + digits[own], error + d
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array(code, pa.string()), pa.array([min(int(e), _MOST) for e in error], pa.int64())], ["id", "label", "code", "error"])

    return run


def learn(rows: DataFrame, parts: int, entries: int, rounds: int) -> tuple[int, list[np.ndarray]]:
    """(length of the vectors, codebooks) of rows (id, v array<long>), which are of one length."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    dims = len(first[0]["v"])
    start = np.array([r["v"] for r in first], dtype=np.int64)
    books = [start[:, p * dims // parts : (p + 1) * dims // parts] for p in range(parts)]
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_sums(books, dims), "part int, entry int, n long, sums array<string>")
        each = sums.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s"))
        found = each.groupBy("part", "entry", "pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).toArrow()
        books = [b.copy() for b in books]
        for p, e, pos, s, n in zip(*(found[c].to_pylist() for c in ("part", "entry", "pos", "s", "n")), strict=True):
            books[p][e, pos] = int(s) // n
    return dims, books


def compress(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """((id, label, code, error, label_error), codebooks) of all vectors without null or non-finite components.

    Components become floor(scale * x). Codebooks start as the parts of the vectors of the `entries` smallest ids (at most 256); each of `rounds` rounds assigns all parts to
    their nearest entries and replaces each entry by the floor of its parts' mean; unused entries stay. `code` has two hex digits a part, `error` is the sum of squared distances,
    label_error its sum over equal labels. What reaches the driver is the codebooks and their sums, `entries` times the vectors' length.
    Defined cases: null ids order last, equal ids by their vectors; repeated rows all count; null labels are one label; fewer rows make a smaller codebook, and an empty table empty ones. Vectors are
    taken to have the length of the first by (id, vector) that can be cut into equal parts; those of other lengths, and those with a component of 2^52 or more, have null code and error. Errors beyond 64
    bits stand as the largest long. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits tell 256 entries apart")
    label = F.col(quoted(label_col)) if label_col else F.lit(None).cast("int")
    rows = rows.select(F.col(quoted(id_col)).alias("id"), label.alias("label"), F.col(quoted(vector_col)).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.forall("v", lambda x: F.abs(x) < F.lit(float(1 << 52))) & (F.size("v") > 0) & (F.size("v") % parts == 0)
    kept = write_table(rows.where(F.col("v").isNotNull() & fine).select("id", "label", F.when(whole, F.transform("v", lambda x: F.floor(x * scale))).alias("v")), "code-vectors")
    head = kept.where("v is not null").orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("dims")).first()
    other = kept if head is None else kept.where(F.col("v").isNull() | (F.size("v") != head["dims"]))
    done, books = other.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), []
    if head is not None:
        usable = kept.where(F.size("v") == head["dims"])
        dims, books = learn(usable, parts, entries, rounds)
        schema = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("id", "label")) + ", code string, error long"
        done = usable.mapInArrow(_codes(books, dims), schema).union(done)
    done = write_table(done, "codes")
    drop_table(kept)
    labels = done.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    capped = F.when(F.col("s") > _MOST, F.lit(_MOST)).otherwise(F.col("s").cast("long"))
    return lookup(done, labels.select("label", capped.alias("label_error")), ["label"]), books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for b in books for e in b for c in e).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds one after the other, with all distances."""
    kept = f"""k as (select vec_id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as double)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as (select row_number() over (order by vec_id) as i, vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] as v from k cross join range({PARTS}) r(p)),
b0 as (select p, e, v from (select p, v, row_number() over (partition by p order by vec_id) - 1 as e from x) where e < {ENTRIES})"""
    steps = []
    for r in range(ROUNDS + 1):
        near = f"a{r} as (select i, min(cast(list_inner_product(x.v, x.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(x.v, b.v) as bigint) * {ENTRIES} + e) as m from x join b{r} b using (p) group by i)"
        means = f"""m{r} as (select p, m % {ENTRIES} as e, pos, floor(sum(c) / count(*)) as c from (select p, m, unnest(v) as c, generate_subscripts(v, 1) as pos from x join a{r} using (i)) group by all),
b{r + 1} as (select p, e, coalesce(n.v, b.v) as v from b{r} b left join (select p, e, list(c order by pos) as v from m{r} group by p, e) n using (p, e))"""
        steps += [near, means] if r < ROUNDS else [near]
    return f"""with {kept}, {", ".join(steps)},
f as (select vec_id, label, string_agg(format('{{:02x}}', m % {ENTRIES}), '' order by p) as code, cast(sum(m // {ENTRIES}) as bigint) as error from x join a{ROUNDS} using (i) group by vec_id, label),
s as (select sha256(string_agg(cast(cast(c as bigint) as varchar), ',' order by p, e, pos)) as h from (select p, e, unnest(v) as c, generate_subscripts(v, 1) as pos from b{ROUNDS}))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from f cross join s"""


ORACLE = _oracle()
