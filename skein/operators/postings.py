"""A stored inverted index: blocks of delta-coded postings with maxima, in buckets of terms, and an exact top-k that skips what cannot reach the kth score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators import retrieval as R
from skein.operators.index import Index
from skein.sources.scratch import Scratch

#: Postings of a block, documents of a range (blocks don't cross ranges), buckets of terms, ranges of a query that are scored first, and postings that a task holds before it cuts them.
BLOCK, RANGE, BUCKETS, FIRST, POSTINGS = 128, 2048, 64, 4, 1_000_000
#: Whole numbers of so many bytes, and fractions.
_TYPES = (np.uint8, np.uint16, np.uint32, np.uint64, np.float64)
_BLOCKS = "term string, span long, block long, first long, n int, max_tf double, min_length long, data binary, bucket int"


_SIZES = np.array([np.dtype(t).itemsize for t in _TYPES])
_LIMITS = np.array([np.iinfo(t).max for t in _TYPES[:3]])


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of blocks of n rows: the block of each row, and its place there."""
    block = np.repeat(np.arange(len(n)), n)
    return block, np.arange(len(block)) - (np.cumsum(n) - n)[block]


def encode_blocks(starts: np.ndarray, docs: np.ndarray, tf: np.ndarray, length: np.ndarray) -> pa.BinaryArray:
    """Blocks that begin at `starts`: ascending numbers of documents as differences, lengths, and frequencies (as whole numbers where a block's are), in as few bytes each as the block's largest takes."""
    n = np.diff(np.append(starts, len(docs)))
    block, place = _places(n)
    delta = np.diff(docs, prepend=docs[:1])
    delta[starts] = 0
    whole = np.logical_and.reduceat((tf == np.floor(tf)) & (tf >= 0) & (tf < 2**53), starts)
    columns = []
    for values in (delta, length, tf):
        kind = np.searchsorted(_LIMITS, np.maximum.reduceat(values, starts))
        columns.append((values, np.where(whole, kind, 4) if values is tf else kind))
    ends = np.cumsum(sum(1 + n * _SIZES[kind] for _, kind in columns))
    out = np.empty(ends[-1], np.uint8)
    at = np.append(0, ends[:-1])
    for values, kind in columns:
        out[at] = kind
        for k in np.unique(kind):
            of = np.flatnonzero((kind == k)[block])
            to = at[block[of]] + 1 + place[of] * _SIZES[k]
            raw = values[of].astype(_TYPES[k]).view(np.uint8).reshape(len(of), -1)
            for i in range(_SIZES[k]):
                out[to + i] = raw[:, i]
        at = at + 1 + n * _SIZES[kind]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(out)])


def decode_blocks(data: pa.BinaryArray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(docs, tf, length) of blocks of n postings, one after the other."""
    block, place = _places(n)
    at = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data)].astype(np.int64)
    held = np.frombuffer(data.buffers()[2], np.uint8)
    out = []
    for values in (np.empty(len(block), np.int64), np.empty(len(block), np.int64), np.empty(len(block), np.float64)):
        kind = held[at]
        for k in np.unique(kind):
            of = np.flatnonzero((kind == k)[block])
            source = at[block[of]] + 1 + place[of] * _SIZES[k]
            raw = np.empty((len(of), _SIZES[k]), np.uint8)
            for i in range(_SIZES[k]):
                raw[:, i] = held[source + i]
            values[of] = raw.view(_TYPES[k]).ravel()
        at = at + 1 + n * _SIZES[kind]
        out.append(values)
    total = np.cumsum(out[0])
    return (first - total[np.cumsum(n) - n])[block] + total, out[2], out[1]


def encode(docs: np.ndarray, tf: np.ndarray, length: np.ndarray) -> bytes:
    return encode_blocks(np.zeros(1, int), docs, tf, length)[0].as_py()


def decode(data: bytes, first: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return decode_blocks(pa.array([data], pa.binary()), np.array([first]), np.array([n]))


def _cut(term: pa.Array, doc: np.ndarray, tf: np.ndarray, length: np.ndarray, span: int, block: int) -> list[pa.Array]:
    """Columns of the blocks of one range's postings."""
    code = term.dictionary_encode().indices.to_numpy()
    by = np.lexsort((doc, code))
    code, doc, tf, length = (x[by] for x in (code, doc, tf, length))
    runs = np.append(0, np.flatnonzero(code[1:] != code[:-1]) + 1)
    starts = np.flatnonzero(_places(np.diff(np.append(runs, len(code))))[1] % block == 0)
    first = pa.array(doc[starts])
    whole = [term.take(pa.array(by[starts])), pa.array(np.full(len(starts), span)), first, first, pa.array(np.diff(np.append(starts, len(code))), pa.int32()), pa.array(np.maximum.reduceat(tf, starts))]
    return [*whole, pa.array(np.minimum.reduceat(length, starts)), encode_blocks(starts, doc, tf, length)]


def _index(batches: Iterator[pa.RecordBatch], span: int, block: int) -> Iterator[pa.RecordBatch]:
    """Documents (file, node, doc, length, all), as they are numbered: rows of their blocks, without documents, and rows of the documents, without blocks.

    A range's postings are counted batch by batch and cut into blocks where the range ends, or where there are as many as a task should hold at once.
    """
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.binary()]
    names = [f.split(" ")[0] for f in _BLOCKS.split(", ")][: len(kinds)] + ["file", "node", "doc", "length"]
    at, open_, held = None, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        own = [b[c] for c in names[len(kinds) :]]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(b.num_rows, k) for k in kinds), *own], names)
        none = lambda n: [pa.nulls(n, c.type) for c in own]  # noqa: B023, E731
        doc, length = b["doc"].to_numpy(), b["length"].to_numpy()
        ranges = doc // span
        edges = np.append(0, np.flatnonzero(np.diff(ranges)) + 1)
        for x, z in zip(edges, np.append(edges[1:], b.num_rows), strict=True):
            if open_ and (ranges[x] != at or held > POSTINGS):
                columns = _cut(pa.concat_arrays([o[0] for o in open_]), *(np.concatenate([o[i] for o in open_]) for i in (1, 2, 3)), at, block)
                yield pa.RecordBatch.from_arrays([*columns, *none(len(columns[0]))], names)
                open_, held = [], 0
            at = int(ranges[x])
            lists = b["all"].slice(x, z - x)
            tokens = lists.flatten()
            if not len(tokens):
                continue
            terms = tokens.field("term").dictionary_encode()
            place = np.repeat(np.arange(x, z), pc.list_value_length(lists).to_numpy())
            found, which = np.unique(place * len(terms.dictionary) + terms.indices.to_numpy(), return_inverse=True)
            place, code = np.divmod(found, len(terms.dictionary))
            open_.append((terms.dictionary.take(pa.array(code)), doc[place], np.bincount(which, tokens.field("w").to_numpy(), len(found)), length[place]))
            held += len(found)
    if open_:
        columns = _cut(pa.concat_arrays([o[0] for o in open_]), *(np.concatenate([o[i] for o in open_]) for i in (1, 2, 3)), at, block)
        yield pa.RecordBatch.from_arrays([*columns, *none(len(columns[0]))], names)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            n = b["n"].to_numpy()
            doc, tf, length = decode_blocks(b["data"].cast(pa.binary()), b["first"].to_numpy(), n)
            at = pa.array(_places(n)[0])
            yield pa.RecordBatch.from_arrays([b["term"].take(at), b["segment"].take(at), *map(pa.array, (doc, tf, length))], ["term", "segment", "doc", "tf", "length"])


def _best(held: pa.Table, asked: pa.Table, k: int, mean: float) -> pa.Table:
    """(query, node, score): of blocks (term, first, n, data) and documents (doc, node) of a range and queries (query, term, idf) the k best documents of each query, ties to the smaller node."""
    has = pc.is_valid(held["doc"])
    blocks, docs = held.filter(pc.invert(has)), held.filter(has).sort_by("doc")
    nodes = docs["node"].combine_chunks()
    if not blocks.num_rows or not docs.num_rows or not asked.num_rows:
        return pa.table({"query": asked["query"].slice(0, 0), "node": nodes.slice(0, 0), "score": pa.array([], pa.float64())})
    terms = blocks["term"].combine_chunks().dictionary_encode()
    n, own = blocks["n"].to_numpy(), docs["doc"].to_numpy()
    doc, tf, length = decode_blocks(blocks["data"].combine_chunks().cast(pa.binary()), blocks["first"].to_numpy(), n)
    at = np.minimum(np.searchsorted(own, doc), len(own) - 1)
    lives = own[at] == doc
    w = tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * length / mean))
    return R.best(np.repeat(terms.indices.to_numpy(), n)[lives], terms.dictionary, at[lives], nodes, w[lives], asked, k)


def contribution(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * length / mean))


class TextIndex:
    """Postings of documents (file, node, text fields) below a folder, in segments.

    A segment has a table of its documents (file, node, doc, length), numbered by task and place, and one of blocks: up to BLOCK postings of a term in a range of
    documents, sorted by document, with the largest frequency and the smallest length, partitioned by bucket of term and sorted by term. Adding writes a segment; removing writes names of files, whose documents no longer count. Which segments and removals
    hold is told by the manifest of a row index over the documents, which is written last: a reader sees a whole version or the one before.
    """

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, float], node_type: str = "long"):
        self.spark, self.path, self.fields = spark, path.rstrip("/"), fields
        self.index = Index(spark, f"{self.path}/docs", f"file string, node {node_type}, doc long, length long, segment long", model=",".join(f"{f}:{w:g}" for f, w in sorted(fields.items())))

    def add(self, docs: DataFrame) -> None:
        """Index documents (file, node, fields); a rebuild where the index is of other fields."""
        segment = self.index.manifest()["version"] + 1
        terms = R._terms(docs.withColumn("_key", F.struct("file", "node")), "_key", self.fields).withColumn("length", F.size("all").cast("long"))
        scratch = Scratch(self.spark, "postings")
        # numbers ascend within a task's documents, so a range's are one task's, which counts its words and cuts its blocks: no posting is shuffled
        texts = terms.select(F.col("node.file").alias("file"), F.col("node.node").alias("node"), F.monotonically_increasing_id().alias("doc"), "length", "all")
        span, block = RANGE, BLOCK
        types = f"{_BLOCKS.removesuffix(', bucket int')}, file string, node {texts.schema['node'].dataType.simpleString()}, doc long, length long"
        rows = scratch.save(texts.mapInArrow(lambda batches: _index(batches, span, block), types))
        p = rows.where("term is not null").select(*[f.split(" ")[0] for f in _BLOCKS.split(", ")][:-1], F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        p = p.repartition("bucket", F.floor(F.col("span") / 64)).sortWithinPartitions("bucket", "term", "span", "block")
        p.write.partitionBy("bucket").parquet(f"{self.path}/blocks/segment-{segment}")
        self.index.add(rows.where("term is null").select("file", "node", "doc", "length", F.lit(segment).cast("long").alias("segment")))
        scratch.drop(rows)

    def remove(self, files: DataFrame) -> int:
        return self.index.remove(files)

    def update(self, docs: DataFrame, changed: DataFrame) -> None:
        """Delete the changed files (file) and add the documents of theirs that docs has."""
        self.remove(changed)
        self.add(docs.join(changed.select("file").distinct(), "file", "left_semi"))

    def _held(self) -> tuple[DataFrame, bool]:
        """Blocks of the segments that hold, and whether some of their documents are removed."""
        m = self.index.manifest()
        out = None
        for name in m["segments"]:
            part = self.spark.read.schema(_BLOCKS).parquet(f"{self.path}/blocks/{name}").withColumn("segment", F.lit(int(name.rsplit("-", 1)[1])).cast("long"))
            out = part if out is None else out.unionByName(part)
        return out, bool(m["tombstones"])

    def search(self, queries: DataFrame, k: int = 10, told: dict | None = None) -> DataFrame:
        """(query, node, score, rank) as bm25() of all documents would give them, for queries (query, term).

        Only the buckets of asked terms are read, and of them first the blocks' maxima. For each query and range of documents these bound the scores; the FIRST ranges with the
        highest bounds are scored, and their kth score rules out ranges and single blocks of the rest. What is ruled out can't be among the k best,
        ties and rounding included. `told` takes how many blocks the asked terms have and how many were decoded.
        """
        scratch = Scratch(self.spark, "search")
        held, removed = self._held()
        docs = self.index.rows()
        empty = queries.select("query").where("false").join(docs.select("node").where("false")).select("query", "node", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
        nodes, mean = docs.where("length > 0").agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(1.0))).first()
        if held is None or not nodes:
            return empty
        wanted = scratch.save(queries.where("term is not null").select("query", "term").distinct())
        buckets = [r[0] for r in wanted.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # BUCKETS at most
        terms = wanted.select("term").distinct()
        asked = held.where(F.col("bucket").isin(buckets)).join(terms, "term", "left_semi")
        live = docs.select("segment", "doc", "node")
        if removed:
            df = asked.select("term", "segment", "data", "first", "n").mapInArrow(_postings, "term string, segment long, doc long, tf double, length long").join(live, ["segment", "doc"], "left_semi").groupBy("term").agg(F.count("*").alias("df"))
        else:
            df = asked.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.greatest(F.log((nodes - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        idfs = scratch.save(df.select("term", idf.alias("idf")))
        most = F.col("idf") * contribution(F.col("max_tf"), F.col("min_length"), F.lit(mean))
        bounds = scratch.save(asked.select("term", "segment", "span", "block", "max_tf", "min_length").join(idfs, "term").select("term", "segment", "span", "block", most.alias("most")))
        tops = wanted.join(bounds.groupBy("term", "segment", "span").agg(F.max("most").alias("most")), "term")
        spans = scratch.save(tops.groupBy("query", "segment", "span").agg(F.sum("most").alias("bound")))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("bound").desc(), "segment", "span"))
        first = scratch.save(spans.withColumn("place", place).where(F.col("place") <= FIRST).select("query", "segment", "span", "bound", F.lit(None).cast("double").alias("kth")))
        shares = max(1, -(-wanted.select("query").distinct().count() // R.QUERIES))
        share = F.pmod(F.xxhash64("query"), F.lit(shares)).cast("int").alias("share")
        shared = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
        # one column: a segment that is the same in all rows would leave the groups' keys but not the shuffle's
        cell = F.concat_ws(" ", "segment", "span", "share").alias("cell")
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        types = f"query {wanted.schema['query'].dataType.simpleString()}, node {live.schema['node'].dataType.simpleString()}, score double"
        decoded = []

        def scores(of: DataFrame) -> DataFrame:
            """(query, node, score) of queries and ranges (query, segment, span, bound, kth): the k best of a range. A range's blocks and documents meet its queries in one task, so that neither postings nor hits are shuffled for each query."""
            # a block is read if with it any of the queries can reach its kth score
            least = tops.join(of, ["query", "segment", "span"]).groupBy("term", "segment", "span").agg(F.min(F.coalesce(F.col("kth") - F.col("bound") + F.col("most"), F.lit(float("-inf")))).alias("least"))
            blocks = scratch.save(bounds.join(least, ["term", "segment", "span"]).where(F.col("most") + 1e-6 >= F.col("least")).select("term", "segment", "block"))
            decoded.append(blocks.count() if told is not None else 0)
            data = asked.select("term", "segment", "span", "block", "first", "n", "data").join(blocks, ["term", "segment", "block"], "left_semi")
            data = data.select("segment", "span", "term", "first", "n", "data", shared).select(cell, "term", "first", "n", "data")
            own = live.withColumn("span", F.floor(F.col("doc") / RANGE)).join(of.select("segment", "span").distinct(), ["segment", "span"], "left_semi").select("segment", "span", "doc", "node", shared).select(cell, "doc", "node")
            held = data.unionByName(own, allowMissingColumns=True).repartition(tasks, "cell")
            put = wanted.join(idfs, "term").join(of, "query").select("segment", "span", share, "query", "term", "idf").select(cell, "query", "term", "idf")
            return held.groupBy("cell").cogroup(put.groupBy("cell")).applyInArrow(lambda h, q: _best(h, q, k, mean), types)

        best = Window.partitionBy("query").orderBy(F.col("score").desc(), "node")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
        start = scratch.save(ranked(scores(first)))
        kth = start.where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
        left = scratch.save(spans.join(first, ["query", "segment", "span"], "left_anti").join(kth, "query", "left").where("kth is null or bound + 1e-6 >= kth"))
        out = scratch.save(ranked(start.drop("rank").union(scores(left))))
        if told is not None:
            told |= {"buckets": len(buckets), "blocks": bounds.count(), "decoded": sum(decoded)}
        scratch.drop(wanted, idfs, bounds, spans, first, start, left)
        return out
