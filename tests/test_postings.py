import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from skein.operators import postings as P
from skein.operators import retrieval as R


def test_blocks_go_there_and_back():
    rng = np.random.default_rng(1)
    for tf in (rng.integers(1, 9, 100).astype(float), rng.random(100) * 3):
        docs, length = np.cumsum(rng.integers(1, 5000, 100)) + (7 << 33), rng.integers(1, 100_000, 100)
        got = P.decode(P.encode(docs, tf, length), int(docs[0]), 100)
        assert all((a == b).all() for a, b in zip(got, (docs, tf, length), strict=True))


def documents(spark, seed, n, start=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"f{(start + i) % 17}", start + i, " ".join(rng.choice(words[i * 40 // n : i * 40 // n + 3]) for _ in range(rng.randrange(60))), f"common title{i % 5}") for i in range(n)]
    rows += [("f3", start + n, None, None), ("f3", start + n + 1, "", "")]
    return spark.createDataFrame(rows, "file string, node long, text string, title string")


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK", 8), ("RANGE", 32), ("FIRST", 1)):
        monkeypatch.setattr(P, name, value)


def test_as_without_an_index(spark, tmp_path, small):
    """After adding, removing and updating, searches give what a scan of the documents that are left gives; blocks are skipped."""
    fields = {"text": 1.0, "title": 2.5}
    q = spark.createDataFrame([(i, t) for i, ts in enumerate((["w0"], ["w39", "w0"], ["w38", "w37", "w39"], ["common", "w5"], ["nowhere"], ["title3", "w12", "w12"], [None])) for t in ts], "query int, term string")
    a, b = documents(spark, 1, 700), documents(spark, 2, 200, 1000)
    ix = P.TextIndex(spark, str(tmp_path / "ix"), fields)
    assert ix.search(q).collect() == []

    def same(docs, k, told=None):
        got = sorted(map(tuple, ix.search(q, k, told).collect()))
        assert got == sorted(map(tuple, R.text_search(docs, "node", fields, q, k).select("query", "node", "score", "rank").collect()))

    ix.add(a)
    told = {}
    same(a, 3, told)
    print(told)
    assert told["decoded"] < told["blocks"] and told["buckets"] <= 11
    ix.add(b)
    same(a.union(b), 3)
    gone = spark.createDataFrame([("f3",), ("f4",)], "file string")
    assert ix.remove(gone) > 0
    left = a.union(b).where("file not in ('f3', 'f4')")
    same(left, 5)
    new = spark.createDataFrame([("f5", 5000, "w39 w38 w37", "common")], "file string, node long, text string, title string")
    ix.update(new, spark.createDataFrame([("f5",)], "file string"))
    same(left.where("file <> 'f5'").union(new), 2000)


def test_a_range_is_cut_and_scored_in_one_task(spark, tmp_path, monkeypatch):
    """F3 stored_bm25_topk: neither postings nor hits of queries are shuffled; a range with many postings is cut more than once."""
    context = spark.sparkContext

    def shuffled():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    docs = spark.range(3000).selectExpr("'f' as file", "id as node", "concat_ws(' ', 'a', 'b', 'c', 'd', 'e', if(id % 7 = 0, 'a b', ''), 'w' || id % 50) as text").coalesce(1)
    q = spark.range(60).selectExpr("id as query", "explode(array('a', 'b', 'c', 'd', 'e', 'w' || id % 50)) as term")
    ix = P.TextIndex(spark, str(tmp_path / "ix"), {"text": 1.0})
    before = shuffled()
    ix.add(docs)
    # the documents themselves, and blocks of 128 postings of common words
    assert shuffled() - before < 3000 + 1000
    before = shuffled()
    got = sorted(map(tuple, ix.search(q, 3).collect()))
    assert shuffled() - before < 20_000 < 60 * 3000
    assert got == sorted(map(tuple, R.text_search(docs, "node", {"text": 1.0}, q, 3).select("query", "node", "score", "rank").collect()))


def test_blocks_are_cut_before_a_task_holds_too_much(monkeypatch):
    tokens = pa.array([[{"term": t, "w": 1.5} for t in ts] for ts in (["a", "b", "a"], [], ["b"], ["a"], ["c", "a"])], pa.list_(pa.struct([("term", pa.string()), ("w", pa.float64())])))
    one = pa.table({"file": ["f"] * 5, "node": pa.array(range(5)), "doc": pa.array([0, 1, 2, 4, 5]), "length": pa.array([3, 0, 1, 1, 2]), "all": tokens})
    for most in (1, 1_000_000):
        monkeypatch.setattr(P, "POSTINGS", most)
        for size in (1, 2, 5):
            out = pa.Table.from_batches(list(P._index(iter(one.to_batches(size)), 4, 2)))
            blocks = out.filter(pc.is_valid(out["term"]))
            assert sorted(out.filter(pc.is_null(out["term"]))["doc"].to_pylist()) == [0, 1, 2, 4, 5]
            held = [(t, s, int(d), f, int(n)) for t, s, a, k, x in zip(*(blocks[c].to_pylist() for c in ("term", "span", "first", "n", "data")), strict=True) for d, f, n in zip(*P.decode(x, a, k), strict=True)]
            assert sorted(held) == [("a", 0, 0, 3.0, 3), ("a", 1, 4, 1.5, 1), ("a", 1, 5, 1.5, 2), ("b", 0, 0, 1.5, 3), ("b", 0, 2, 1.5, 1), ("c", 1, 5, 1.5, 2)]
