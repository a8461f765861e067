import random

import pytest
from pyspark.sql import functions as F

from skein.operators import metrics as M
from skein.operators import phrases as P
from skein.operators import retrieval as R


@pytest.mark.parametrize("block", [3, 50_000])
def test_as_counted_one_by_one(spark, monkeypatch, block):
    """Phrases inside others, that overlap themselves, and more of them than one automaton takes."""
    monkeypatch.setattr(P, "BLOCK", block)
    rng = random.Random(block)
    texts = [(i, "".join(rng.choice("ab  c") for _ in range(rng.randrange(80)))) for i in range(60)] + [(100, None), (101, ""), (102, "aa aa aa aa a é😀 a")]
    phrases = ["a a", "aa a", " ", "  ", "a", "b c", "aa aa", "a b a", "😀 a", "nowhere at all", "", None, "a a"]
    got = P.phrase_hits(spark.createDataFrame(texts, "page int, text string"), spark.createDataFrame([(p,) for p in phrases], "keyword string")).collect()
    want = {(i, p): t.count(p) for i, t in texts if t for p in phrases if p and p in t}
    assert {(r["page"], r["keyword"]): r["n"] for r in got} == want and len(got) == len(want)


def test_no_nested_loops(spark):
    pages = spark.createDataFrame([(1, "one two three"), (2, "two three two three")], "page int, text string")
    q = spark.createDataFrame([(7, "two three"), (7, "one"), (7, "two three"), (8, "")], "query int, keyword string")
    got = R.page_hits(pages, q)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert {(r["query"], r["page"], r["hits"]) for r in got.collect()} == {(7, 1, 3), (7, 2, 4)}
    names = spark.createDataFrame([("two three",), ("three one",), ("one",), ("",)], "name string")
    assert tuple(M.coverage(names, pages).first()) == (4, 3, 0.75)
    assert tuple(M.coverage(names, pages.where(F.lit(False))).first()) == (4, 0, 0.0)
