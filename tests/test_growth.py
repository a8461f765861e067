from pyspark.sql import functions as F

from skein.operators import metrics as M
from skein.operators import retrieval as R


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_answer_is_parsed_once_for_each_score(spark):
    """F29 score_pairs, F30 quality_report."""
    answer = 'so {"A": {"clarity": 11, "richness": 2}, "B": {"clarity": -1, "richness": 3}} ok'
    rows = spark.createDataFrame([(answer,), ('{"A": {"clarity": 1}}',), ("none",), (None,)], "t string")
    x = rows.select(M.score_pairs(F.col("t"), ("clarity", "richness")).alias("x"))
    used = x.select(M.judgment(F.col("x.a"), F.col("x.b")).alias("judgment"), F.aggregate("x.a", F.lit(0.0), lambda s, v: s + v).alias("total"))
    assert optimized(used).count("get_json_object") == 4
    assert [tuple(r) for r in used.collect()] == [(1, 12.0), (None, None), (None, None), (None, None)]


def test_hits_are_not_written_out_for_the_best_of_them(spark, monkeypatch):
    """F21 bm25_field_weighted, F25 rrf_fusion, F27 completeness_at_k, F28 bm25_topk; small blocks, an id with two texts, no text and no words."""
    monkeypatch.setattr(R, "DOCUMENTS", 2)
    monkeypatch.setattr(R, "QUERIES", 1)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(1, 12) if i % j == 0)) for i in range(40)] + [(3, "w2 w2 w3"), (50, None), (51, "-"), (None, "w3 w9")], "node long, text string")
    q = spark.createDataFrame([(1, "w1"), (1, "w3"), (1, "w3"), (2, "w2"), (2, "w5"), (3, "none"), (4, None)], "query int, term string")
    got = R.text_search(docs, "node", {"text": 2}, q, 5)
    assert "Window" in optimized(got) and optimized(got).count("Join") == 1  # of terms with their idf, not of queries with postings
    # as the contract of sizes has it, every row counts with its length
    sizes = docs.selectExpr("node", "size(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+', 0)) as length")
    want = R.bm25(R.postings(docs, "node", {"text": 2}), q, 5, sizes)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    empty = R.text_search(docs.where("node < 0"), "node", {"text": 2}, q)
    assert empty.count() == 0 and R.text_search(docs, "node", {"text": 2}, q.where("query < 0")).count() == 0
