import zlib

import numpy as np
import pytest
from odd import ODD
from pyspark.sql import functions as F

from skein.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, quality.train(docs, labels)).withColumn("held_out", quality.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert sum(r.predicted for r in held if r.quality) >= 0.98 * sum(r.quality for r in held)


def test_tables_learn_single_features_and_pairs():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(4000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells anything alone
    m = quality.Additive().fit(x[:3000], y[:3000])
    assert (0, 1) in m.chosen
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    one = quality.Additive().fit(x, (x[:, 2] > 0.3).astype(float))
    assert ((one.score(x) > 0.5) == (x[:, 2] > 0.3)).mean() > 0.98


@pytest.mark.parametrize("label", [None, 0.0, 1.0])
def test_few_or_no_labels(label):
    x = np.ones((5, 3)) if label is not None else np.zeros((0, 3))
    s = quality.Additive().fit(x, np.full(len(x), label or 0.0)).score(np.ones((2, 3)))
    assert ((s >= 0) & (s <= 1)).all() and (s[0] == 0.5 if label is None else (s[0] > 0.5) == bool(label))


def test_odd_rows(spark, docs_of):
    docs = docs_of(ODD, extra=True)
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (7, 0, 0), (7, 0, 0), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = quality.classify(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    empty = {round(r.score, 12) for r in got if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1
    assert quality.classify(docs_of([]), model).collect() == []
    again = quality.classify(docs, quality.train(docs.repartition(7), labels.repartition(3))).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in got)


def test_an_id_that_stands_often_is_bounded(spark, docs_of, monkeypatch):
    """20,000 rows of one id, all different, and of another all equal: at most `most` rows reach the driver, whatever the partitioning."""
    often = spark.range(20_000).selectExpr("1L as doc_id", "concat('word ', repeat('x ', cast(id % 300 as int)), id) as text").union(spark.range(5000).selectExpr("2L", "'the same words again'"))
    docs = often.union(docs_of([(i, f"some text of {i} words here", "s") for i in range(3, 60)]).select("doc_id", "text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    seen, fit = [], quality.Additive.fit
    monkeypatch.setattr(quality.Additive, "fit", lambda self, x, y: (seen.append((len(x), x.tolist())), fit(self, x, y))[1])
    quality.train(docs, labels, most=100)
    quality.train(docs.repartition(5), labels, most=100)
    assert seen[0] == seen[1] and seen[0][0] <= 100
