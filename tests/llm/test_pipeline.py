from collections import Counter

import corpus_pipeline as cp
from odd import ODD
from test_bpe import library  # noqa: F401  a fixture
from test_lines import brute_maximal as clean_lines
from test_minhash import brute as groups

from skein.llm import mixing, quality
from skein.llm.base import write_table

SF = "/root/testdata/sf0.001"


def test_stages_on_small_tables(spark, library):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, stage = docs.columns, dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "near-duplicate removal", "mixing sources", "byte-level BPE"]
    rows = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]

    good = write_table(stage["quality classifier"](spark, docs, SF), "t")
    assert good.columns == columns
    want = {r.doc_id for r in quality.classify(docs, quality.train(docs, labels)).collect() if r.predicted}
    assert {r.doc_id for r in good.collect()} == want

    lined = write_table(stage["line dedup"](spark, good, SF), "t")
    assert lined.columns == columns
    want = {i: t for (i, _), (t, n) in clean_lines(rows(good), 50).items() if not n or t.split()}
    assert {r.doc_id: r.text or "" for r in lined.collect()} == want
    assert all(r.n_chars == len(r.text or "") for r in lined.collect())

    unique = write_table(stage["near-duplicate removal"](spark, lined, SF), "t")
    assert unique.columns == columns
    assert sorted(r.doc_id for r in unique.collect()) == sorted({c for _, _, c in groups(rows(lined), 5)})

    mixed = write_table(stage["mixing sources"](spark, unique, SF), "t")
    assert mixed.columns == columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.repeats for r in mixing.mix(unique).collect() if r.repeats})

    coded = stage["byte-level BPE"](spark, mixed, SF).collect()
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert len(coded) == mixed.count() and all(r.n_tokens == len(library.encode_ordinary(texts[r.doc_id])) for r in coded)
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, coded))


def test_stages_with_odd_rows_and_clashing_names(spark, docs_of):
    """Every stage but the last gives the columns it got, the caller's values in them."""
    rows = [*ODD, *((100 + i, f"{i % 7} " + "a line that many hold " * 12 + f"\nand one of its own {i}", "bcd"[i % 3]) for i in range(30))]
    docs = docs_of(rows, extra=True)
    values = {c: docs.first()[c] for c in docs.columns[5:]}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[c] == v for r in got for c, v in values.items()), name
    assert len(cp.STAGES[-1][1](spark, docs, SF).collect()) == len(rows)


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []
