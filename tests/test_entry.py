import sys

import pytest


def test_library_does_not_import_the_training_data_subpackage():
    import subprocess

    code = "import sys; from skein import registry; registry.queries(); sys.exit(any(m.startswith('skein.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0]).returncode == 0


def test_sql_belongs_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", ["module_dependencies", "bm25_topk"])
def test_queries_do_not_change_with_partitions(spark, name):
    from skein import registry

    q = registry.queries()[name]
    want = sorted(map(str, q(spark, "/root/testdata/sf0.001").collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(map(str, q(spark, "/root/testdata/sf0.001").collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
