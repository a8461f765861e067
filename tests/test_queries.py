"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from skein import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [r.asDict() for r in df.collect()]
    if name not in registry.oracle_sql():
        assert df.columns
        return
    cur = duck.execute(registry.oracle_sql()[name])
    cols = sorted(d[0] for d in cur.description)
    assert cols == sorted(df.columns)
    want = [dict(zip([d[0] for d in cur.description], r, strict=True)) for r in cur.fetchall()]
    rows = lambda x: sorted((tuple(plain(r[c]) for c in cols) for r in x), key=repr)
    assert rows(got) == rows(want)
