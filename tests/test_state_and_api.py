import pytest

from skein import api
from skein.operators import retrieval as R
from skein.sources import state as S


def test_state_and_config(spark, tmp_path):
    p = str(tmp_path / "s/state.json")
    assert S.load_state(p) == {}
    S.save_state(p, {"b": 1, "file_fingerprints": {"x": "1"}})
    first = (tmp_path / "s/state.json").read_bytes()
    S.save_state(p, {"file_fingerprints": {"x": "1"}, "b": 1})
    assert (tmp_path / "s/state.json").read_bytes() == first
    assert S.fingerprints(spark, S.load_state(p)).collect()[0].hash == "1"
    assert S.merge({"a": {"x": 1, "y": [1]}, "b": 2}, {"a": {"y": [2]}, "b": {"z": 1}}) == {"a": {"x": 1, "y": [2]}, "b": {"z": 1}}
    tables = {n: spark.createDataFrame([(n,)], "t string") for n in S.SNAPSHOT}
    S.write_snapshot(str(tmp_path / "snap"), **tables)
    assert {n: df.first().t for n, df in S.read_snapshot(spark, str(tmp_path / "snap")).items()} == {n: n for n in S.SNAPSHOT}


def test_plan(tmp_path):
    f = tmp_path / "plan.yaml"
    assert S.load_plan(str(f)) is None
    f.write_text('{"version": 1, "notes": ["n"], "scope": {"include": ["src/**"]}}')
    assert S.load_plan(str(f)).include == ["src/**"]
    for bad in ('{"version": 2}', '{"version": 1, "scope": {"exclude": ["/"]}}'):
        f.write_text(bad)
        with pytest.raises(ValueError):
            S.load_plan(str(f))


def test_search(spark):
    docs = spark.createDataFrame([(1, "add user to store"), (2, "delete user"), (3, "send packets"), (4, "other"), (5, "more")], "id long, text string")
    post = R.postings(docs, "id", {"text": 1})
    vec = spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.0, 1.0])], "node long, v array<float>")
    assert [r.node for r in api.search("store", postings=post, engine="text").collect()] == [1]
    assert [r.node for r in api.search("x", vectors=vec, embed=lambda q: [1.0, 0.1], engine="semantic").collect()] == [2]
    both = api.search("user", postings=post, vectors=vec, embed=lambda q: [1.0, 0.1]).orderBy("rank").collect()
    assert both[0].node == 2 and {r.node for r in both} == {1, 2}
    assert [r.node for r in api.search("store", postings=post).collect()] == [1]
    assert api.search("  ", postings=post).collect() == []
    with pytest.raises(LookupError):
        api.search("x", postings=post, engine="semantic")
    with pytest.raises(ValueError):
        api.segment("../x")
    assert (api.clamp(0), api.clamp(99)) == (1, 50)
