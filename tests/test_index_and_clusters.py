import pytest
from pyspark.sql import functions as F

from skein.functions.markdown import html_series, to_html
from skein.operators import clustering as C
from skein.operators import index as X

SCHEMA = "file string, node long, v array<float>"


def table(spark, rows):
    return spark.createDataFrame([(f, n, [float(n), 1.0]) for f, n in rows], SCHEMA)


def test_index_life(spark, tmp_path):
    ix = X.Index(spark, str(tmp_path / "ix"), SCHEMA, model="m")
    assert ix.needs_rebuild() and ix.count() == 0
    ix.add(table(spark, [("a.rs", 1), ("a.rs", 2), ("b.rs", 3)]), "v")
    assert not ix.needs_rebuild() and ix.count() == 3
    assert ix.remove(spark.createDataFrame([("a.rs",), ("none",)], "file string")) == 2 and ix.count() == 1
    ix.add(table(spark, [("a.rs", 9)]), "v")  # what comes after a tombstone is there
    assert sorted(r.node for r in ix.rows().collect()) == [3, 9]
    ix.update(table(spark, [("b.rs", 5), ("c.rs", 6)]), spark.createDataFrame([("b.rs",)], "file string"), "v")
    assert sorted(r.node for r in ix.rows().collect()) == [5, 9]
    ix.compact()
    assert sorted(r.node for r in ix.rows().collect()) == [5, 9] and len(ix.manifest()["segments"]) == 1
    assert X.Index(spark, str(tmp_path / "ix"), SCHEMA, model="other").needs_rebuild()
    with pytest.raises(ValueError, match="components"):
        ix.add(spark.createDataFrame([("x", 1, [])], SCHEMA), "v")
    ix.clear()
    assert ix.count() == 0


def test_incremental_equals_rebuild(spark, tmp_path):
    new = table(spark, [("a", 1), ("b", 7), ("c", 3)])
    one, two = (X.Index(spark, str(tmp_path / n), SCHEMA) for n in "xy")
    one.rebuild(table(spark, [("a", 1), ("b", 2)]), "v")
    one.update(new, spark.createDataFrame([("b",), ("c",)], "file string"), "v")
    two.rebuild(new, "v")
    assert sorted(map(str, one.rows().collect())) == sorted(map(str, two.rows().collect()))


def test_potts_finds_two_cliques_and_covers_all():
    links = {}
    for group in (range(5), range(5, 10)):
        for a in group:
            for b in group:
                if a != b:
                    links.setdefault(a, {})[b] = 0.8
    links[0][5] = links[5][0] = 0.7
    got = C.potts(links, list(range(12)), 0.5)
    assert got == {**{n: 0 for n in range(5)}, **{n: 5 for n in range(5, 10)}, 10: 10, 11: 11}


def test_communities_and_features(spark):
    files = spark.createDataFrame([(i, f"src/{'ab'[i // 3]}/f{i}.rs") for i in range(6)] + [(9, "docs/x.rs")], "node long, path string")
    edges = spark.createDataFrame([(0, 1, 1.6), (1, 2, 1.6), (0, 2, 1.6), (3, 4, 1.6)], "s long, t long, weight double")
    got = {r.path: r.community for r in C.communities(files, edges).collect()}
    assert len(got) == 7 and got["src/a/f0.rs"] == got["src/a/f2.rs"] == "c0" and got["src/b/f3.rs"] == got["src/b/f4.rs"] == "c3" and got["docs/x.rs"] == "ddocs"
    same = spark.createDataFrame([(1, 2, 1.0)], "a long, b long, jaccard double")
    none = spark.createDataFrame([], "a long, b long, value double")
    calls = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "s long, t long")
    assert {(r.feature, r.node) for r in C.features(calls, same, none).collect()} == {("feature_0", 1), ("feature_0", 2)}
    names = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "x", "b")], "id int, name string, stem string")
    assert {r.id: r.name for r in C.unique_names(names).collect()} == {1: "x", 2: "x::b", 3: "module_3"}


def test_html(spark):
    text = "# T & U\n\nsee [a](b.md) and `x<y` **bold**\n\n- one\n- two\n```mermaid\ngraph TD\n```\n<b>"
    want = '<h1>T &amp; U</h1>\n<p>see <a href="b.html">a</a> and <code>x&lt;y</code> <strong>bold</strong></p>\n<ul><li>one</li><li>two</li></ul>\n<div class="mermaid">graph TD</div>\n<p>&lt;b&gt;</p>'
    assert to_html(text) == want
    got = spark.createDataFrame([(text,), (None,)], "t string").select(F.pandas_udf(html_series, "string")("t").alias("h")).collect()
    assert [r.h for r in got] == [want, None]
