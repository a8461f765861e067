from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import audit as A
from skein.operators import graph as G
from skein.operators import metrics as M
from skein.operators import retrieval as R
from skein.streaming import watch as W


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns).collect()]


def test_call_edges_link_every_entity_of_a_name(spark):
    e = spark.createDataFrame([(1, "helper", "fn", "fn helper() {}"), (2, "helper", "fn", "fn helper() {}"), (3, "main", "fn", "helper(1); helper(2); other (3); // helper(4)")], "id int, name string, kind string, body string")
    assert rows(G.call_edges(e)) == [(3, 1), (3, 2)]
    assert rows(G.call_edges(e, spark.createDataFrame([(3, 1)], "src int, dst int"))) == [(3, 2)]


def test_imports_see_earlier_nodes_and_fall_back_to_paths(spark):
    nodes = spark.createDataFrame([(1, "store", "src/a.rs"), (2, "x", "src/net/tcp.rs"), (3, "y", "lib/net/tcp.rs"), (9, "later", "z.rs")], "id int, name string, path string")
    imports = spark.createDataFrame([(5, 5, "crate::store"), (6, 6, "net::tcp"), (7, 7, "crate::later")], "src int, upto int, target string")
    assert rows(G.import_edges(imports, nodes)) == [(5, 1), (6, 3)]


def test_cycles(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "src int, dst int")
    assert rows(G.cycles(e)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def test_fusion_adds_reciprocal_ranks(spark):
    a = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query int, node string, rank int")
    b = spark.createDataFrame([(1, "a", 1), (1, "c", 2)], "query int, node string, rank int")
    assert [r.node for r in R.fuse([a, b]).orderBy("rank").collect()] == ["c", "a", "b"]
    assert R.fuse([a]).where("rank = 1").first().score == 1.0


def test_vectors_within_the_threshold(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [-1.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0])], "node int, v array<float>")
    q = spark.createDataFrame([(1, [0.9, 0.1, 0.0])], "query int, q array<float>")
    assert [r.node for r in R.neighbours(v, q).collect()] == [1]


def test_tokens(spark):
    got = spark.createDataFrame([("图数据库索引", ), ("abc图数 x_1字", ), ("!!", )], "t string").select(T.tokens(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [["图数", "数据", "据库", "库索", "索引"], ["abc", "图数", "x", "1"], []]


def test_markdown_view(spark):
    text = "# T\n## Dependencies\n- `a::b` - x\n```rust\n- c\n```\nsee src/a.rs:3-9 and {{ name }}\n```mermaid\ngraph TD"
    view = A.lines(spark.createDataFrame([("p", text)], "page string, text string"))
    assert rows(A.fence_ranges(view), "start") == [("p", 4, 6), ("p", 8, 9)]
    assert rows(A.dependency_claims(view, ["Dependencies"])) == [("p", "a::b")]
    assert [r.line for r in A.residue(view).collect()] == [7]
    assert [r.body for r in A.blocks(view, "mermaid").collect()] == ["graph TD"]
    got = view.select(F.explode(T.citations(F.col("text"))).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [("src/a.rs", 3, 9)]


def test_judgments(spark):
    j = spark.createDataFrame([("m", 0, 1), ("m", 1, -1), ("m", 2, 1), ("m", 3, 1), ("n", 0, 0), ("n", 1, -1)], "module string, round int, judgment int")
    assert rows(M.majority(j, "module")) == [("m", 1), ("n", 0)]
    assert rows(M.flip_rates(j, "module")) == [("m", 0.25, 0.5), ("n", 0.5, 1.0)]
    empty = spark.createDataFrame([], "a int, b int")
    assert M.cohen_kappa(empty).first().kappa == 0.0
    assert M.coverage(spark.createDataFrame([], "name string"), spark.createDataFrame([("x",)], "text string")).first().ratio == 1.0


def test_flush_rules(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    at = [0, 1, 1.5, 4, 5, 6, 7, 8, 9.5, 20]
    e = spark.createDataFrame([("s", t0 + timedelta(seconds=s), i) for i, s in enumerate(at)], "stream string, ts timestamp, seq long")
    assert [(r.first, r.last) for r in W.flushes(e, 2, 5).orderBy("flush").collect()] == [(0, 2), (3, 7), (8, 8), (9, 9)]
    x = spark.createDataFrame([("a", "Created", 1), ("a", "Deleted", 2), ("b", "Modified", 3)], "path string, kind string, seq long")
    assert rows(W.groups(W.fold(x))) == [("Deleted", ["a"]), ("Modified", ["b"])]
    assert rows(W.fold_batch(x)) == [("a", "Deleted"), ("b", "Modified")]


def test_stream_holds_events_until_quiet(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"stream":"s","path":"p","kind":"Created"}\n{"stream":"s","path":"p","kind":"Deleted"}\n{"stream":"s","path":"q","kind":"Modified"}\n')
    stream = spark.readStream.schema("stream string, path string, kind string").json(str(src))
    q = W.hold(stream, 300, 1000).writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(100):
            if (got := spark.table("held").collect()):
                break
            q.awaitTermination(0.3)
    finally:
        q.stop()
    assert sorted((r.kind, r.paths) for r in got) == [("Deleted", ["p"]), ("Modified", ["q"])]
