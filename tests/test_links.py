from pyspark.sql import functions as F

from skein.operators import codegraph as C
from skein.operators import graph as G
from skein.operators import incremental as I
from skein.operators import links as L
from skein.sources.scratch import Scratch


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_pairs_are_dealt_in_slices(spark):
    e = spark.range(1, 401).selectExpr("id", "'n' || id % 3 as name", "'fn' as kind", "'n' || (id + 1) % 3 || '(1); n' || id % 3 || '(2)' as body")
    links = G.call_links(e)
    want = sorted((a, b) for a in range(1, 401) for b in range(1, 401) if (a + 1) % 3 == b % 3)
    for most in (10, 1000, L.PAIRS):
        assert rows(L.pairs(links, most).select("src", "dst")) == want
    # what makes the pairs stays as small as the entities
    assert links.outs.count() == links.ins.count() == 400
    assert G.call_counts(e).agg({"n": "sum"}).first()[0] == len(want)


def test_index_of_many_calls_keeps_repeats(spark):
    e = spark.range(1, 61).selectExpr("id", "'n' || id % 3 as name", "'fn' as kind", "'n' || (id + 1) % 3 || '(1)' as body")
    got = {r["name"]: (r["callers"], r["callees"]) for r in G.call_index(G.call_counts(e)).collect()}
    assert got == {f"n{k}": ([f"n{(k + 2) % 3}"] * 400, [f"n{(k + 1) % 3}"] * 400) for k in range(3)}


def _graph(spark):
    files = spark.createDataFrame([(1, "a/x.rs"), (2, "b/y.rs"), (3, "c/d/z.rs"), (4, "c/w.rs")], "file long, path string")
    ent = [(1, 0, "f", "fn", "g(1)"), (1, 1, "T", "trait", ""), (2, 0, "g", "fn", "f(1); g(2)"), (2, 1, "impl T for U", "impl", ""), (3, 0, "g", "fn", "h(1)"), (4, 0, "h", "fn", ""), (4, 1, "c", "mod", "")]
    entities = spark.createDataFrame([(f, p, n, k, 1, 2, b) for f, p, n, k, b in ent], "file long, pos int, name string, kind string, line_start int, line_end int, body string")
    imports = spark.createDataFrame([(2, "a::f"), (3, "x::g"), (3, "b::y"), (4, "c"), (4, "q::c"), (4, "d::z"), (1, "g"), (4, "u::g")], "file long, target string")
    return files, entities, imports


def test_links_are_the_edges(spark):
    files, entities, imports = _graph(spark)
    every, edges = map(Scratch(spark, "test").save, C.build(files, entities, imports))
    at = {(r["file"], r["name"]): r["id"] for r in every.collect()}
    got = rows(edges.where("kind = 'Imports'").select("src", "dst"))
    own = lambda f: f * 2**24 + 1024
    # 1: g is made later. 2: f of 1. 3: g of 2, its own is linked already, b::y is the last entity of 2. 4: both g, its directory c is made by 3, its own c is linked already, d::z is 3's g
    want = [(own(2), at[1, "f"]), (own(3), at[2, "g"]), (own(3), at[2, "impl T for U"]), (own(4), at[2, "g"]), (own(4), at[3, "g"]), (own(4), at[3, "c"])]
    assert got == sorted(want)
    links = C.use_links(files, entities, imports, every).save(Scratch(spark, "test"))
    members = every.where("line_start is not null or kind = 'File'").selectExpr("id as node", "name", "'m' || file % 3 as module")
    assert rows(L.modules(links, members)) == rows(G.module_dependencies(C.uses(edges), members))
    called = C.called(C.calls(edges), members, members).distinct()
    assert rows(C.called_names(links, members)) == rows(called)
    starts = every.where("file = 4").selectExpr("id as node")
    for depth in (1, 2):
        assert rows(L.reach(links, starts, depth)) == rows(L.reach(L.of_edges(C.uses(edges).selectExpr("src", "dst", "'x' as kind")), starts, depth))


def test_links_and_edges_have_the_same_impact(spark):
    files, entities, imports = _graph(spark)
    every, edges = map(Scratch(spark, "test").save, C.build(files, entities, imports))
    nodes = every.selectExpr("id as node", "path", "module")
    links = C.use_links(files, entities, imports, every).save(Scratch(spark, "test"))
    changed = spark.createDataFrame([("b/y.rs",), ("c/w.rs",)], "change string")
    for kind in ("BodyChanged", "SignatureChanged"):
        changes = spark.createDataFrame([("c/w.rs", kind)], "file string, change string")
        assert rows(I.impact_semantic(changed, changes, nodes, links)) == rows(I.impact_semantic(changed, changes, nodes, edges)) != []


def test_texts_of_calls_are_not_made_of_lists(spark):
    """F4 call_index: a run of a name is one text from the start; runs of one and of several names, names that are null, none at all."""
    counts = spark.createDataFrame([("a", "b", 3), ("ä", "b", 2), (None, "b", 2), ("a", None, 1), ("a", "c", 2500), ("", "d", 2), (None, "e", 1)], "caller string, callee string, n long")
    got = {r["name"]: (r["callers"], r["callees"]) for r in G.call_texts(counts).collect()}
    joined = G.call_index(counts).select("name", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))
    assert got == {r["name"]: (r["callers"], r["callees"]) for r in joined.collect()}
    assert got["b"] == ("a,a,a,ä,ä", "") and got["c"] == (",".join(["a"] * 2500), "") and got["d"] == (",", "") and got["e"] == ("", "")
    # a million repeats are a text of two million bytes and no list of names
    x = G.call_texts(spark.createDataFrame([("a", "b", 1_000_000)], "caller string, callee string, n long"))
    assert "array_repeat" not in x._jdf.queryExecution().executedPlan().toString()
    assert x.agg(F.max(F.length("callers")), F.max(F.length("callees"))).first() == (1_999_999, 1_999_999)


def test_wide_rows_are_written_by_few_tasks():
    assert G.row_tasks(15 << 20, 10 << 30, 200) == 170 and G.row_tasks(554 << 20, 10 << 30, 200) == 4
    assert G.row_tasks(2 << 30, 1 << 30, 200) == 1 and G.row_tasks(0, 1 << 30, 200) == 200
