import random

from pyspark.sql import functions as F

from skein import registry
from skein.operators import codegraph as C
from skein.operators import links as L
from skein.operators import ownership as O
from skein.plans import audit, metrics, rendering


def by_pairs(rest, keys):
    """Every importer against every file of the paths that end in its target."""
    out = set()
    for file, target in rest:
        parts = target.split("::")
        seen = [(tuple(k), rank, i) for k, rank, i in keys if i >> 24 <= file and len(k) >= len(parts) and k[-len(parts) :] == parts]
        if seen:
            key = min(k for k, _, _ in seen)
            entity = max((i for k, r, i in seen if k == key and r == 2), default=None)
            own = min((i for k, r, i in seen if k == key and r == 1 and (entity is None or i > entity)), default=None)
            chain = min((i for k, r, i in seen if k == key and r == 0), default=None)
            out.add((file, next(x for x in (own, entity, chain) if x is not None)))
    return out


def test_imports_by_path_do_not_meet_all_files_of_the_path(spark):
    """F8 code_graph_edges, F10 impact_semantic, F16 update_scope."""
    r = random.Random(3)
    rest = [(f, "::".join(r.choice("abc") for _ in range(r.randint(1, 3)))) for f in range(1, 60)]
    keys = [([r.choice("abc") for _ in range(r.randint(1, 3))], rank, (f << 24) + (1024 + 9 * (rank == 2) if rank else 2)) for f in range(1, 60) for rank in (1, 2, 0) if r.random() < 0.5]
    got = C._by_path(spark.createDataFrame(rest, "file long, target string"), spark.createDataFrame(keys, "key array<string>, rank int, id long"))
    assert {tuple(x) for x in got.collect()} == by_pairs(rest, keys)
    # one path with many files and many importers of it: rows stay as many as these
    n = 20_000
    files = spark.range(1, n + 1).select("id", F.array(F.lit("src"), F.lit("m")).alias("key"), F.lit(1).alias("rank"), F.expr("(id << 24) + 1024").alias("at"))
    x = C._by_path(files.select(F.col("id").alias("file"), F.lit("src::m").alias("target")), files.select("key", "rank", F.col("at").alias("id")))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert x.agg(F.count("*"), F.count_distinct("dst")).first() == (n, 1)


def test_spans_become_runs(spark):
    """F36 entity_ownership: many citations of one page are few runs."""
    r = random.Random(4)
    spans = [(p, a, a + r.randint(0, 3)) for p in "ab" for a in (r.randint(1, 60) for _ in range(25))]
    runs = [tuple(x) for x in O._runs(spark.createDataFrame(spans, "page string, start int, end int"), "page").collect()]
    meets = lambda of, p, a, b: any(q == p and s <= b and e >= a for q, s, e in of)
    assert all(meets(runs, p, a, b) == meets(spans, p, a, b) for p in "abc" for a in range(70) for b in range(a, 70))
    assert all(not (p == q and s <= b + 1 and a <= e + 1) for i, (p, a, b) in enumerate(runs) for q, s, e in runs[:i])
    many = spark.range(10_000).selectExpr("'a' as page", "cast(id % 60 + 1 as int) as start", "cast(id % 60 + 3 as int) as end")
    assert [tuple(x) for x in O._runs(many, "page").collect()] == [("a", 1, 62)]


def test_ownership_is_counted_in_one_pass(spark, monkeypatch):
    """F35 lint_union_histogram."""
    for _, _, name in audit._CHECKS:
        monkeypatch.setitem(registry._QUERIES, name, lambda s, d: s.range(2).selectExpr("id as page"))
    monkeypatch.setitem(registry._QUERIES, "entity_ownership", lambda s, d: s.range(7).selectExpr("id as page", "case when id < 3 then 'entity-ownership' else 'entity-coverage' end as kind", "case when id % 2 = 0 then 'Error' else 'Warning' end as severity"))
    x = audit.lint_union_histogram(spark, "")
    got = {(r["kind"], r["severity"]): r["n"] for r in x.collect()}
    assert {k: n for k, n in got.items() if k[0] in ("entity-ownership", "entity-coverage")} == {("entity-ownership", "Error"): 2, ("entity-ownership", "Warning"): 1, ("entity-coverage", "Error"): 2, ("entity-coverage", "Warning"): 2}
    assert x._jdf.queryExecution().analyzed().toString().count("Range (0, 7") == 1


def test_answers_are_dealt_to_all_tasks(spark, tmp_path):
    """F29 score_pairs: one file with one part of rows is not read in one task."""
    spark.range(100).selectExpr("id as event_id", "id % 9 as user_id", "'x' as event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert metrics._scored(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_diagram_tells_no_pairs_apart(spark):
    """F32 dependency_diagram: rows after the join of lines and orders are nations times suppliers at most."""
    plan = rendering.dependency_diagram(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a#" in plan and "Aggregate [src#" not in plan and "Aggregate [o_custkey#" not in plan


def test_nodes_of_one_rubric_are_there_at_once(spark, monkeypatch):
    """F38 rubric_leaves: a batch of many large answers is given out in pieces."""
    answers = spark.createDataFrame([(t, '```json\n{"rubrics": [{"requirement": "r", "sub_tasks": [' + ", ".join(f'{{"requirement": "c{i}", "weight": 2}}' for i in range(n)) + "]}]}\n```") for t, n in ((1, 7), (2, 3), (3, 0))] + [(4, "none"), (5, None)], "tree long, text string")
    monkeypatch.setattr(metrics.M, "CHUNK", 3)
    got = metrics.M.rubric_nodes(answers).collect()
    assert sorted((r["tree"], r["node"], r["parent"], r["level"], r["weight"], r["requirement"]) for r in got if r["node"]) == sorted((t, i + 1, 0, 1, 2.0, f"c{i}") for t, n in ((1, 7), (2, 3)) for i in range(n))
    assert len(got) == 13
    made = {}
    monkeypatch.setattr(type(answers), "mapInArrow", lambda df, run, types: made.setdefault("run", run))
    metrics.M.rubric_nodes(answers)
    assert max(b.num_rows for b in made["run"](iter(answers.toArrow().to_batches()))) == 3


def test_sources_and_targets_of_a_name_are_not_repeated_for_each_other(spark):
    """F2 impl_edges, F5 code_graph_edges: what makes the pairs grows with their root, once to the tasks and without a second shuffle."""
    context = spark.sparkContext

    def shuffled():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    n, m, most = 500, 3000, 10_000
    rows = lambda k, c: spark.range(k).select(F.col("id").alias("node"), F.lit("Calls").alias("kind"), F.lit("f").alias("key"), (F.col("id") % 7).alias(c))
    links = L.Links(rows(n, "upto"), rows(m, "start"))
    before = shuffled()
    got = L.pairs(links, most).agg(F.count("*"), F.sum(F.col("src") * m + F.col("dst"))).first()
    # far fewer than a row of each target in every slice of sources would be
    assert shuffled() - before < 40_000 < m * (n * m // most)
    want = [a * m + b for a in range(n) for b in range(m) if a % 7 >= b % 7]
    assert got == (len(want), sum(want))
