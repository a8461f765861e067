"""Relations of a code graph: containment, calls, imports, modules, dependencies, cohesion, communities, impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import links as L
from skein.operators.links import Links
from skein.sources.scratch import Scratch


def module_chain(paths: DataFrame, path: str = "path") -> DataFrame:
    """(prefix, parent, depth) for every distinct directory prefix of the paths; the first level has the parent ''."""
    s = F.filter(F.split(T.directory(F.col(path)), "/"), lambda x: x != "")
    p = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_join(F.slice(s, F.lit(1), i), "/"))).alias("prefix")).distinct()
    return p.select("prefix", F.regexp_extract("prefix", "^(.*)/[^/]*$", 1).alias("parent"), (F.size(F.split("prefix", "/"))).cast("long").alias("depth"))


def call_links(entities: DataFrame) -> Links:
    """Links of entities (id, name, kind, body; an id is one entity's): names that a parenthesis follows in a function's body, each once, lead to every entity of that name; the own name is no call."""
    calls = entities.where(F.col("kind").isin("fn", "function")).select(F.col("id").alias("node"), F.col("name").alias("own"), F.explode(T.call_names(F.col("body"))).alias("key"))
    kind, zero = F.lit("Calls").alias("kind"), F.lit(0).cast("long")
    outs = calls.where("key <> own").select("node", kind, "key", zero.alias("upto")).distinct()
    return Links(outs, entities.where("name is not null").select(F.col("id").alias("node"), kind, F.col("name").alias("key"), zero.alias("start")).distinct())


def call_edges(entities: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(src, dst): the calls among entities, written out; pairs in `linked` are none."""
    out = L.pairs(call_links(entities)).select("src", "dst")
    return out if linked is None else out.join(linked, ["src", "dst"], "left_anti")


def import_edges(imports: DataFrame, nodes: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(src, dst) of imports (src, upto, target) against nodes (id, name, path): the last :: segment names nodes made so far (id <= upto); where it
    names none, the node with the smallest path that ends in the target's path."""
    i = imports.withColumn("last", F.element_at(F.split("target", "::"), -1)).withColumn("tail", F.replace("target", F.lit("::"), F.lit("/")))
    by_name = i.join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("last")), "last").where("dst <= upto and dst <> src").select("src", "target", "dst")
    rest = i.join(by_name.select("src", "target").distinct(), ["src", "target"], "left_anti")
    bare = F.split(F.regexp_replace("path", r"\.[^./]+$", ""), "/")
    tails = nodes.select(F.col("id").alias("dst"), "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(bare)), lambda n: F.array_join(F.slice(bare, -n, n), "/"))).alias("tail"))
    by_path = rest.join(tails, "tail").where("dst <= upto and dst <> src").groupBy("src", "target").agg(F.min_by("dst", F.struct("path", "dst")).alias("dst"))
    out = by_name.union(by_path).select("src", "dst").distinct()
    return out if linked is None else out.join(linked, ["src", "dst"], "left_anti")


def impl_edges(impls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): entities (id, name, upto) named 'impl T for U' and the nodes named T made so far."""
    kind = F.lit("Implements").alias("kind")
    outs = impls.select(F.col("id").alias("node"), kind, T.impl_target(F.col("name")).alias("key"), "upto").where("key <> ''").groupBy("node", "kind", "key").agg(F.max("upto").alias("upto"))
    ins = nodes.where("name is not null").select(F.col("id").alias("node"), kind, F.col("name").alias("key"), F.col("id").alias("start")).distinct()
    return L.pairs(Links(outs, ins)).where("src <> dst").select("src", "dst")


def call_counts(entities: DataFrame) -> DataFrame:
    """(caller, callee, n): calls among entities by the names at their ends, without writing them out."""
    links, named = call_links(entities), entities.select(F.col("id").alias("node"), F.col("name").alias("caller"))
    out = links.outs.join(named, "node").groupBy("caller", F.col("key").alias("callee")).agg(F.count("*").alias("n"))
    into = entities.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("m"))
    return out.join(into, "callee").select("caller", "callee", (F.col("n") * F.col("m")).alias("n"))


def _call_runs(counts: DataFrame) -> DataFrame:
    """(name, callers, callees): runs (x, n) of the sorted names at the other ends of calls (caller, callee, n); null where there are none."""

    def ends(own: str, other: str, name: str) -> DataFrame:
        sums = counts.groupBy(own, other).agg(F.sum("n").cast("int").alias("n"))
        return sums.groupBy(F.col(own).alias("name")).agg(F.sort_array(F.collect_list(F.struct(F.col(other).alias("x"), "n"))).alias(name))

    return ends("callee", "caller", "callers").join(ends("caller", "callee", "callees"), "name", "full")


def call_index(counts: DataFrame) -> DataFrame:
    """(name, callers, callees): sorted names at the other ends of calls (caller, callee, n), repeats kept."""
    # repeats are written out in the last step, so that they are neither shuffled nor sorted, and in as many tasks as there are partitions: by bytes the runs would be merged into one
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeated = lambda c: F.coalesce(F.flatten(F.transform(c, lambda r: F.array_repeat(r["x"], r["n"]))), F.array().cast("array<string>")).alias(c)
    return _call_runs(counts).repartition(parts, "name").select("name", repeated("callers"), repeated("callees"))


#: Times its bytes that a row of texts takes while it is written: the texts, and a row's buffer, which doubles.
ROW_SPACE = 4


def row_tasks(widest: int, memory: int, parts: int) -> int:
    """How many tasks, at most `parts`, may write rows of `widest` bytes at once in so many bytes of memory."""
    return max(1, min(parts, memory // max(1, ROW_SPACE * widest)))


def call_texts(counts: DataFrame) -> DataFrame:
    """(name, callers, callees): the same with the names joined by commas, without a list of them: a run is one text from the start, so a row takes a few times its own bytes.

    Rows that few executors can hold at once are written by as few tasks.
    """
    spark = counts.sparkSession
    runs = Scratch(spark, "calls").save(_call_runs(counts))
    size = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda s, r: s + r["n"] * (F.octet_length(r["x"]) + 1).cast("long")), F.lit(0).cast("long"))
    widest = runs.agg(F.max(size(F.filter("callers", lambda r: r["x"].isNotNull())) + size(F.filter("callees", lambda r: r["x"].isNotNull())))).first()[0]
    context = spark.sparkContext._jsc.sc()
    # block managers: the executors' and the driver's, which is the only one where it runs the tasks itself
    managers = context.getExecutorMemoryStatus().values().toSeq()
    memory = managers.apply(0)._1() if managers.size() == 1 else (managers.size() - 1) * context.conf().getSizeAsBytes("spark.executor.memory", "1g") * 6 // 10
    parts = row_tasks(widest or 0, memory, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a run is the first name, filled up to its length by pieces of many
    run = lambda r: F.rpad(r["x"], F.length(r["x"]) * r["n"] + r["n"] - 1, F.repeat(F.concat(F.lit(","), r["x"]), F.lit(1024)))

    def text(c: str) -> Column:
        named = F.filter(c, lambda r: r["x"].isNotNull())
        # one run is not copied into a text of its own
        return F.coalesce(F.when(F.size(named) == 1, run(F.element_at(named, 1))).otherwise(F.concat_ws(",", F.transform(named, run))), F.lit("")).alias(c)

    return runs.repartition(parts, "name").select("name", text("callers"), text("callees"))


def _ends(edges: DataFrame, members: DataFrame) -> DataFrame:
    m = members.select("node", "module")
    return edges.join(m.select(F.col("node").alias("src"), F.col("module").alias("a")), "src").join(m.select(F.col("node").alias("dst"), F.col("module").alias("b")), "dst")


def module_dependencies(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): distinct pairs of modules that edges (src, dst) join, over members (node, module)."""
    return _ends(edges, members).where("a <> b").select("a", "b").distinct()


def dependency_lists(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(module, uses, used_by) for every module, sorted, empty where there is none."""
    return listed(module_dependencies(edges, members), members)


def listed(d: DataFrame, members: DataFrame) -> DataFrame:
    """The same of distinct dependencies (a, b)."""
    none = F.array().cast("array<string>")
    uses = d.groupBy(F.col("a").alias("module")).agg(F.sort_array(F.collect_set("b")).alias("uses"))
    used = d.groupBy(F.col("b").alias("module")).agg(F.sort_array(F.collect_set("a")).alias("used_by"))
    out = members.select("module").distinct().join(uses, "module", "left").join(used, "module", "left")
    return out.select("module", F.coalesce("uses", none).alias("uses"), F.coalesce("used_by", none).alias("used_by"))


def reading_order(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(module, used_by, place): modules by how many others use them, most first, then by name."""
    n = module_dependencies(edges, members).groupBy(F.col("b").alias("module")).agg(F.count("*").alias("n"))
    out = members.select("module").distinct().join(n, "module", "left").select("module", F.coalesce("n", F.lit(0)).alias("used_by"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("used_by").desc(), "module")).cast("long"))


def module_call_counts(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, n): edges between modules, those inside one included."""
    return _ends(edges, members).groupBy("a", "b").agg(F.count("*").alias("n"))


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(module, internal, external, cohesion, coupling); an edge between modules is external for both, shares of nothing are 0."""
    e = _ends(edges, members)
    side = e.where("a = b").select(F.col("a").alias("module"), F.lit(1).alias("i"), F.lit(0).alias("x"))
    side = side.union(e.where("a <> b").select("a", F.lit(0), F.lit(1))).union(e.where("a <> b").select("b", F.lit(0), F.lit(1)))
    n = members.select("module").distinct().join(side.groupBy("module").agg(F.sum("i").alias("internal"), F.sum("x").alias("external")), "module", "left").na.fill(0, ["internal", "external"])
    total = F.col("internal") + F.col("external")
    share = lambda c: F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.col(c) / total, 6))
    return n.select("module", "internal", "external", share("internal").alias("cohesion"), share("external").alias("coupling"))


def file_edges(edges: DataFrame, files: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(s, t, weight): edges (src, dst, kind) lifted to files (node, file, domain); those inside a file or between domains are dropped."""
    f = files.select("node", "file", "domain")
    e = edges.join(f.select(F.col("node").alias("src"), F.col("file").alias("s"), F.col("domain").alias("ds")), "src").join(f.select(F.col("node").alias("dst"), F.col("file").alias("t"), F.col("domain").alias("dt")), "dst")
    w = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in weights.items()], F.lit(0.0))
    return e.where("s <> t and ds = dt").groupBy("s", "t").agg(F.round(F.sum(w), 6).alias("weight"))


def neighbor_jaccard(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, jaccard) of pairs (a, b): the share of neighbours in edges (node, neighbor) that both have of those that either has; 0 without any."""
    e = edges.select("node", "neighbor").distinct()
    size = e.groupBy("node").agg(F.count("*").alias("k"))
    p = pairs.select("a", "b").distinct()
    both = p.join(e.select(F.col("node").alias("a"), "neighbor"), "a").join(e.select(F.col("node").alias("b"), "neighbor"), ["b", "neighbor"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    out = p.join(both, ["a", "b"], "left").join(size.select(F.col("node").alias("a"), F.col("k").alias("ka")), "a", "left").join(size.select(F.col("node").alias("b"), F.col("k").alias("kb")), "b", "left")
    return out.select("a", "b", F.coalesce(F.round(F.col("n") / (F.col("ka") + F.col("kb") - F.col("n")), 6), F.lit(0.0)).alias("jaccard"))


def directory_communities(files: DataFrame, most: int = 20) -> DataFrame:
    """(path, community, place): files (path) by directory, /common folded into its parent; communities of more than `most` files fall into
    their plain directories; places by size, largest first, then smallest path."""
    f = files.select("path", T.cluster_directory(F.col("path")).alias("c"))
    f = f.withColumn("community", F.when(F.count("*").over(Window.partitionBy("c")) > most, T.directory(F.col("path"))).otherwise(F.col("c")))
    n = f.groupBy("community").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    n = n.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "first")).cast("long"))
    return f.join(n.select("community", "place"), "community").select("path", "community", "place")


def community_names(members: DataFrame) -> DataFrame:
    """(community, name) of members (community, path): the longest directory prefix that all share, else the most frequent directory (ties: the greater)."""
    d = members.select("community", T.directory(F.col("path")).alias("dir"))
    s = F.split("dir", "/")
    n = d.groupBy("community").agg(F.count("*").alias("n"))
    p = d.select("community", F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_join(F.slice(s, F.lit(1), i), "/"))).alias("prefix"))
    p = p.groupBy("community", "prefix").agg(F.count("*").alias("k")).join(n, "community").where("k = n").groupBy("community").agg(F.max_by("prefix", F.length("prefix")).alias("common"))
    often = d.groupBy("community", "dir").agg(F.count("*").alias("k")).groupBy("community").agg(F.max_by("dir", F.struct("k", "dir")).alias("often"))
    return often.join(p, "community", "left").select("community", F.coalesce("common", "often").alias("name"))


def impact(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, node, hops): nodes within `depth` steps of each start, edges taken both ways; the start itself at 0."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).union(edges.select("dst", "src")).distinct()
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("hops"))
    front = seen
    for hop in range(1, depth + 1):
        front = front.join(both, "node").select("start", F.col("next").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop).cast("long"))
        seen = seen.union(front)
    return seen


def callers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that call one of `nodes` (node), one step back."""
    return edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()


def cycles(edges: DataFrame, checkpoint_every: int = 1) -> DataFrame:
    """(node, cycle): nodes of strongly connected components of more than one node; cycle is the smallest node of its component.

    Each round gives every node the largest node that reaches it; nodes that the bearer of that mark is reached from, within the mark, are a component
    and leave the graph. Rounds end when no edge is left.
    """
    left = edges.where("src <> dst").select("src", "dst").distinct().checkpoint()
    found = None
    while not left.isEmpty():
        mark = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("m", F.col("node")).checkpoint()
        while True:
            pushed = left.join(mark.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("m").alias("p"))
            new = mark.join(pushed, "node", "left").select("node", F.greatest("m", F.coalesce("p", "m")).alias("m")).checkpoint()
            changed = new.join(mark.withColumnRenamed("m", "old"), "node").where("m <> old").isEmpty()
            mark = new
            if changed:
                break
        inside = left.join(mark.withColumnsRenamed({"node": "src", "m": "a"}), "src").join(mark.withColumnsRenamed({"node": "dst", "m": "b"}), "dst").where("a = b").select("src", "dst", "a")
        inside = inside.checkpoint()
        reach = mark.where("node = m").select("node", "m").checkpoint()
        while True:
            more = inside.join(reach.select(F.col("node").alias("dst"), F.col("m").alias("a")), ["dst", "a"]).select(F.col("src").alias("node"), F.col("a").alias("m")).distinct()
            more = more.join(reach, ["node", "m"], "left_anti").checkpoint()
            if more.isEmpty():
                break
            reach = reach.union(more).checkpoint()
        part = reach.groupBy("m").agg(F.min("node").alias("cycle"), F.count("*").alias("n")).where("n > 1").join(reach, "m").select("node", "cycle")
        found = part if found is None else found.union(part)
        left = left.join(reach.select(F.col("node").alias("src")), "src", "left_anti").join(reach.select(F.col("node").alias("dst")), "dst", "left_anti").checkpoint()
    return found if found is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("cycle")).limit(0)
