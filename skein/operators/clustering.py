"""Communities of files and features of entities by the constant Potts model, deterministic."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import graph as G
from skein.sources.scratch import Scratch

#: Nodes and links of a graph that one task takes as a group.
MOST_NODES, MOST_LINKS = 100_000, 1_000_000
GAMMA, FEATURE_GAMMA = 0.5, 0.4


def potts(edges: dict[int, dict[int, float]], nodes: list[int], gamma: float, sizes: dict[int, int] | None = None) -> dict[int, int]:
    """Community of each node: local moves by gain in sum(w - gamma) over pairs, nodes in order, then the same on communities until nothing moves."""
    community = {n: n for n in nodes}
    size, links = sizes or {n: 1 for n in nodes}, {n: dict(edges.get(n, {})) for n in nodes}
    while True:
        own = {n: n for n in links}
        members = dict(size)
        moved = True
        while moved:
            moved = False
            for n in sorted(links):
                to: dict[int, float] = {}
                for m, w in links[n].items():
                    if m != n:
                        to[own[m]] = to.get(own[m], 0.0) + w
                here = own[n]
                base = to.get(here, 0.0) - gamma * size[n] * (members[here] - size[n])
                best, where = base, here
                for c in sorted(to):
                    if c != here and (gain := to[c] - gamma * size[n] * members[c]) > best + 1e-12:
                        best, where = gain, c
                if where != here:
                    own[n], moved = where, True
                    members[here] -= size[n]
                    members[where] += size[n]
        if all(own[n] == n for n in own):
            return community
        names = {}
        for n in sorted(own):
            names.setdefault(own[n], n)  # a community is named by its smallest node
        community = {n: names[own[c]] for n, c in community.items()}
        new_links: dict[int, dict[int, float]] = {c: {} for c in names.values()}
        new_size = dict.fromkeys(names.values(), 0)
        for n, around in links.items():
            a = names[own[n]]
            new_size[a] += size[n]
            for m, w in around.items():
                b = names[own[m]]
                new_links[a][b] = new_links[a].get(b, 0.0) + w
        size, links = new_size, new_links


def _grouped(edges: DataFrame, nodes: DataFrame, gamma: float, by: str) -> DataFrame:
    """(by, node, community): each project of edges (by, s, t, weight) and nodes (by, node, size) in one task."""

    def run(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        around: dict[int, dict[int, float]] = {}
        for s, t, w in zip(links["s"], links["t"], links["weight"], strict=True):
            if s != t:
                for a, b in ((s, t), (t, s)):
                    around.setdefault(a, {})[b] = around.setdefault(a, {}).get(b, 0.0) + w
        found = potts(around, sorted(set(own["node"])), gamma, dict(zip(own["node"], own["size"], strict=True)))
        return pd.DataFrame({by: [key[0]] * len(found), "node": list(found), "community": list(found.values())})

    schema = f"{by} {nodes.schema[by].dataType.simpleString()}, node long, community long"
    own_nodes = nodes.select(F.col(by).alias("own_by"), "node", "size")  # a name of its own: edges and nodes may stem from one table
    return own_nodes.groupBy("own_by").cogroup(edges.groupBy(by)).applyInPandas(run, schema)


def partition(edges: DataFrame, nodes: DataFrame, gamma: float, by: str = "project", most_nodes: int = MOST_NODES, most_links: int = MOST_LINKS) -> DataFrame:
    """(by, node, community) of edges (by, s, t, weight) and nodes (by, node: long); communities are named by their smallest node.

    A project of at most `most_nodes` nodes and `most_links` edges is one task's group; larger ones are refined by distributed moves, level by level, until their communities are as
    few. Weights are taken not to be negative.
    """
    nodes = nodes.select(by, "node").distinct().withColumn("size", F.lit(1).cast("long"))
    n = nodes.groupBy(by).agg(F.count("*").alias("nodes"))
    large = n.join(edges.groupBy(by).agg(F.count("*").alias("links")), by, "left").where(f"nodes > {most_nodes} or links > {most_links}").select(by)
    if large.isEmpty():
        return _grouped(edges, nodes, gamma, by)
    inside = lambda df, how: df.join(large, by, how)
    return _grouped(inside(edges, "left_anti"), inside(nodes, "left_anti"), gamma, by).unionByName(_levels(inside(edges, "left_semi"), inside(nodes, "left_semi"), gamma, by, most_nodes, most_links))


#: Nodes that enter or leave one community in one round of moves; the others of those that would wait for the next rounds.
ADMITTED = 1000
#: Rounds of moves of a level at most, and the share of moving nodes below which two rounds in a row end one.
ROUNDS, STILL = 24, 0.001


def _moves(links: DataFrame, state: DataFrame, gamma: float, number: int) -> DataFrame:
    """(p, n, to): moves that don't lower the sum of (w - gamma) over pairs inside communities, all made at once.

    Half of the nodes, by hash, may move; what they see of a community is its weight by nodes that don't move now. Those that enter or leave a community are ordered by their
    advantage, and each reckons with the sizes of all before it, so the gains add up whoever else moves.
    """
    turn = lambda n: F.pmod(F.xxhash64("p", n, F.lit(number // 2)), F.lit(2)) == number % 2
    members = state.groupBy("p", "c").agg(F.sum("size").alias("members"))
    seen = links.where(turn("s")).join(state.select("p", F.col("n").alias("t"), F.col("c").alias("to")), ["p", "t"])
    seen = seen.groupBy("p", F.col("s").alias("n"), "to").agg(F.sum("w").alias("all"), F.sum(F.when(~turn("t"), F.col("w")).otherwise(0.0)).alias("still"))
    own = state.where(turn("n")).join(members, ["p", "c"]).select("p", "n", "size", "c", F.col("members").alias("mine"))
    seen = seen.join(own, ["p", "n"]).join(members.select("p", F.col("c").alias("to"), "members"), ["p", "to"])
    gain = F.col("still") - gamma * F.col("size") * F.col("members")
    best = seen.groupBy("p", "n", "size", "c", "mine").agg(
        F.coalesce(F.max(F.when(F.col("to") == F.col("c"), F.col("all"))), F.lit(0.0)).alias("kept"),
        F.max(F.when((F.col("to") != F.col("c")) & (F.col("still") > 0), F.struct(gain.alias("gain"), (-F.col("to")).alias("to")))).alias("best"),
    )
    plus = F.col("best.gain") - (F.col("kept") - gamma * F.col("size") * (F.col("mine") - F.col("size")))
    out = best.where("best is not null").select("p", "n", "size", "c", (-F.col("best.to")).alias("to"), F.round(plus, 9).alias("plus")).where("plus > 1e-9")
    for side in ("to", "c"):
        order = Window.partitionBy("p", side).orderBy(F.col("plus").desc(), "n")
        before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ADMITTED).withColumn("plus", F.col("plus") - gamma * F.col("size") * before).where("plus > 1e-9")
    return out.select("p", "n", "to")


def _settled(scratch: Scratch, links: DataFrame, state: DataFrame, gamma: float, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """(state after rounds of moves, how many were made)."""
    total, few, n = 0, 0, state.count()
    for number in range(rounds):
        moves = scratch.save(_moves(links, state, gamma, number))
        made = moves.count()
        few = few + 1 if made <= STILL * n else 0
        if made:
            new = scratch.save(state.join(moves, ["p", "n"], "left").select("p", "n", "size", F.coalesce("to", "c").alias("c")))
            scratch.drop(state)
            state, total = new, total + made
        scratch.drop(moves)
        if few == 2:
            break
    return state, total


def _levels(edges: DataFrame, nodes: DataFrame, gamma: float, by: str, most_nodes: int, most_links: int) -> DataFrame:
    """partition() by moves of single nodes, then of communities as nodes, until a project's communities are one task's group, and last of single nodes once more."""
    scratch = Scratch(nodes.sparkSession, "communities")
    e = edges.where("s <> t").select(F.col(by).alias("p"), F.col("s").cast("long").alias("s"), F.col("t").cast("long").alias("t"), F.col("weight").cast("double").alias("w"))
    first = links = scratch.save(e.union(e.select("p", "t", "s", "w")).groupBy("p", "s", "t").agg(F.sum("w").alias("w")))
    state = scratch.save(nodes.select(F.col(by).alias("p"), F.col("node").alias("n"), "size", F.col("node").alias("c")))
    whole = None  # (p, n, c): the community of each node so far
    while True:
        state, moved = _settled(scratch, links, state, gamma)
        up = state.select("p", "n", "c")
        whole = scratch.save(up if whole is None else whole.select("p", F.col("n").alias("first"), F.col("c").alias("n")).join(up, ["p", "n"]).select("p", F.col("first").alias("n"), "c"))
        to = lambda a, b: state.select("p", F.col("n").alias(a), F.col("c").alias(b))
        above = links.join(to("s", "cs"), ["p", "s"]).join(to("t", "ct"), ["p", "t"]).where("cs <> ct").groupBy("p", F.col("cs").alias("s"), F.col("ct").alias("t")).agg(F.sum("w").alias("w"))
        above = scratch.save(above)
        if links is not first:
            scratch.drop(links)
        nodes_above = scratch.save(state.groupBy("p", F.col("c").alias("n")).agg(F.sum("size").alias("size")).withColumn("c", F.col("n")))
        scratch.drop(state)
        links, state = above, nodes_above
        n = state.groupBy("p").agg(F.count("*").alias("nodes")).join(links.groupBy("p").agg(F.count("*").alias("links")), "p", "left")
        if not moved or n.where(f"nodes > {most_nodes} or links > 2 * {most_links}").isEmpty():
            break
    if moved:
        done = _grouped(links.where("s < t").select(F.col("p").alias(by), "s", "t", F.col("w").alias("weight")), state.select(F.col("p").alias(by), F.col("n").alias("node"), "size"), gamma, by)
        done = done.select(F.col(by).alias("p"), F.col("node").alias("c"), F.col("community").alias("to"))
        whole = scratch.save(whole.join(done, ["p", "c"]).select("p", "n", F.col("to").alias("c")))
    state, _ = _settled(scratch, first, scratch.save(whole.withColumn("size", F.lit(1).cast("long")).select("p", "n", "size", "c")), gamma)
    names = state.groupBy("p", "c").agg(F.min("n").alias("community"))
    return state.join(names, ["p", "c"]).select(F.col("p").alias(by), F.col("n").alias("node"), "community")


def communities(files: DataFrame, edges: DataFrame, gamma: float = GAMMA, few: int = 1, many: int = 24) -> DataFrame:
    """(path, community, place) of files (node, path) and weighted edges (s, t, weight) between their nodes.

    With at most `few` or at least `many` directories every directory is a community. Otherwise connected files below src fall into communities of the Potts
    model, and all other files into their directories; large communities are split by directory.
    """
    f = files.withColumn("dir", T.cluster_directory(F.col("path")))
    n = f.select("dir").distinct().limit(many).count()
    if n <= few or n >= many:
        return G.directory_communities(files.select("path"))
    src = f.where(T.top_domain(F.col("path")) == "src").select("node")
    inside = edges.join(src.select(F.col("node").alias("s")), "s", "left_semi").join(src.select(F.col("node").alias("t")), "t", "left_semi")
    linked = inside.select(F.explode(F.array("s", "t")).alias("node")).distinct()
    got = partition(inside.withColumn("project", F.lit(0)), linked.withColumn("project", F.lit(0)), gamma).select("node", F.concat(F.lit("c"), F.col("community").cast("string")).alias("c"))
    placed = f.join(got, "node", "left").select("path", "dir", F.coalesce("c", F.concat(F.lit("d"), "dir")).alias("c"))
    large = F.count("*").over(Window.partitionBy("c")) > 20
    placed = placed.withColumn("community", F.when(large, F.concat_ws(":", "c", "dir")).otherwise(F.col("c")))
    order = placed.groupBy("community").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    order = order.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "first")).cast("long"))
    return placed.join(order.select("community", "place"), "community").select("path", "community", "place")


def features(calls: DataFrame, jaccard: DataFrame, cosine: DataFrame, gamma: float = FEATURE_GAMMA) -> DataFrame:
    """(feature, node) of cross-file function calls (s, t), weighed by half of (0.5 + 0.5 * jaccard) and half the cosine (a, b, value; 0 without), in
    clusters of two or more, named in the order of their smallest node."""
    pair = calls.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).where("a <> b").distinct()
    w = pair.join(jaccard.select("a", "b", F.col("jaccard").alias("j")), ["a", "b"], "left").join(cosine.select("a", "b", F.col("value").alias("v")), ["a", "b"], "left")
    w = w.select(F.lit(0).alias("project"), F.col("a").alias("s"), F.col("b").alias("t"), (0.5 * (0.5 + 0.5 * F.coalesce("j", F.lit(0.0))) + 0.5 * F.coalesce("v", F.lit(0.0))).alias("weight"))
    nodes = w.select("project", F.explode(F.array("s", "t")).alias("node")).distinct()
    got = partition(w, nodes, gamma)
    n = got.groupBy("community").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n >= 2")
    n = n.withColumn("feature", F.concat(F.lit("feature_"), (F.row_number().over(Window.orderBy("first")) - 1).cast("string")))
    return got.join(n.select("community", "feature"), "community").select("feature", "node")


def unique_names(modules: DataFrame) -> DataFrame:
    """(id, name) of modules (id, name, stem): a name that came before takes '::' and the stem, one that still came before becomes module_<id>."""
    first = F.row_number().over(Window.partitionBy("name").orderBy("id")) == 1
    x = modules.withColumn("second", F.when(first, F.col("name")).otherwise(F.concat_ws("::", "name", "stem")))
    again = F.row_number().over(Window.partitionBy("second").orderBy((F.col("second") != F.col("name")).cast("int"), "id")) == 1
    return x.select("id", F.when(again, F.col("second")).otherwise(F.concat(F.lit("module_"), F.col("id").cast("string"))).alias("name"))
