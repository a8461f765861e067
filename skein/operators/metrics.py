"""Evaluation metrics: coverage, completeness, document facts, agreement of judgments, rubric scores."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import SPACE, json_slice
from skein.operators.phrases import phrase_hits
from skein.operators.retrieval import word_matches


def _share(n: Column, of: Column, empty: float) -> Column:
    return F.when(of == 0, F.lit(empty)).otherwise(F.round(n / of, 6))


def coverage(names: DataFrame, pages: DataFrame) -> DataFrame:
    """One row (total, found, ratio): distinct names (name) that some page (text) contains; without names the ratio is 1.

    A name without white space lies within one word, so the distinct words of all pages are asked once; other names are looked for on the pages by automata.
    """
    n = names.select("name").distinct()
    odd = F.col("name").rlike(SPACE)
    empty = n.where("name = ''").join(pages.where("text is not null").select("text").limit(1), F.lit(True)).select("name")  # one page that has a text holds it
    words = pages.select(F.explode(F.split("text", SPACE)).alias("word")).distinct()
    hit = word_matches(words, n.where(~odd & (F.col("name") != "")).withColumnRenamed("name", "keyword")).select(F.col("keyword").alias("name")).distinct()
    hit = hit.union(phrase_hits(pages.select(F.lit(0).alias("page"), "text"), n.where(odd).withColumnRenamed("name", "keyword")).select("keyword").distinct()).union(empty)
    return n.agg(F.count("*").alias("total")).join(hit.agg(F.count("*").alias("found")), F.lit(True), "cross").select("total", "found", _share(F.col("found"), F.col("total"), 1.0).alias("ratio"))


def completeness(ranked: DataFrame, wanted: DataFrame, pages: DataFrame, k: int = 10) -> DataFrame:
    """One row (total, hits, ratio): wanted (query, module) whose k best hits (query, module, rank) hold the module, if its page (module) exists."""
    ok = ranked.where(F.col("rank") <= k).select("query", "module").distinct().join(pages.select("module").distinct(), "module", "left_semi").withColumn("hit", F.lit(1))
    x = wanted.distinct().join(ok, ["query", "module"], "left").agg(F.count("*").alias("total"), F.count("hit").alias("hits"))
    return x.select("total", "hits", _share(F.col("hits"), F.col("total"), 1.0).alias("ratio"))


def doc_info(pages: DataFrame) -> DataFrame:
    """One row (pages, words, links, code_blocks, diagrams) of pages (text)."""
    ls = F.split("text", "\n", -1)
    fences = F.size(F.filter(ls, lambda x: F.ltrim(x).startswith("```")))
    return pages.select(F.size(F.filter(F.split("text", r"[ \t\r\n\f]+"), lambda x: x != "")).alias("w"), F.regexp_count("text", F.lit(r"\]\(")).alias("l"), F.ceil(fences / 2).alias("c"), F.size(F.filter(ls, lambda x: F.trim(x) == "```mermaid")).alias("d")).agg(
        F.count("*").alias("pages"), F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("words"), F.coalesce(F.sum("l"), F.lit(0)).cast("long").alias("links"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("code_blocks"), F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("diagrams")
    )


def kappa_table(judgments: DataFrame) -> DataFrame:
    """One row (n11, n10, n01, n00) of judgments (a, b) in 0 and 1."""
    n = lambda a, b: F.count_if((F.col("a") == a) & (F.col("b") == b)).alias(f"n{a}{b}")
    return judgments.agg(n(1, 1), n(1, 0), n(0, 1), n(0, 0))


def cohen_kappa(judgments: DataFrame) -> DataFrame:
    """One row (kappa): agreement of two raters beyond chance; 0 without judgments or where chance agreement is complete."""
    t = kappa_table(judgments).withColumn("n", (F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")).cast("double"))
    po = F.try_divide(F.col("n11") + F.col("n00"), "n")
    a, b = F.try_divide(F.col("n11") + F.col("n10"), "n"), F.try_divide(F.col("n11") + F.col("n01"), "n")
    pe = a * b + (1 - a) * (1 - b)
    return t.select(F.when((F.col("n") == 0) | (pe >= 1), F.lit(0.0)).otherwise(F.round((po - pe) / (1 - pe), 6)).alias("kappa"))


def chance_corrected(agreement: Column) -> Column:
    """(po - pe) / (1 - pe) with pe = po^2 + (1 - po)^2, not below 0."""
    pe = agreement * agreement + (1 - agreement) * (1 - agreement)
    return F.when(pe >= 1, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (agreement - pe) / (1 - pe)))


def majority(judgments: DataFrame, by: str) -> DataFrame:
    """(by, judgment) of judgments in -1, 0 and 1: the most frequent; ties prefer 1, then 0."""
    n = judgments.groupBy(by, "judgment").agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.max_by("judgment", F.struct("n", "judgment")).alias("judgment"))


def flip_rates(judgments: DataFrame, by: str) -> DataFrame:
    """(by, minority, adjacent): share of judgments (round) that differ from the majority, and of the pairs of rounds 2i and 2i + 1 whose signs differ."""
    j = judgments.join(majority(judgments, by).withColumnRenamed("judgment", "most"), by)
    m = j.groupBy(by).agg(F.round(F.avg((F.col("judgment") != F.col("most")).cast("double")), 6).alias("minority"))
    p = judgments.withColumn("pair", F.floor(F.col("round") / 2)).groupBy(by, "pair").agg(F.count("*").alias("n"), F.min("judgment").alias("lo"), F.max("judgment").alias("hi")).where("n = 2")
    p = p.groupBy(by).agg(F.round(F.avg((F.col("lo") != F.col("hi")).cast("double")), 6).alias("adjacent"))
    return m.join(p, by, "left").na.fill(0.0, ["adjacent"])


def tie_rate(judgments: DataFrame) -> DataFrame:
    return judgments.agg(F.count("*").alias("n"), F.round(F.avg((F.col("judgment") == 0).cast("double")), 6).alias("ties"))


def module_std(scores: DataFrame, by: str, dims: list[str]) -> DataFrame:
    """(by, std): the root of the mean population variance over the dimensions."""
    v = scores.groupBy(by).agg(*[F.var_pop(d).alias(d) for d in dims])
    return v.select(by, F.round(F.sqrt(sum((F.col(d) for d in dims), F.lit(0.0)) / len(dims)), 6).alias("std"))


def pairwise_agreement(scores: DataFrame, by: str, dims: list[str], within: float = 1.0) -> DataFrame:
    """(by, pairs, agreement): of all scores of two rounds, every dimension against every other, the share that differ by at most `within`.

    Pairs are counted from how often each value occurs: those of all scores less those of one round with itself. Values meet by ranges of length `within`.
    """
    d = len(dims)
    near = lambda x, y: (F.abs(x - y) <= within).cast("long")
    own = sum((near(F.col(x), F.col(y)) for x in dims for y in dims), F.lit(0))
    rounds = scores.groupBy(by).agg(F.count("*").alias("rounds"), F.sum(own).alias("own"))
    values = scores.select(by, F.explode(F.array(*dims)).alias("s")).groupBy(by, "s").agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("s") / within))
    other = values.select(by, F.col("s").alias("t"), F.col("n").alias("m"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    close = values.join(other, [by, "bin"]).where(F.abs(F.col("s") - F.col("t")) <= within).groupBy(by).agg(F.sum(F.col("n") * F.col("m")).alias("close"))
    x = rounds.join(close, by).withColumn("pairs", ((F.col("rounds") * d) * (F.col("rounds") * d) - F.col("rounds") * d * d) / 2)
    return x.where("pairs > 0").select(by, F.col("pairs").cast("long").alias("pairs"), F.round((F.col("close") - F.col("own")) / 2 / F.col("pairs"), 6).alias("agreement"))


def position_bias(scores: DataFrame, by: str) -> DataFrame:
    """(by, bias): how far from one half the share of rounds is in which the order AB scores more than the mean of BA (order, score)."""
    ba = scores.where("order = 'BA'").groupBy(by).agg(F.avg("score").alias("mean"))
    x = scores.where("order = 'AB'").join(ba, by).groupBy(by).agg(F.avg((F.col("score") > F.col("mean")).cast("double")).alias("p"))
    return x.select(by, F.round(F.abs(F.col("p") - 0.5), 6).alias("bias"))


def rubric(nodes: DataFrame, levels: int) -> DataFrame:
    """(node, score, weight) of a tree (node, parent, level, weight, verdict): leaves score their verdict (null abstains, weight 0), others the mean of
    their children by weights between 1 and 3; bottom-up from `levels`."""
    w = F.greatest(F.lit(1.0), F.least(F.lit(3.0), F.coalesce("weight", F.lit(1.0))))
    leaf = nodes.join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    done = leaf.select("node", "parent", "level", F.col("verdict").cast("double").alias("score"), F.when(F.col("verdict").isNull(), F.lit(0.0)).otherwise(w).alias("weight"))
    for level in range(levels - 1, -1, -1):
        kids = done.where(F.col("level") == level + 1).groupBy(F.col("parent").alias("node")).agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
        up = nodes.where(F.col("level") == level).withColumn("own", w).join(kids, "node")
        done = done.union(up.select("node", "parent", "level", F.when(F.col("w") > 0, F.col("s") / F.col("w")).alias("score"), F.when(F.col("w") > 0, F.col("own")).otherwise(F.lit(0.0)).alias("weight")))
    return done.select("node", F.round("score", 6).alias("score"), F.round("weight", 6).alias("weight"))


def recall(changed: DataFrame) -> DataFrame:
    """One row (changed, regenerated, recall) of commits (changed, regenerated: boolean); 1 without changes."""
    x = changed.agg(F.count_if("changed").alias("changed"), F.count_if(F.col("changed") & F.col("regenerated")).alias("regenerated"))
    return x.select("changed", "regenerated", _share(F.col("regenerated"), F.col("changed"), 1.0).alias("recall"))


def verdict_score(c: Column) -> Column:
    """The score of a JSON verdict between the first { and the last }, clamped to 0..10; null where it is none."""
    score = F.get_json_object(json_slice(c), "$.score").try_cast("double")
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)))



def verdict_state(c: Column) -> Column:
    """judged, uncertain or unparseable: whether a verdict has a score, says that it is not sure, or neither."""
    sure = F.get_json_object(json_slice(c), "$.uncertain")
    return F.when(verdict_score(c).isNotNull(), "judged").when(F.lower(sure) == "true", "uncertain").otherwise("unparseable")


def judged_mean(verdicts: DataFrame) -> DataFrame:
    """One row (pages, judged, uncertain, mean) of answers (page, attempt, text): an uncertain answer counts as its next attempt; the mean is over judged pages."""
    x = verdicts.select("page", "attempt", verdict_state(F.col("text")).alias("state"), verdict_score(F.col("text")).alias("score"))
    first = x.groupBy("page").agg(F.min_by(F.struct("state", "score"), F.struct((F.col("state") == "uncertain").cast("int"), "attempt")).alias("x"))
    return first.agg(F.count("*").alias("pages"), F.count_if(F.col("x.state") == "judged").alias("judged"), F.count_if(F.col("x.state") == "uncertain").alias("uncertain"), F.round(F.avg("x.score"), 6).alias("mean"))


DIMENSIONS = ("clarity", "readability", "conciseness", "richness", "structure")


def score_pairs(c: Column, dims: tuple[str, ...] = DIMENSIONS) -> Column:
    """struct<a, b: array<double>> of a JSON answer with the scores of two documents A and B on every dimension, between 0 and 10; null where any is missing."""

    def side(j: Column, name: str) -> Column:
        return F.transform(F.array(*[F.get_json_object(j, f"$.{name}.{d}").try_cast("double") for d in dims]), _clamped)

    # every step is a list that the next one reads as a variable: written out as expressions each would be worked out again wherever it is named
    one = F.transform(F.array(json_slice(c)), lambda j: F.struct(side(j, "A").alias("a"), side(j, "B").alias("b")))
    return F.get(F.filter(one, lambda s: ~F.exists(F.concat(s["a"], s["b"]), lambda x: x.isNull())), F.lit(0))


def _clamped(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), x)))


def judgment(a: Column, b: Column) -> Column:
    """1, 0 or -1: which of two lists of scores has the larger sum."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return F.signum(total(a) - total(b)).cast("int")


def quality_report(rounds: DataFrame, dims: int = 5) -> DataFrame:
    """One row (modules, mean_0 …, total, ties, std) of judged rounds (module, round, a_first, a, b: scores): the scores of the old document, that is a where it
    came first and b where it came second, averaged by module and then over modules; ties is the mean share of rounds without winner."""
    old = F.when(F.col("a_first"), F.col("a")).otherwise(F.col("b"))
    x = rounds.withColumn("old", old).withColumn("tie", (judgment(F.col("a"), F.col("b")) == 0).cast("double"))
    means = [F.avg(F.col("old")[i]).alias(f"mean_{i}") for i in range(dims)]
    m = x.groupBy("module").agg(*means, F.avg("tie").alias("tie"), *[F.stddev_pop(F.col("old")[i]).alias(f"std_{i}") for i in range(dims)])
    total = sum((F.col(f"mean_{i}") for i in range(dims)), F.lit(0.0)) / dims
    spread = sum((F.col(f"std_{i}") for i in range(dims)), F.lit(0.0)) / dims
    return m.agg(F.count("*").alias("modules"), *[F.round(F.avg(f"mean_{i}"), 6).alias(f"mean_{i}") for i in range(dims)], F.round(F.avg(total), 6).alias("total"), F.round(F.avg("tie"), 6).alias("ties"), F.round(F.avg(spread), 6).alias("std"))


def leaf_verdicts(votes: DataFrame) -> DataFrame:
    """(leaf, verdict, resolved) of votes (leaf, vote: boolean, null abstains): what most say, null for a tie; resolved where there is no tie."""
    x = votes.groupBy("leaf").agg(F.count_if("vote").alias("t"), F.count_if(~F.col("vote")).alias("f"))
    return x.select("leaf", F.when(F.col("t") > F.col("f"), True).when(F.col("f") > F.col("t"), False).alias("verdict"), (F.col("t") != F.col("f")).alias("resolved"))


def leaves(nodes: DataFrame) -> DataFrame:
    """(tree, node, place) of the nodes (tree, node, parent, pre: place in pre-order) without children, numbered in their order."""
    x = nodes.join(nodes.select("tree", F.col("parent").alias("node")).where("node is not null").distinct(), ["tree", "node"], "left_anti")
    return x.select("tree", "node", F.row_number().over(Window.partitionBy("tree").orderBy("pre")).cast("long").alias("place"))


#: Rows of rubrics that are there at once.
CHUNK = 10_000


def rubric_nodes(answers: DataFrame) -> DataFrame:
    """(tree, node, parent, pre, level, weight, requirement) of JSON answers (tree, text): a list of nodes, an object with rubrics, or one node; fences are dropped, and
    an answer that is none of these gives no rows. Nodes are numbered in pre-order, from 0."""
    tree_type = answers.schema["tree"].dataType.simpleString()

    def rows(text: str | None) -> Iterator[tuple]:
        body = re.sub(r"^```(?:json)?|```$", "", (text or "").strip()).strip()
        try:
            found = json.loads(body)
        except ValueError:
            return
        found = found if isinstance(found, list) else found.get("rubrics", [found]) if isinstance(found, dict) else []
        todo, n = [(x, None, 0) for x in reversed(found)], 0
        while todo:
            x, parent, level = todo.pop()
            if isinstance(x, dict) and isinstance(x.get("requirement"), str):
                yield n, parent, n, level, float(x.get("weight") or 1), x["requirement"]
                todo += [(y, n, level + 1) for y in reversed(x.pop("sub_tasks", None) or [])]
                n += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
        for b in batches:
            for at in range(b.num_rows):  # one answer's nodes are there at once, and CHUNK of its rows
                found = rows(b["text"][at].as_py())
                while part := list(islice(found, CHUNK)):
                    tree = b["tree"].take(pa.array([at] * len(part)))
                    yield pa.RecordBatch.from_arrays([tree, *(pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True))], ["tree", "node", "parent", "pre", "level", "weight", "requirement"])

    return answers.select("tree", "text").mapInArrow(run, f"tree {tree_type}, node long, parent long, pre long, level long, weight double, requirement string")


def sweep(members: DataFrame) -> DataFrame:
    """(gamma, communities, singletons, largest, mean, mixed) of members (gamma, community, domain): mixed communities hold more than one domain."""
    c = members.groupBy("gamma", "community").agg(F.count("*").alias("n"), F.count_distinct("domain").alias("d"))
    return c.groupBy("gamma").agg(F.count("*").alias("communities"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("d") > 1).alias("mixed"))


def run_batch(spark: SparkSession, entries: list[dict], run: Callable[[dict], float]) -> DataFrame:
    """(name, value, error) of a run for each entry; a run that fails is a row with its error, and the others go on."""
    rows = []
    for e in entries:
        try:
            rows.append((e["name"], float(run(e)), None))
        except Exception as problem:  # whatever a repository does to its run is part of the report
            rows.append((e.get("name"), None, f"{type(problem).__name__}: {problem}"))
    return spark.createDataFrame(rows, "name string, value double, error string")
