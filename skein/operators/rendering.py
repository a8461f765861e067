"""Text assembled from tables: reference lists, contents, diagrams, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.ownership import GLOBAL
from skein.sources.scratch import Scratch


def budget_prefix(sections: DataFrame, by: str, budget: int, order: str = "pos") -> DataFrame:
    """Rows (by, order, text) whose running cost, a third of the characters rounded up, stays in the budget; the first row always."""
    w = Window.partitionBy(by).orderBy(order)
    x = sections.withColumn("cost", F.sum(F.ceil(F.length("text") / 3)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return x.withColumn("n", F.row_number().over(w)).where((F.col("cost") <= budget) | (F.col("n") == 1)).drop("n")


def listing(rows: DataFrame, by: str, order: list[str], line, joiner: str = "\n") -> DataFrame:
    """(by, body): one line a row, in order."""
    x = rows.select(by, F.struct(*[F.col(c) for c in order], line.alias("line")).alias("x"))
    return x.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda r: r["line"]), joiner).alias("body"))


def api_reference(entities: DataFrame) -> DataFrame:
    """(module, body) of entities (module, id, name, kind, visibility, file, line)."""
    line = F.concat(F.lit("- `"), "name", F.lit("` ("), "kind", F.when(F.col("visibility").isNotNull(), F.concat(F.lit(", "), "visibility")).otherwise(F.lit("")), F.lit(") — "), "file", F.lit(":"), F.col("line").cast("string"))
    return listing(entities, "module", ["id"], line)


def call_diagram(counts: DataFrame) -> DataFrame:
    """One row (body): a flow chart of (a, b, n), sorted."""
    line = F.concat(F.lit("  "), T.diagram_id(F.col("a")), F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "), T.diagram_id(F.col("b")))
    x = listing(counts.where("a <> b").withColumn("all", F.lit(1)), "all", ["a", "b"], line)
    return x.select(F.concat(F.lit("graph TD\n"), "body").alias("body"))


def entity_top(entities: DataFrame, by: str, k: int = 30) -> DataFrame:
    """The first k entities (by, class, name) of each group, by class, then name."""
    return entities.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("class", "name")).cast("long")).where(F.col("place") <= k)


def select_level(levels: list[str], budget: int):
    """The first of the columns, from the fullest to the shortest, whose quarter of characters fits the budget, else the last, cut to fit."""
    out = None
    for c in levels:
        fits = F.floor(F.length(c) / 4) <= budget
        out = F.when(fits, F.col(c)) if out is None else out.when(fits, F.col(c))
    return out.otherwise(F.left(levels[-1], F.lit(budget * 4)))


def cite_link(symbol: Column, target: Column) -> Column:
    return F.concat(F.lit("[`"), symbol, F.lit("`]("), target, F.lit(")"))


#: How relations of references read on a page.
RELATIONS = {"depends_on": "depends on", "used_by": "used by", "related": "related"}


def wiki_pages(docs: DataFrame, references: DataFrame) -> DataFrame:
    """(title, body) of pages (title, updated, commit, content) and their references (title, pos, target, path, relation): heading, time, commit if known, content, references in order."""
    relation = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in RELATIONS.items() for x in p]), F.col("relation")), F.col("relation"))
    refs = listing(references, "title", ["pos"], F.concat(F.lit("- "), cite_link(F.col("target"), F.col("path")), F.lit(" — "), relation, F.lit("\n")), "").withColumnRenamed("body", "refs")
    commit = F.when(F.col("commit").isNotNull(), F.concat(F.lit("> Based on commit: "), "commit", F.lit("\n\n"))).otherwise("")
    head = F.concat(F.lit("# "), "title", F.lit("\n\n> Last updated: "), "updated", F.lit("\n\n"), commit, F.coalesce("content", F.lit("")))
    return docs.join(refs, "title", "left").select("title", F.concat(head, F.when(F.col("refs").isNotNull(), F.concat(F.lit("\n\n## References\n\n"), "refs")).otherwise("")).alias("body"))


def cards(rows: DataFrame) -> DataFrame:
    """(module, body): cards (module, type, kind: module, spec or tech-stack, dependencies, dependents, patterns, stack, files, notes: arrays, summary, entities: array of
    name, kind, visibility, source, doc) with front matter, the sections of their kind and notes that wait."""
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    field = lambda name, c: F.when(some(c), F.concat(F.lit(f"{name}: ["), F.array_join(c, ", "), F.lit("]\n"))).otherwise("")
    section = lambda title, c: F.when(some(c), F.concat(F.lit(f"## {title}\n\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n\n"))).otherwise("")
    entity = lambda e: F.concat(e["name"], F.lit(" "), e["kind"], F.lit(" ("), e["visibility"], F.lit(")"), F.when(e["source"].isNotNull(), F.concat(F.lit(" — "), e["source"])).otherwise(""), F.when(e["doc"].isNotNull(), F.concat(F.lit(" — "), e["doc"])).otherwise(""))
    front = F.concat(F.lit("---\nmodule_name: "), "module", F.lit("\nmodule_type: "), "type", F.lit("\ncard_kind: "), "kind", F.lit("\n"), field("dependencies", F.col("dependencies")), field("dependents", F.col("dependents")), field("design_patterns", F.col("patterns")), field("tech_stack", F.col("stack")), F.lit("---\n"))
    files = section("Related files", F.transform("files", lambda x: F.concat(F.lit("`"), x, F.lit("`"))))
    own = F.when(F.col("kind") == "module", F.concat(section("Key entities", F.transform("entities", entity)), files)).otherwise(F.concat(section("Entries", F.col("stack")), files))
    body = F.concat(front, F.lit("# "), "module", F.lit("\n\n## Summary\n\n"), F.coalesce("summary", F.lit("")), F.lit("\n\n"), own, section("Manual edits to take over", F.col("notes")))
    return rows.select("module", body.alias("body"))


def agent_index(pages: DataFrame, cards_: DataFrame, languages: list[str]) -> DataFrame:
    """(part, place, line): links to all pages (title) in every language, to the global pages and to the cards (module, kind) of the first language, each part sorted; written in this order they are the index."""
    langs = F.explode(F.array(*map(F.lit, languages)))
    modules = pages.select("title", langs.alias("lang"))
    line = lambda label, path: F.concat(F.lit("- ["), label, F.lit("]("), path, F.lit(")"))
    modules = modules.select(F.lit(1).alias("part"), F.concat_ws("/", "lang", "title").alias("place"), line(F.col("title"), F.concat(F.lit("wiki/"), "lang", F.lit("/"), F.replace("title", F.lit("::"), F.lit("_")), F.lit(".md"))).alias("line"))
    names = pages.sparkSession.range(1).select(langs.alias("lang")).select("lang", F.explode(F.array(*map(F.lit, ("api", "overview", "architecture", "index")))).alias("name"))
    glob = names.select(F.lit(2), F.concat_ws("/", "lang", "name"), line(F.col("name"), F.concat(F.lit("wiki/"), "lang", F.lit("/"), "name", F.lit(".md"))))
    path = F.when(F.col("kind") == "module", F.concat(F.replace("module", F.lit("::"), F.lit("_")), F.lit(".md"))).otherwise(F.concat(F.lit("project/"), "kind", F.lit(".md")))
    own = cards_.select(F.lit(3), "module", line(F.col("module"), F.concat(F.lit(f"cards/{languages[0]}/"), path)))
    return modules.union(glob).union(own)


def module_sections(cards_: DataFrame, entities: DataFrame) -> DataFrame:
    """(module, level, text) of cards (module, summary) and entities (module, name, kind, visibility, source, doc): level 0 is whole, 1 is without constants, 2 also without
    entities of unknown source, 3 has names and kinds only. A summary is its first line, up to 200 characters; entities are sorted by name."""
    line = F.concat(F.lit("- "), "name", F.lit(" "), "kind", F.lit(" ("), "visibility", F.lit(")"), F.when(F.col("source").isNotNull(), F.concat(F.lit(" — at "), "source")).otherwise(""), F.when(F.col("doc").isNotNull(), F.concat(F.lit(" — "), "doc")).otherwise(""), F.lit("\n"))
    short = F.concat(F.lit("- "), "name", F.lit(" "), "kind", F.lit("\n"))
    x = entities.select("module", F.struct("name", F.coalesce("source", F.lit("")).alias("s"), (F.col("kind") == "constant").alias("constant"), F.col("source").isNotNull().alias("located"), line.alias("line"), short.alias("short")).alias("x"))
    x = x.groupBy("module").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    head = F.concat(F.lit("## "), "module", F.lit("\n\n"), F.left(F.substring_index(F.coalesce("summary", F.lit("")), "\n", 1), F.lit(200)), F.lit("\n\n"))
    joined = lambda keep, field: F.coalesce(F.array_join(F.transform(F.filter("xs", keep), lambda e: e[field]), ""), F.lit(""))
    texts = [joined(lambda e: F.lit(True), "line"), joined(lambda e: ~e["constant"], "line"), joined(lambda e: ~e["constant"] & e["located"], "line"), joined(lambda e: ~e["constant"] & e["located"], "short")]
    return cards_.join(x, "module", "left").select("module", F.posexplode(F.array(*[F.concat(head, t) for t in texts])).alias("level", "text"))


def greedy(items: DataFrame, budget: int, parts: int = 0) -> list[tuple[tuple, tuple | None, int]]:
    """Which of items (bytes, module, tokens) are kept where each, the largest first, is kept if its tokens fit what is left of the budget: rounds (after, before, most), each of which keeps the
    items between two places that have at most so many tokens.

    Items are dealt to ranges of their order once. A round adds up the ranges' tokens, and goes into the one range where the budget ends; what doesn't fit there closes the round, and with it all items
    that are larger than what is left. Only sums of ranges and one place a round reach the driver.
    """
    spark = items.sparkSession
    order = (F.col("bytes").desc(), F.col("module"))
    scratch = Scratch(spark, "budget")
    dealt = items.select("bytes", "module", "tokens").repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt = scratch.save(dealt.withColumn("part", F.spark_partition_id()))
    rounds, left, after = [], budget, None
    while True:
        rest = dealt.where(F.col("tokens") <= left)
        if after is not None:
            rest = rest.where((F.col("bytes") < after[0]) | ((F.col("bytes") == after[0]) & (F.col("module") > after[1])))
        total, crossing = 0, None
        for r in sorted(rest.groupBy("part").agg(F.sum("tokens").alias("n")).collect()):  # one row a range
            if total + r["n"] > left:
                crossing = r["part"]
                break
            total += r["n"]
        if crossing is None:
            rounds.append((after, None, left))
            scratch.drop(dealt)
            return rounds
        sums = rest.where(F.col("part") == crossing).withColumn("upto", F.sum("tokens").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        stop = sums.where(F.col("upto") > left - total).orderBy("upto", *order).select("bytes", "module", "tokens", "upto").first()
        here = (stop["bytes"], stop["module"])
        rounds.append((after, here, left))
        left, after = left - total - (stop["upto"] - stop["tokens"]), here


def full_index(sections: DataFrame, budget: int, head: int = 0) -> DataFrame:
    """(module, level, text): the sections (module, level, text) of the first level whose characters, a quarter of them a token, fit the budget less the head's tokens.

    Where none fits, sections of level 3 are put in as long as they fit, the longest first; the others keep their module with a null text at level 4.
    """
    sizes = sections.groupBy("level").agg(F.floor(F.sum(F.length("text")) / 4).alias("tokens"))
    chosen = sizes.agg(F.min(F.when(F.col("tokens") + head <= budget, F.col("level"))).alias("chosen")).first()["chosen"]
    if chosen is not None:
        return sections.where(F.col("level") == chosen).select("module", "level", "text")
    last = sections.where("level = 3").select("module", F.floor(F.length("text") / 4).alias("tokens"), F.octet_length("text").alias("bytes"), "text")
    fits = F.lit(False)
    for after, before, most in greedy(last, max(0, budget - head)):
        behind = F.lit(True) if after is None else (F.col("bytes") < after[0]) | ((F.col("bytes") == after[0]) & (F.col("module") > after[1]))
        ahead = F.lit(True) if before is None else (F.col("bytes") > before[0]) | ((F.col("bytes") == before[0]) & (F.col("module") < before[1]))
        fits = fits | (behind & ahead & (F.col("tokens") <= most))
    return last.select("module", F.when(fits, F.lit(3)).otherwise(4).alias("level"), F.when(fits, F.col("text")).alias("text"))


def dependency_diagram(edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """(part, place, line) of a flow chart of edges (id, a, b) between modules: nodes sorted, each edge once where it is first seen, then the style of modules (module) on cycles."""
    e = edges.where("a <> b and a <> '' and b <> ''").groupBy("a", "b").agg(F.min("id").alias("id"))
    names = e.select(F.explode(F.array("a", "b")).alias("module")).distinct()
    node = names.select(F.lit(1).alias("part"), F.col("module").alias("place"), F.concat(F.lit("    "), T.diagram_id(F.col("module")), F.lit('["'), "module", F.lit('"]')).alias("line"))
    link = e.select(F.lit(2), F.lpad(F.col("id").cast("string"), 20, "0"), F.concat(F.lit("    "), T.diagram_id(F.col("a")), F.lit(" --> "), T.diagram_id(F.col("b"))))
    style = names.join(cyclic.select("module").distinct(), "module", "left_semi").select(F.lit(3), "module", F.concat(F.lit("    style "), T.diagram_id(F.col("module")), F.lit(" fill:#ffcccc,stroke:#ff0000")))
    return node.union(link).union(style)


def join_under_budget(sections: DataFrame, by: str, budget: int) -> DataFrame:
    """(by, text): sections (by, pos, text) one after the other until one doesn't fit, a third of the characters rounded up each; empty ones are skipped, the first stays."""
    x = budget_prefix(sections.where("text <> ''"), by, budget)
    return x.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "").alias("text"))


def canonical_links(pages: DataFrame, modules: DataFrame, language: str) -> DataFrame:
    """(page, text): links of pages (page, text) to module pages of a language lead to the page of the module (module) that they name; where there is no such module, the name stays without link."""
    piece = r"(?s)\[[^\[\]]*\]\([^)]*\)|[^\[]+|\["
    x = pages.select("page", F.posexplode(F.regexp_extract_all("text", F.lit(piece), F.lit(0))).alias("pos", "piece"))
    link = r"^\[([^\[\]]*)\]\((.*)\)$"
    prefix = f"wiki/{language}/"
    target = F.regexp_extract("piece", link, 2)
    x = x.withColumn("module", F.when(target.startswith(prefix) & target.endswith(".md"), F.trim(F.regexp_extract("piece", link, 1))))
    x = x.join(modules.select("module", F.lit(True).alias("known")).distinct(), "module", "left")
    fixed = F.concat(F.lit("["), F.regexp_extract("piece", link, 1), F.lit(f"]({prefix}"), F.replace("module", F.lit("::"), F.lit("_")), F.lit(".md)"))
    x = x.select("page", F.struct("pos", F.when(F.col("module").isNull(), F.col("piece")).when(F.col("known"), fixed).otherwise(F.col("module")).alias("piece")).alias("x"))
    return x.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda r: r["piece"]), "").alias("text"))


def stack_card(entries: DataFrame) -> DataFrame:
    """(place, line): a summary line, then a line for each entry (category, name, version, manifest) by category and name; without entries there is no card."""
    n = entries.agg(F.count("*").alias("n"), F.count_distinct("manifest").alias("m")).where("n > 0")
    head = n.select(F.lit("").alias("place"), F.concat(F.col("n").cast("string"), F.lit(" dependencies in "), F.col("m").cast("string"), F.lit(" manifests")).alias("line"))
    at = F.when(F.coalesce("version", F.lit("")) == "", "").otherwise(F.concat(F.lit("@"), "version"))
    return head.union(entries.select(F.concat_ws("/", "category", "name"), F.concat("name", at, F.lit(" ("), "category", F.lit(", "), "manifest", F.lit(")"))))


_CARD = "module_name string, module_type string, summary string, dependencies array<string>, key_entities array<struct<name string, kind string, visibility string, doc string, source string>>"


def parsed_cards(answers: DataFrame) -> DataFrame:
    """(module, type, summary, dependencies, entities) of a model's answers (module, text): JSON between the first { and the last }; what is missing takes defaults, the module its own name."""
    x = answers.select("module", F.from_json(T.json_slice(F.col("text")), _CARD).alias("x"))
    none = F.array().cast("array<string>")
    entities = F.transform(F.coalesce("x.key_entities", F.expr("cast(array() as array<struct<name string, kind string, visibility string, doc string, source string>>)")), lambda e: F.struct(F.coalesce(e["name"], F.lit("")).alias("name"), F.coalesce(e["kind"], F.lit("")).alias("kind"), F.coalesce(e["visibility"], F.lit("")).alias("visibility"), e["source"].alias("source"), e["doc"].alias("doc")))
    return x.select(F.coalesce("x.module_name", "module").alias("module"), F.coalesce("x.module_type", F.lit("module")).alias("type"), F.coalesce("x.summary", F.lit("")).alias("summary"), F.coalesce("x.dependencies", none).alias("dependencies"), entities.alias("entities"))


def entity_sources(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """entities (module, name, source) with the lines of the first entity of that name in the module's chunk (module, name, path, line_start, line_end) where source is null."""
    at = chunks.groupBy("module", "name").agg(F.min(F.struct("path", "line_start", "line_end")).alias("at"))
    found = F.concat("at.path", F.lit(":"), F.col("at.line_start").cast("string"), F.lit("-"), F.col("at.line_end").cast("string"))
    return entities.join(at, ["module", "name"], "left").select("module", "name", F.coalesce("source", found).alias("source"))


def without_protected(files: DataFrame, protected: DataFrame) -> DataFrame:
    """Files (path, content) to write, less those that a person keeps (path)."""
    return files.join(protected.select("path").distinct(), "path", "left_anti")


def forced_orphans(there: DataFrame, rendered: DataFrame, kept_modules: DataFrame, mark: str) -> DataFrame:
    """(path): generated files (path, stem, module, content) that are no longer rendered, global pages, of kept modules or without the generator's mark left out."""
    x = there.where(F.col("content").contains(mark) & ~F.col("stem").isin(*GLOBAL))
    return x.join(rendered.select("path"), "path", "left_anti").join(kept_modules.select("module").distinct(), "module", "left_anti").select("path")
