"""What pages claim, what the reference page lists and what sources define: whether names stand where they belong."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators.audit import severity
from skein.sources.files import LANGUAGES

# Pages that belong to no module, and words in headings under which items are no claims of entities.
GLOBAL = ("api", "overview", "architecture", "architecture-map", "_toc", "index", "_log")
OTHER_SECTIONS = ("dependenc", "usage", "依赖", "使用方式")


def _item(text: Column) -> Column:
    """What stands in backticks at the start of a list item; null without."""
    return T.once(F.regexp_extract(F.trim(text), "^- `([^`]*)`", 1), lambda x: F.nullif(x, F.lit("")))


def _kept(rows: DataFrame, name: str, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """rows with a column `name` of the value, where it is to be kept. It comes out of a list, so that what reads it doesn't work it out again."""
    return rows.withColumn(name, F.explode(F.filter(F.array(value), keep)))


def _sections(view: DataFrame) -> DataFrame:
    w = Window.partitionBy("page").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(F.trim("text").startswith("## "), F.trim(F.regexp_replace(F.trim("text"), "^#+", "")))
    return view.withColumn("heading", F.coalesce(F.last(head, True).over(w), F.lit(""))).withColumn("is_heading", head.isNotNull())


def code_path(path: Column) -> Column:
    return F.coalesce(T.extension(path).isin(*LANGUAGES), F.lit(False))


def api_entries(view: DataFrame) -> DataFrame:
    """(page, line, module, name, cites) of a reference page's view (page, line, text): its listed entities, under the heading that names their module."""
    x = _kept(_sections(view).where(~F.col("is_heading")), "name", T.signature_name(_item(F.col("text"))), lambda n: n.isNotNull())
    return x.select("page", "line", F.col("heading").alias("module"), "name", T.citations(F.col("text")).alias("cites"))


def api_modules(view: DataFrame) -> DataFrame:
    return view.where(F.col("text").startswith("## ")).select(F.trim(F.expr("substring(text, 4)")).alias("module")).where("module <> ''").distinct()


def entity_modules(entries: DataFrame) -> DataFrame:
    """(name, module): where a name is listed last."""
    return entries.groupBy("name").agg(F.max_by("module", F.struct("page", "line")).alias("module"))


def entity_claims(view: DataFrame, modules: DataFrame) -> DataFrame:
    """(page, line, name, text): list items that begin with an entity in backticks, outside sections on dependencies and usage; modules (module) and paths are none."""
    other = F.lit(False)
    for word in OTHER_SECTIONS:
        other = other | F.lower("heading").contains(word)
    x = _sections(view).where(~F.col("is_heading") & ~other)
    x = _kept(x, "item", _item(F.col("text")), lambda i: i.isNotNull() & ~i.rlike(r"[/\\]") & ~code_path(i))
    x = x.join(modules.select(F.col("module").alias("item")).distinct(), "item", "left_anti")
    return _kept(x, "name", T.signature_name(F.col("item")), lambda n: n.isNotNull()).select("page", "line", "name", "text")


def listed_sources(view: DataFrame) -> DataFrame:
    """(page, path): code files that are a whole list item in backticks."""
    path = F.nullif(F.regexp_extract(F.trim("text"), "^- `(.*)`$", 1), F.lit(""))
    return view.withColumn("path", path).where(F.col("path").isNotNull() & code_path(F.col("path"))).select("page", "path")


def begins(names: DataFrame) -> DataFrame:
    """(name): every beginning of the names that ends in '_'."""
    return names.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.left("name", n))).alias("name")).where(F.col("name").endswith("_")).distinct()


def _runs(spans: DataFrame, by: str) -> DataFrame:
    """(by, start, end): the lines of spans (by, start, end: not below start) as runs that don't touch; lines meet a run where they meet one of its spans."""
    w = Window.partitionBy(by).orderBy("start", "end")
    x = spans.where("start <= end").distinct().withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("run", F.count(F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + 1), 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(by, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def ownership(claims: DataFrame, entries: DataFrame, modules: DataFrame, page_cites: DataFrame, related: DataFrame, defined: DataFrame, path_names: DataFrame) -> DataFrame:
    """(page, line, name, kind, severity) of claims (page, line, name, text) on module pages that don't hold.

    In this order: a listed entity of the page's own module holds; one of another module holds if the page cites its lines (page_cites: page, start, end), else
    it is out of place, with a warning where the claim cites or the name is short. An entity that sources define (defined: name, path) holds if a file of it
    is among the page's related ones (page, path), or, without any, has the module's short name. A name that only a path has (path_names: name) gets a warning, the beginning of a
    known name that ends in '_' holds, and any other name is not covered.
    """
    listed = entity_modules(entries)
    c = claims.select("page", "line", "name", "text").join(listed.withColumnRenamed("module", "owner"), "name", "left")
    spans = _runs(entries.select("name", F.explode("cites").alias("x")).select("name", "x.start", "x.end"), "name").withColumnsRenamed({"start": "a", "end": "b"})
    cited = claims.select("page", "name").distinct().join(spans, "name").join(_runs(page_cites.select("page", "start", "end"), "page"), "page").where("start <= b and end >= a").select("page", "name").distinct().withColumn("cited", F.lit(True))
    base = lambda p: F.regexp_extract(T.normal_path(p), "([^/]*)$", 1)  # noqa: E731  a path that ends in another has its last name
    files = claims.select("page", "name").distinct().join(defined.select("name", "path").distinct(), "name")
    has_related = related.select("page").distinct().withColumn("related", F.lit(True))
    by_file = files.withColumn("base", base(F.col("path"))).join(related.select("page", base(F.col("path")).alias("base")).distinct(), ["page", "base"], "left_semi").select("page", "name")
    short = modules.select(F.replace("module", F.lit("::"), F.lit("_")).alias("page"), F.element_at(F.split("module", "::"), -1).alias("short")).where("short <> ''").groupBy("page").agg(F.min("short").alias("short"))
    by_stem = files.join(has_related, "page", "left_anti").join(short, "page", "left").withColumn("short", F.coalesce("short", F.element_at(F.split("page", "_"), -1))).where(T.file_stem(T.normal_path(F.col("path"))) == F.col("short")).select("page", "name")
    owned = by_file.union(by_stem).distinct().withColumn("owned", F.lit(True))
    named = path_names.select("name").distinct().withColumn("in_path", F.lit(True))
    series = begins(listed.select("name").union(defined.select("name")).distinct()).withColumn("series", F.lit(True))
    x = c.join(cited, ["page", "name"], "left").join(owned, ["page", "name"], "left").join(named, "name", "left").join(series, "name", "left")
    known = F.col("owner").isNotNull()
    at_home = known & (F.replace("owner", F.lit("::"), F.lit("_")) == F.col("page"))
    kind = F.when(at_home | (known & F.col("cited").isNotNull()), None).when(known, "entity-ownership").when(F.col("owned").isNotNull(), None).when(F.col("in_path").isNotNull(), "entity-ownership").when(F.col("series").isNotNull(), None).otherwise("entity-coverage")
    level = F.when(known, severity(F.size(T.citations(F.col("text"))) > 0, F.col("name"))).when(F.col("in_path").isNotNull(), "Warning").otherwise("Error")
    return x.select("page", "line", "name", kind.alias("kind"), level.alias("severity")).where("kind is not null")


def stale_entities(entries: DataFrame, defined: DataFrame, claims: DataFrame) -> DataFrame:
    """(page, name): listed entities that no source defines (name), on each module page that claims them, else on the reference page; none where nothing is defined."""
    some = defined.limit(1).select(F.lit(1).alias("one"))
    gone = entries.select("name").distinct().join(defined.select("name").distinct(), "name", "left_anti").join(F.broadcast(some), F.lit(True), "left_semi")  # one row
    on = claims.where(~F.col("page").isin(*GLOBAL)).select("page", "name").distinct().join(gone, "name", "left_semi").select("page", "name")
    return on.union(gone.join(on.select("name").distinct(), "name", "left_anti").select(F.lit("api"), "name"))


def primary_language(pages: DataFrame) -> DataFrame:
    """One row (language): the first language with a reference page, of pages (language, page)."""
    return pages.where("page = 'api'").agg(F.min("language").alias("language"))


def path_escape(path: Column, roots: list[str]) -> Column:
    """Why a cited path can't be followed: a '..' in it, a drive without root, or an absolute path outside the roots; null where it can."""
    p = T.normal_path(path)
    inside = F.lit(False)
    for r in roots:
        inside = inside | p.startswith(r.rstrip("/") + "/")
    return F.when(F.array_contains(F.split(p, "/"), ".."), "parent").when(p.rlike("^[A-Za-z]:[^/]"), "drive").when(p.rlike("^(/|[A-Za-z]:/)") & ~inside, "outside")


def resolve(paths: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file): the path below the first root (place, root) that has it among files (file); null without."""
    # each slash of a file may stand between a root and a path
    cut = files.select("file").distinct().select("file", F.explode(F.filter(F.sequence(F.lit(1), F.greatest(F.length("file"), F.lit(1))), lambda i: F.substring("file", i, F.lit(1)) == "/")).alias("i"))
    cut = cut.select("file", F.substring("file", F.lit(1), F.col("i") - 1).alias("root"), F.substring("file", F.col("i") + 1, F.length("file")).alias("path"))
    at = cut.join(paths.select("path").distinct(), "path").join(roots.select("place", F.rtrim(F.regexp_replace("root", "/+$", "")).alias("root")), "root")
    found = at.groupBy("path").agg(F.min_by("file", "place").alias("file"))
    return paths.join(found, "path", "left").select("path", "file")


def recorded_hash(sources: DataFrame, state: DataFrame, root: str) -> DataFrame:
    """(path, hash) of sources (path): recorded under the path as it is, else below the root, else without the root."""
    base = root.rstrip("/") + "/"
    s = sources.select("path", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(base), "path")).alias("whole"), F.when(F.col("path").startswith(base), F.expr(f"substring(path, {len(base) + 1})")).otherwise(F.col("path")).alias("below"))
    names = s.select("path", F.posexplode(F.array("path", "below", "whole")).alias("place", "key")).join(state.select(F.col("path").alias("key"), "hash"), "key")
    return s.join(names.groupBy("path").agg(F.min_by("hash", "place").alias("hash")), "path", "left").select("path", "hash")


def allowed_names(dependencies: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(page, name): what a page may name as a dependency: its module's dependencies (page, name), the heads of its imports (page, target), the standard names, all modules (module)."""
    heads = imports.select("page", F.element_at(F.split("target", "::"), 1).alias("name"))
    own = dependencies.select("page", "name").union(heads)
    std = own.select("page").distinct().select("page", F.explode(F.array(F.lit("std"), F.lit("core"))).alias("name"))
    every = own.select("page").distinct().join(modules.select(F.col("module").alias("name")).distinct(), F.lit(True))
    return own.union(std).union(every).distinct()


def claim_violations(view: DataFrame, references: DataFrame, entities: DataFrame) -> DataFrame:
    """(page, line, claimed, name) of claims outside fences that name no entity (page, name) of the page's module, nor a module or import (page, name) or what lies below one."""
    other = F.lit(False)
    for word in OTHER_SECTIONS:
        other = other | F.lower("heading").contains(word)
    x = _sections(view).where(~F.col("is_heading") & ~other & ~F.col("fenced")).withColumn("claimed", _item(F.col("text"))).where("claimed is not null")
    x = x.where(~F.col("claimed").rlike(r"[/\\]") & ~code_path(F.col("claimed"))).withColumn("name", T.signature_name(F.col("claimed"))).where("name is not null").select("page", "line", "claimed", "name")
    s = F.split("claimed", "::")
    upper = x.select("page", "line", "claimed", F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda n: F.array_join(F.slice(s, F.lit(1), n), "::"))).alias("ref"))
    refs = references.select("page", F.col("name").alias("ref")).distinct()
    left = x.join(upper.join(refs, ["page", "ref"], "left_semi").select("page", "line").distinct(), ["page", "line"], "left_anti").join(entities.select("page", "name").distinct(), ["page", "name"], "left_anti")
    starts = entities.select("page", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.left("name", n))).alias("start")).distinct()
    series = left.where(F.col("name").endswith("_")).withColumn("start", F.expr("left(name, length(name) - 1)")).join(starts, ["page", "start"], "left_semi").select("page", "line")
    return left.join(series, ["page", "line"], "left_anti").select("page", "line", "claimed", "name")


# The words that a diagram begins with.
DIAGRAMS = ("graph", "flowchart", "sequenceDiagram", "classDiagram", "stateDiagram", "stateDiagram-v2", "erDiagram", "journey", "gantt", "pie", "mindmap", "timeline", "gitGraph", "quadrantChart", "requirementDiagram")


def diagram_problems(blocks: DataFrame) -> DataFrame:
    """(page, start, message) of diagrams (page, start, body) that can't be drawn: an unknown first word, or brackets that don't match up."""
    word = F.regexp_extract("body", r"^\s*(\S+)", 1)
    count = lambda c: F.length("body") - F.length(F.replace("body", F.lit(c)))
    uneven = F.lit(False)
    for a, b in ("[]", "()", "{}"):
        uneven = uneven | (count(a) != count(b))
    message = F.when(~word.isin(*DIAGRAMS), F.concat(F.lit("unknown diagram "), word)).when(uneven, F.lit("brackets do not match"))
    return blocks.select("page", "start", message.alias("message")).where("message is not null")


def degrade_diagrams(view: DataFrame, problems: DataFrame) -> DataFrame:
    """(page, text): pages whose bad diagrams (page, start, message) became plain text blocks below a comment; one left open is closed."""
    last = Window.partitionBy("page")
    x = view.withColumn("fences", F.sum(F.ltrim("text").startswith("```").cast("int")).over(last)).withColumn("lines", F.max("line").over(last))
    x = x.join(problems.select("page", F.col("start").alias("line"), "message"), ["page", "line"], "left")
    text = F.when(F.col("message").isNotNull(), F.concat(F.lit("<!-- diagram not valid: "), F.regexp_replace("message", r"[\r\n]+", " "), F.lit(" -->\n```text"))).otherwise(F.col("text"))
    x = x.withColumn("text", F.when((F.col("line") == F.col("lines")) & (F.col("fences") % 2 == 1), F.concat(text, F.lit("\n```"))).otherwise(text))
    return x.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda r: r["text"]), "\n").alias("text"))


_CONFLICTS = "conflicts array<struct<page string, claim string, conflict string>>"


def conflicts(answers: DataFrame) -> DataFrame:
    """(id, page, claim, conflict) of answers (id, text) that hold a JSON list of conflicts, fenced or not; one without page or claim is dropped, and an answer that is no JSON gives none."""
    found = F.from_json(T.json_slice(F.col("text")), _CONFLICTS)["conflicts"]
    x = answers.select("id", F.explode(found).alias("x")).select("id", "x.*")
    return x.where("page is not null and claim is not null").withColumn("conflict", F.coalesce("conflict", F.lit("")))


def evidence(pages: DataFrame, each: int = 6000, whole: int = 20_000) -> DataFrame:
    """(page, text, before): the beginnings of pages (page, text) in their order, as far as they fit into `whole` characters: bounded input for a judge."""
    x = pages.select("page", F.concat(F.lit("# "), "page", F.lit("\n"), F.left("text", F.lit(each)), F.lit("\n")).alias("text"))
    x = x.orderBy("page").limit(whole // 4)  # a page takes four characters at least
    w = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).where(F.col("before") < whole)
    return x.select("page", F.left("text", (F.lit(whole) - F.col("before")).cast("int")).alias("text"), F.col("before").cast("long").alias("before"))
