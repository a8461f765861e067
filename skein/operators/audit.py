"""Checks of documentation: views of markdown by line, links, citations, claims, coverage, residue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T


def lines(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """(page, line, text, fenced, section): lines from 1; fenced lines stand between lines of three backticks, these included, an open one to the end;
    section is the last '## ' heading at or above the line outside fences."""
    x = pages.select(F.col(page).alias("page"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "text")).withColumn("line", F.col("pos") + 1)
    w = Window.partitionBy("page").orderBy("line")
    x = x.withColumn("mark", F.ltrim("text").startswith("```").cast("int")).withColumn("marks", F.sum("mark").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    x = x.withColumn("fenced", (F.col("marks") % 2 == 1) | (F.col("mark") == 1))
    head = F.when(F.col("text").startswith("## ") & ~F.col("fenced"), F.trim(F.substring("text", 4, 1000)))
    return x.withColumn("section", F.last(head, True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).select("page", F.col("line").cast("long").alias("line"), "text", "fenced", "section")


def fence_ranges(view: DataFrame) -> DataFrame:
    """(page, start, end) of the fences of a view."""
    w = Window.partitionBy("page").orderBy("line")
    f = view.where("fenced").withColumn("mark", F.ltrim("text").startswith("```").cast("int"))
    f = f.withColumn("n", F.floor((F.sum("mark").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1 - F.when((F.sum("mark").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) % 2 == 0), 1).otherwise(0)) / 2))
    return f.groupBy("page", "n").agg(F.min("line").alias("start"), F.max("line").alias("end")).select("page", "start", "end")


def orphans(pages: DataFrame, links: DataFrame, global_pages: list[str]) -> DataFrame:
    """Pages (page) that no link (target) reaches, the global ones left out."""
    return pages.where(~F.col("page").isin(global_pages)).join(links.select(F.col("target").alias("page")).distinct(), "page", "left_anti").select("page")


def broken(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links (page, target), each occurrence, whose target is no page."""
    return links.join(pages.select(F.col("page").alias("target")).distinct(), "target", "left_anti").select("page", "target")


def staleness(pages: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(page, state) of pages (page, path, written) against recorded (path, hash) and current (path, hash, modified): source-missing, stale, or by age without a record."""
    j = pages.join(recorded.withColumnRenamed("hash", "was"), "path", "left").join(current.withColumnRenamed("hash", "now"), "path", "left")
    state = F.when(F.col("now").isNull(), "source-missing").when(F.col("was").isNotNull() & (F.col("was") != F.col("now")), "stale").when(F.col("was").isNull() & (F.col("modified") > F.col("written")), "stale")
    return j.select("page", state.alias("state")).where("state is not null")


def check_citations(cites: DataFrame, files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(page, path, start, end, reason) of bad citations: escape, missing, out of range, or no overlap with any entity of a file that has some."""
    have = ranges.select("path", F.lit(True).alias("has")).distinct()
    hit = cites.join(ranges, "path").where("start <= b and end >= a").select("page", "path", "start", "end").distinct().withColumn("hit", F.lit(True))
    j = cites.distinct().join(files.select("path", "lines"), "path", "left").join(have, "path", "left").join(hit, ["page", "path", "start", "end"], "left")
    escape = F.col("path").startswith("../") | F.col("path").contains("/../")
    reason = F.when(escape, "escape").when(F.col("lines").isNull(), "missing").when(F.col("end") > F.col("lines"), "out-of-range").when(F.col("has") & F.col("hit").isNull(), "no-entity")
    return j.select("page", "path", "start", "end", reason.alias("reason")).where("reason is not null")


def citation_density(view: DataFrame, per: int = 200) -> DataFrame:
    """(page, section, missing): citations a section lacks: one for each `per` characters that are not white space outside fences, one at least."""
    x = view.where("section is not null and not fenced").withColumn("n", F.length(F.regexp_replace("text", r"\s", ""))).withColumn("c", F.size(T.citations(F.col("text"))))
    x = x.groupBy("page", "section").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    lack = F.greatest(F.ceil(F.col("n") / per) - F.col("c"), F.when(F.col("c") == 0, 1).otherwise(0))
    return x.select("page", "section", lack.cast("long").alias("missing")).where("missing > 0")


def residue(view: DataFrame) -> DataFrame:
    """(page, line, snippet) of lines with a template's braces left."""
    return view.where(F.col("text").rlike(T.RESIDUE)).select("page", "line", F.left("text", F.lit(120)).alias("snippet"))


def dependency_claims(view: DataFrame, sections: list[str]) -> DataFrame:
    """(page, claim): names of '- ' items in dependency sections outside fences, up to a dash, without backticks."""
    item = F.trim(F.translate(F.regexp_extract("text", r"^\s*- (.*?)(?: [-—:].*)?$", 1), "`", ""))
    return view.where(~F.col("fenced") & F.col("section").isin(sections) & F.col("text").rlike(r"^\s*- ")).select("page", item.alias("claim")).where("claim <> ''")


def fabricated(claims: DataFrame, allowed: DataFrame, std: tuple[str, ...] = ("std", "core")) -> DataFrame:
    """(page, claim, reason): claims that are not allowed (name), whole or by their first segment; internal where that is crate, src, self or super."""
    head = F.element_at(F.split("claim", "::"), 1)
    ok = allowed.select("name").distinct()
    c = claims.withColumn("head", head).where(~F.col("head").isin(*std)).join(ok.withColumnRenamed("name", "claim"), "claim", "left_anti").join(ok.withColumnRenamed("name", "head"), "head", "left_anti")
    return c.select("page", "claim", F.when(F.col("head").isin("crate", "src", "self", "super"), "internal").otherwise("unknown").alias("reason"))


def uncovered(claims: DataFrame, known: DataFrame) -> DataFrame:
    """(page, name): claimed names that are not known (name); a name ending in '_' is known if a known name begins with it."""
    left = claims.join(known.select("name").distinct(), "name", "left_anti")
    starts = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.left("name", n))).alias("name")).where(F.col("name").endswith("_")).distinct()
    prefixes = left.where(F.col("name").endswith("_")).join(starts, "name", "left_anti")
    return left.where(~F.col("name").endswith("_")).union(prefixes).select("page", "name").distinct()


def histogram(issues: DataFrame) -> DataFrame:
    return issues.groupBy("kind").agg(F.count("*").alias("n"))


def issues(*checks: tuple[str, str, DataFrame]) -> DataFrame:
    """(kind, severity, page) of several checks' rows (page, …)."""
    out = None
    for kind, severity, df in checks:
        part = df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.col("page").cast("string").alias("page"))
        out = part if out is None else out.unionByName(part)
    return out


def verified_tokens(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(page, token, reason) of [[path#L-a-L-b@hash]] tokens that fail: malformed, missing, out-of-range or hash; sources are (path, source)."""
    shape = r"\[\[([^\]#]+)#L-([0-9]+)-L-([0-9]+)@([0-9a-f]{8})\]\]"
    t = pages.select("page", F.explode(F.regexp_extract_all("text", F.lit(r"\[\[[^\]]*\]\]"), F.lit(0))).alias("token")).distinct()
    t = t.withColumn("path", F.nullif(F.regexp_extract("token", shape, 1), F.lit(""))).withColumn("a", F.regexp_extract("token", shape, 2)).withColumn("b", F.regexp_extract("token", shape, 3)).withColumn("h", F.regexp_extract("token", shape, 4))
    j = t.join(sources, "path", "left").withColumn("a", F.expr("try_cast(a as int)")).withColumn("b", F.expr("try_cast(b as int)"))
    n = F.size(F.split("source", "\n", -1))
    reason = F.when(F.col("path").isNull(), "malformed").when(F.col("source").isNull(), "missing").when((F.col("a") < 1) | (F.col("b") < F.col("a")) | (F.col("b") > n), "out-of-range")
    reason = reason.when(T.span_hash(F.col("source"), F.greatest(F.lit(1), F.col("a")), F.col("b")) != F.col("h"), "hash")
    return j.select("page", "token", reason.alias("reason")).where("reason is not null")


def blocks(view: DataFrame, info: str) -> DataFrame:
    """(page, start, body): fenced blocks with exactly this info string, in any case; empty ones are dropped, an open one runs to the end."""
    w = Window.partitionBy("page").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.ltrim("text").startswith("```")
    f = view.where("fenced").withColumn("mark", mark).withColumn("k", F.sum(F.col("mark").cast("int")).over(w))
    f = f.withColumn("n", F.floor((F.col("k") + 1) / 2)).withColumn("opens", F.col("mark") & (F.col("k") % 2 == 1))
    g = f.groupBy("page", "n").agg(F.min("line").alias("start"), F.min(F.when(F.col("opens"), F.lower(F.trim(F.regexp_replace("text", "`", ""))))).alias("info"), F.sort_array(F.collect_list(F.when(~F.col("mark"), F.struct("line", "text")))).alias("x"))
    return g.where((F.col("info") == info.lower()) & (F.size("x") > 0)).select("page", "start", F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("body"))


def severity(cited: Column, name: Column) -> Column:
    """A claim about a known entity: Warning where its line cites or the name is short, else Error."""
    return F.when(cited | (F.length(name) <= 4), "Warning").otherwise("Error")
