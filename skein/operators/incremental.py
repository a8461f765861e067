"""Change detection and reuse: fingerprints, entity differences, what a change invalidates, what stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import links as L
from skein.operators.links import Links


def fingerprint_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of (path, hash) tables: added, removed or changed; equal ones are left out."""
    j = old.withColumnRenamed("hash", "was").join(new.withColumnRenamed("hash", "now"), "path", "full")
    return j.where(~F.col("was").eqNullSafe(F.col("now"))).select("path", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))


def full_rebuild(files: DataFrame, by: list[str] = (), few: int = 200, share: float = 0.5, tokens: int = 200_000) -> DataFrame:
    """(*by, changed, total, rebuild) of files (*by, size, changed): below `few` changes never; above `share` of the files or `tokens` (a third of each file's bytes) yes."""
    x = files.groupBy(*by).agg(F.count_if("changed").alias("changed"), F.count("*").alias("total"), F.coalesce(F.sum(F.when(F.col("changed"), F.floor(F.col("size") / 3))), F.lit(0)).alias("t"))
    return x.select(*by, "changed", "total", ((F.col("changed") >= few) & ((F.col("changed") > share * F.col("total")) | (F.col("t") > tokens))).alias("rebuild"))


def entity_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, name, place, change) of (file, name, pos, sig, doc, a, b) versions: Added, Removed, SignatureChanged or BodyChanged.

    Entities of one name pair up in their order; what one side has beyond the other is dropped, and the group's change follows from a digest of its signatures without
    white space in their order; pairs whose range, signature and doc are equal are left out.
    """
    w = Window.partitionBy("file", "name").orderBy("pos")
    placed = lambda df: df.withColumn("place", F.row_number().over(w))

    def digests(df: DataFrame, tag: str) -> DataFrame:
        # a sum of hashes of place and signature is the same for equal lists only, and is summed up before the shuffle of rows
        one = F.xxhash64("place", T.normal_signature(F.col("sig"))).cast("decimal(38,0)")
        two = F.xxhash64(F.lit(1), "place", T.normal_signature(F.col("sig"))).cast("decimal(38,0)")
        return df.groupBy("file", "name").agg(F.struct(F.count("*").alias("n"), F.sum(one).alias("x"), F.sum(two).alias("y")).alias(tag))

    o, n = placed(old), placed(new)
    groups = digests(o, "was").join(digests(n, "now"), ["file", "name"], "full")
    added = n.join(groups.where("was is null").select("file", "name"), ["file", "name"], "left_semi").select("file", "name", "place", F.lit("Added").alias("change"))
    removed = o.join(groups.where("now is null").select("file", "name"), ["file", "name"], "left_semi").select("file", "name", "place", F.lit("Removed").alias("change"))
    fields = ("sig", "doc", "a", "b")
    side = lambda df, tag: df.select("file", "name", "place", *[F.col(c).alias(f"{tag}_{c}") for c in fields])
    differ = F.lit(False)
    for c in fields:
        differ = differ | ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    both = side(o, "o").join(side(n, "n"), ["file", "name", "place"]).where(differ).select("file", "name", "place")
    told = groups.where("was is not null and now is not null").select("file", "name", F.when(F.col("was") != F.col("now"), "SignatureChanged").otherwise("BodyChanged").alias("change"))
    return added.union(removed).union(both.join(told, ["file", "name"]).select("file", "name", "place", "change"))


def version_diff(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """entity_diff over the files (file, status) that a history names: modified ones compare, entities of deleted ones are all Removed, those of added ones Added."""
    of = lambda df, *status: df.join(files.where(F.col("status").isin(*status)).select("file").distinct(), "file", "left_semi")
    return entity_diff(of(old, "modified", "deleted"), of(new, "modified", "added"))


def interface_changed(changes: DataFrame) -> DataFrame:
    """(file, interface): whether anything but bodies changed."""
    return changes.groupBy("file").agg(F.bool_or(F.col("change") != "BodyChanged").alias("interface"))


def files_without_change(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Changed files (file) no entity of which changed; none at all if nothing changed anywhere."""
    some = changes.limit(1).select(F.lit(1).alias("one"))
    return files.join(changes.select("file").distinct(), "file", "left_anti").join(F.broadcast(some), F.lit(True), "left_semi").select("file")  # one row


def prefix_starts(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """(change, node): nodes (node, path) whose path is a change or lies below it; paths meet changes by their prefixes."""
    s = F.split("path", "/")
    p = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.array_join(F.slice(s, F.lit(1), i), "/"))).alias("change"))
    return p.join(changed.select(F.rtrim(F.regexp_replace("change", "/+$", "")).alias("change")).distinct(), "change").select("change", "node").distinct()


def reverse_references(pages: DataFrame, deleted: DataFrame) -> DataFrame:
    """Pages (page, text) that cite a deleted file (path)."""
    c = pages.select("page", F.explode(T.citations(F.col("text"))).alias("c")).select("page", F.col("c.path").alias("path"))
    return c.join(deleted, "path", "left_semi").select("page").distinct()


def vanished(members: DataFrame, files: DataFrame) -> DataFrame:
    """Modules (module, path) all of whose files are gone."""
    here = members.join(files.select("path", F.lit(True).alias("here")), "path", "left")
    return here.groupBy("module").agg(F.bool_and(F.col("here").isNull()).alias("gone")).where("gone").select("module")


def backfill(snapshot: DataFrame, *gone: DataFrame) -> DataFrame:
    """Snapshot rows (module, …) that none of the tables (module) names."""
    for g in gone:
        snapshot = snapshot.join(g.select("module").distinct(), "module", "left_anti")
    return snapshot


def sync(state: DataFrame, work: DataFrame, protected: DataFrame) -> DataFrame:
    """(path, hash): the working tree's hash wins, except for protected paths (path), which keep theirs; paths gone from the tree go."""
    p = protected.select("path", F.lit(True).alias("kept"))
    j = work.withColumnRenamed("hash", "now").join(state.withColumnRenamed("hash", "was"), "path", "full").join(p, "path", "left")
    return j.select("path", F.when(F.col("kept"), F.coalesce("was", "now")).otherwise(F.col("now")).alias("hash")).where("hash is not null")


def module_fingerprints(members: DataFrame, files: DataFrame) -> DataFrame:
    """(module, fingerprint): its files' hashes in the order of paths, joined by '|'; 'missing' where a file has none."""
    h = members.join(files, "path", "left").select("module", F.struct("path", F.coalesce("hash", F.lit("missing")).alias("hash")).alias("x"))
    return h.groupBy("module").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["hash"]), "|").alias("fingerprint"))


def manual_edits(pages: DataFrame, recorded: DataFrame, preview: int = 200) -> DataFrame:
    """(module, notes) of pages (path, module, content) whose hash is not the recorded one (path, hash): a preview of each in the order of paths."""
    e = pages.join(recorded, "path").where(F.sha2("content", 256) != F.col("hash"))
    return e.groupBy("module").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", F.left("content", F.lit(preview)).alias("t")))), lambda x: x["t"]), "\n").alias("notes"))


# Files that describe a project as a whole.
PROJECT_INPUTS = (
    "Cargo.toml", "Cargo.lock", "package.json", "pyproject.toml", "requirements.txt", "go.mod",
    "AGENTS.md", ".editorconfig", "rustfmt.toml", ".rustfmt.toml", "clippy.toml", "CONTRIBUTING.md", "glossary.md",
)


def source_changes(status: DataFrame, output: str, guide: str = "AGENTS.md") -> DataFrame:
    """Changed paths (path) of a working tree that are sources: neither the guide nor anything in the output folder."""
    p = T.normal_path(F.col("path"))
    out = output.strip("/")
    return status.where((p != guide) & (p != out) & ~p.startswith(f"{out}/"))


def no_change(state: dict, head: str | None, has_output: bool, changed: DataFrame) -> bool:
    """Whether nothing has to be done: a known last commit that is the head, no failed modules, output in place and no changed source (source_changes)."""
    last = state.get("last_commit_hash")
    return bool(last) and last == head and not state.get("failed_modules") and has_output and changed.isEmpty()


def project_inputs_changed(changed: DataFrame) -> DataFrame:
    """(path): changes to files that describe the project."""
    return changed.where(F.regexp_extract(T.normal_path(F.col("path")), "([^/]*)$", 1).isin(*PROJECT_INPUTS)).select("path")


def impact_semantic(changed: DataFrame, changes: DataFrame, nodes: DataFrame, edges: DataFrame | Links, depth: int = 3) -> DataFrame:
    """(module): modules that changed files (change) reach, given entity changes (file, change), nodes (node, path, module) and edges (src, dst, kind), or the links that they are.

    A file with a changed interface reaches what lies within `depth` imports and calls either way; any other only the modules of its own nodes. A changed body
    also reaches its direct callers. Without any entity change at all every file counts as a changed interface.
    """
    links = edges if isinstance(edges, Links) else L.of_edges(edges)
    starts = prefix_starts(nodes.where("path is not null"), changed)
    some = changes.limit(1).select(F.lit(1).alias("one"))  # one row
    interface = changes.where("change <> 'BodyChanged'").select(F.col("file").alias("change")).distinct()
    every = starts.join(F.broadcast(some), F.lit(True), "left_anti")
    wide = starts.join(interface, "change", "left_semi").union(every).select("node")
    narrow = starts.join(F.broadcast(some), F.lit(True), "left_semi").join(interface, "change", "left_anti").select("node")
    bodies = changes.where("change = 'BodyChanged'").select(F.col("file").alias("change")).distinct()
    called = starts.join(bodies, "change", "left_semi").select("node")
    hit = L.reach(links.of("Imports", "Calls"), wide, depth).union(narrow).union(L.sources(links.of("Calls"), called.distinct())).distinct()
    return nodes.join(hit, "node", "left_semi").where("module <> ''").select("module").distinct()


def module_files(modules: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path): files of the nodes (path, module) of modules (module)."""
    return nodes.where("path is not null").join(modules.select("module").distinct(), "module", "left_semi").select("path").distinct()


def output_fingerprints(pages: DataFrame) -> DataFrame:
    """(path, module, hash) of rendered pages (path, module, content)."""
    return pages.select("path", "module", F.sha2("content", 256).alias("hash"))


def survivors(changed: DataFrame, cards: DataFrame, files: DataFrame) -> DataFrame:
    """(path): files (path) that are left of modules (cards: module, path) of which a changed file is gone; they have to be read again."""
    gone = changed.select("path").join(files.select("path"), "path", "left_anti").distinct()
    hit = cards.join(gone, "path", "left_semi").select("module").distinct()
    return files.select("path").join(cards.join(hit, "module", "left_semi").select("path").distinct(), "path", "left_semi")


def update_scope(old: DataFrame, new: DataFrame, changes: DataFrame, nodes: DataFrame, edges: DataFrame | Links, cards: DataFrame, failed: DataFrame, pages: DataFrame, watched: DataFrame, depth: int = 3) -> DataFrame:
    """(path, reason): what an incremental run has to do again, each path once by its first reason.

    old and new are (path, hash). Reasons: changed (or new, or named by watched: path), removed, failed (files of modules, module, that failed before), impact
    (files of modules that the changes reach), sibling (files left of modules that lost one), reference (files of modules whose pages, page and text, cite a removed file).
    """
    diff = fingerprint_diff(old, new)
    gone = diff.where("change = 'removed'").select("path")
    touched = diff.where("change <> 'removed'").select("path").union(watched.select("path")).distinct()
    here = new.select("path")
    parts = {"changed": touched, "removed": gone, "failed": cards.join(failed.select("module").distinct(), "module", "left_semi").select("path")}
    parts["impact"] = module_files(impact_semantic(touched.withColumnRenamed("path", "change"), changes, nodes, edges, depth), nodes)
    parts["sibling"] = survivors(gone, cards, here)
    cited = reverse_references(pages, gone).select(F.col("page").alias("module"))
    parts["reference"] = cards.join(cited, "module", "left_semi").select("path")
    out = None
    for place, (reason, p) in enumerate(parts.items()):
        p = (p if reason == "removed" else p.join(here, "path", "left_semi")).select("path", F.lit(place).alias("place"), F.lit(reason).alias("reason"))
        out = p if out is None else out.union(p)
    return out.groupBy("path").agg(F.min_by("reason", "place").alias("reason"))
