"""Source trees as tables: scans, scope, fingerprints, parse cache, markdown pages, SQL blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.sources.ignore import Ignored, Rule, rules
from skein.sources.output import Folder

# Limits, extensions and directory names that scans go by. Noise is left out at any depth, root noise only right below the root.
MOST_FILES, MOST_BYTES = 100_000, 5 * 1024 * 1024
BINARY = (
    "exe", "dll", "bin", "png", "jpg", "jpeg", "gif", "ico", "svg", "pdf", "ttf", "woff", "woff2", "eot", "zip", "tar",
    "gz", "7z", "rar", "mp3", "mp4", "avi", "mov", "wasm", "o", "obj", "lib", "a", "so", "dylib", "pyc", "class",
)
LANGUAGES = {"rs": "rust", "py": "python", "go": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "cs": "csharp"}
NOISE = (
    "node_modules", ".venv", "venv", "vendor", "Pods", "Library", "target", ".next", ".nuxt", ".output",
    "coverage", ".cache", "__pycache__", ".pytest_cache", ".mypy_cache", "bower_components", "fixtures", ".git",
)
ROOT_NOISE = ("dist", "build", "out", "bin", "obj", "Packages", "Temp", "Logs")


def language(path: Column) -> Column:
    """The language of a path by its extension, case counting; null where none is known."""
    ext = T.extension(path)
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, F.lit(name)).otherwise(out)
    return out


def is_binary(path: Column) -> Column:
    return F.lower(T.extension(path)).isin(*BINARY)


def is_noise(path: Column) -> Column:
    """Whether a directory of a relative path is noise: some names anywhere, some only at the root."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    return F.exists(dirs, lambda x: x.isin(*NOISE)) | F.coalesce(F.try_element_at(dirs, F.lit(1)).isin(*ROOT_NOISE), F.lit(False))


def glob_regex(glob: str) -> str:
    """A regular expression for a path pattern: * stays in a directory, ** does not, a pattern without slash holds at any depth."""
    out, i = "", 0
    body = glob.strip("/")
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = body[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "_/-" else c), i + 1
    return ("^" if "/" in body or glob.startswith("/") else "(?:^|/)") + out + "(?:/|$)"


def in_scope(path: Column, include: list[str], exclude: list[str]) -> Column:
    ok = F.lit(True)
    if include:
        ok = path.rlike("|".join(map(glob_regex, include)))
    return ok & ~path.rlike("|".join(map(glob_regex, exclude))) if exclude else ok


def _listing(spark: SparkSession, root: str, include: list[str], exclude: list[str], ignored: list[str] | None) -> DataFrame:
    """(path, language, length, at) of source files below a root, of any size, by their names alone: nothing is opened. Paths are relative; `at` is where the file lies."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = root.rstrip("/").split("://", 1)[-1]
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//)?", ""), "^/+", "/"), "^" + "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in base) + "/*", "")
    files = raw.select(T.normal_path(path).alias("path"), "length", F.col("path").alias("at")).withColumn("language", language(F.col("path")))
    files = files.where(F.col("language").isNotNull() & ~is_binary(F.col("path")) & ~is_noise(F.col("path")) & in_scope(F.col("path"), list(include), exclude))
    held = ignore_rules(spark, root) if ignored is None else {"": rules("\n".join(ignored))}
    if not any(held.values()):
        return files

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Ignored(held)
        for b in batches:
            yield b.filter(pa.array([not known.file(p) for p in b["path"].to_pylist()], pa.bool_()))

    return files.mapInArrow(keep, files.schema)


def ignore_rules(spark: SparkSession, root: str) -> dict[str, list[Rule]]:
    """The rules of all ignore files below a root by their directory, noise left out: one look a level, as Spark's readers pass over names that begin with a dot."""
    folder, out, level = Folder(spark, root), {}, ""
    while True:
        found = [str(f.getPath().toString()) for f in folder.glob(f"{level}.gitignore")]
        for where in found:
            below = where.rpartition("/")[0].removeprefix(folder.whole()).strip("/")
            if not set(below.split("/")) & set(NOISE):
                out[below] = rules(folder.get(f"{below}/.gitignore".lstrip("/")) or "")
        level += "*/"
        if not folder.glob(level):
            return out


def _contents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """files (path, language, length, at) with their content; only these are opened. There are MOST_FILES at most."""
    named = files.select("path", "language", "at").limit(MOST_FILES + 1).collect()
    if len(named) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} source files; at most as many are read")
    schema = "path string, language string, length long, content binary"
    if not named:
        return spark.createDataFrame([], schema)
    raw = spark.read.format("binaryFile").load([re.sub(r"([\\\[\]{}*?,])", r"\\\1", r["at"]) for r in named])
    own = spark.createDataFrame([tuple(r) for r in named], "path string, language string, at string")
    return raw.select(F.col("path").alias("at"), "length", "content").join(F.broadcast(own), "at").select("path", "language", "length", "content")


def scan(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), ignored: list[str] | None = None) -> DataFrame:
    """(path, language, length, source, sha256) of the supported source files below a root; ignored paths, oversized files and those that are no text are left
    out (skipped() has the latter), and too many files are an error. Ignore files count at every level, unless `ignored` has patterns instead; what is left out by its name or size is never opened."""
    files = _contents(spark, _listing(spark, root, include, list(exclude), ignored).where(F.col("length") <= MOST_BYTES))
    source = F.expr("try_validate_utf8(content)")
    return files.select("path", "language", "length", source.alias("source"), F.sha2("content", 256).alias("sha256")).where("source is not null")


def skipped(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), ignored: list[str] | None = None) -> DataFrame:
    """(path, reason) of source files that a scan leaves out: oversized, or no UTF-8 text. They count as failed."""
    files = _listing(spark, root, include, list(exclude), ignored)
    large = files.where(F.col("length") > MOST_BYTES).select("path", F.lit("oversized").alias("reason"))
    odd = _contents(spark, files.where(F.col("length") <= MOST_BYTES)).where(F.expr("try_validate_utf8(content)").isNull())
    return large.union(odd.select("path", F.lit("no text")))


def sql_files(paths: DataFrame) -> DataFrame:
    """(path) of SQL files, of any case, outside noise and directories that begin with a dot."""
    dirs = F.slice(F.split("path", "/"), 1, F.greatest(F.lit(0), F.size(F.split("path", "/")) - 1))
    return paths.where((F.lower(T.extension(F.col("path"))) == "sql") & ~is_noise(F.col("path")) & ~F.exists(dirs, lambda x: x.startswith("."))).select("path")


# Files with a project's conventions; of two for one slot the later one counts.
CONVENTIONS = (("AGENTS.md", 0), (".editorconfig", 1), ("rustfmt.toml", 2), (".rustfmt.toml", 2), ("clippy.toml", 3), ("CONTRIBUTING.md", 4), ("docs/glossary.md", 5))
CONVENTION_BYTES = 32 * 1024


def convention_files(files: DataFrame) -> DataFrame:
    """(slot, path, text) of a project's convention files among files (path, text): the last of each slot that is not blank, up to CONVENTION_BYTES of whole characters."""
    known = F.create_map(*[F.lit(x) for place, (name, slot) in enumerate(CONVENTIONS) for x in (name, slot * 100 + place)])
    x = files.withColumn("at", F.try_element_at(known, F.col("path"))).where(F.col("at").isNotNull() & (F.trim("text") != ""))
    x = x.withColumn("slot", F.floor(F.col("at") / 100)).groupBy("slot").agg(F.max_by(F.struct("path", "text"), "at").alias("x"))
    cut = F.expr(f"left(x.text, {CONVENTION_BYTES})")  # a character has a byte at least
    # lengths in bytes of the beginnings: the longest that fits
    sizes = F.transform(F.split(cut, ""), lambda c: F.octet_length(c))
    full = F.lit(CONVENTION_BYTES)
    step = lambda s, b: F.when(s["b"] + b <= full, F.struct((s["n"] + 1).alias("n"), (s["b"] + b).alias("b"))).otherwise(F.struct(s["n"].alias("n"), (full + 1).alias("b")))
    whole = F.expr("left(cut, fits)")
    x = x.withColumn("cut", cut).withColumn("fits", F.aggregate(sizes, F.struct(F.lit(0).alias("n"), F.lit(0).alias("b")), step, lambda s: s["n"]))
    return x.select("slot", F.col("x.path").alias("path"), F.when(F.octet_length("cut") <= CONVENTION_BYTES, F.col("cut")).otherwise(whole).alias("text"))


def path_names(paths: DataFrame) -> DataFrame:
    """(name): directory names and file stems of relative paths (path)."""
    p = T.normal_path(F.col("path"))
    s = F.split(p, "/")
    return paths.select(F.explode(F.array_append(F.slice(s, 1, F.size(s) - 1), T.file_stem(p))).alias("name")).where("name <> ''").distinct()


def lint_sources(entities: DataFrame, imports: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """What checks of pages need of entities (path, name, line_start, line_end), imports (path, source) and files (path): ranges, names, path_names, name_files and import_heads."""
    return {
        "ranges": entities.select("path", F.col("line_start").alias("start"), F.col("line_end").alias("end")),
        "names": entities.select("name").distinct(),
        "path_names": path_names(files),
        "name_files": entities.select("name", "path").distinct(),
        "import_heads": files.select("path").join(imports.select("path", F.element_at(F.split("source", "::"), 1).alias("head")).distinct(), "path", "left"),
    }


def every_file(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below a root, whatever they are; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def cached(files: DataFrame, cache: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused, to_parse): cache rows (path, sha256, …) of unchanged files, and the files to parse; a path in changed (path) is parsed whatever its hash."""
    same = cache.join(files.select("path", "sha256"), ["path", "sha256"], "left_semi").join(changed.select("path"), "path", "left_anti")
    return same, files.join(same.select("path"), "path", "left_anti")


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache, empty where it is missing or cannot be read."""
    try:
        found = spark.read.schema(schema).parquet(path)
        found.limit(1).collect()
        return found
    except Exception:  # a cache may be missing or damaged in any way; a full parse makes it anew
        return spark.createDataFrame([], schema)


def write_cache(df: DataFrame, path: str) -> None:
    df.orderBy("path").write.mode("overwrite").parquet(path)


def pages(spark: SparkSession, root: str, deep: bool = False) -> DataFrame:
    """(page, language, text) of markdown files: one directory level a language, or any depth."""
    r = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.md")
    df = r.option("recursiveFileLookup", "true").text(root) if deep else r.text(f"{root}/*/")
    path = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(path, r"([^/]+)\.md$", 1).alias("page"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("language"), F.col("value").alias("text"))


def create_table_blocks(files: DataFrame) -> DataFrame:
    """(path, start, block): statements of files (path, text) from a line that begins CREATE TABLE, in any case, to the first line with ';'; open ones are dropped."""
    x = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    w = Window.partitionBy("path").orderBy("line")
    begins = F.upper(F.ltrim("text")).startswith("CREATE TABLE")
    ends = F.col("text").contains(";")
    x = x.withColumn("begin", begins).withColumn("end", ends)
    # inside a block a second start is text: a block is what follows the first start after an end
    x = x.withColumn("after", F.coalesce(F.last(F.when(F.col("end"), F.col("line")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    x = x.withColumn("start", F.min(F.when(F.col("begin"), F.col("line"))).over(Window.partitionBy("path", "after").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    g = x.where("start is not null").groupBy("path", "start").agg(F.bool_or("end").alias("closed"), F.sort_array(F.collect_list(F.struct("line", "text"))).alias("x"))
    return g.where("closed").select("path", F.col("start").cast("long").alias("start"), F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("block"))


def repository_list(lines: DataFrame) -> DataFrame:
    """(line, name, location, commit, error) of 'name | path-or-url | commit' lines (line, text); comments and blanks are skipped; a missing name is the
    location's last segment."""
    x = lines.where(~F.trim("text").startswith("#") & (F.trim("text") != "")).withColumn("p", F.transform(F.split("text", r"\|"), lambda c: F.trim(c)))
    location = F.when(F.size("p") == 1, F.col("p")[0]).otherwise(F.try_element_at("p", F.lit(2)))
    name = F.when((F.size("p") == 1) | (F.col("p")[0] == ""), F.regexp_extract(F.regexp_replace(location, r"(\.git)?/*$", ""), "([^/]+)$", 1)).otherwise(F.col("p")[0])
    error = F.when((F.size("p") > 3) | (location == ""), F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": malformed")))
    return x.select("line", name.alias("name"), location.alias("location"), F.nullif(F.try_element_at("p", F.lit(3)), F.lit("")).alias("commit"), error.alias("error"))
