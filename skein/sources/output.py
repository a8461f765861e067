"""What a run leaves behind: rendered files, HTML, indexes for agents, timings and the cached call index, each put in place in one step on any file system that Spark knows."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.markdown import to_html


class Folder:
    """A folder on any file system that Hadoop's client reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        path = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def put(self, name: str, content: str) -> None:
        """Write a draft, flush it to disk, and rename it over what is there; a reader sees the old file or the new one."""
        draft, target = self._path(f"{name}.draft"), self._path(name)
        out = self.files.create(draft, True)
        try:
            out.write(bytearray(content.encode()))
            out.hsync()
        finally:
            out.close()
        self._rename(draft, target)

    def place(self, draft: str, name: str) -> None:
        """Rename a draft over what is there; one that is gone has been renamed before."""
        if self.files.exists(self._path(draft)):
            self.files.mkdirs(self._path(name).getParent())
            self._rename(self._path(draft), self._path(name))

    def _rename(self, draft, target) -> None:
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.files.getConf())
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE")
        context.rename(self.files.makeQualified(draft), self.files.makeQualified(target), options)

    def get(self, name: str) -> str | None:
        if not self.files.exists(self._path(name)):
            return None
        stream = self.files.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def glob(self, pattern: str) -> list:
        """Hadoop's statuses of what fits a pattern below the folder."""
        return list(self.files.globStatus(self._path(pattern)) or ())

    def whole(self) -> str:
        """The folder's path as statuses have it."""
        return self.files.makeQualified(self._path("")).toString().rstrip("/")

    def remove(self, name: str, whole: bool = False) -> bool:
        return self.files.delete(self._path(name), whole)


#: Where names of drafts that wait for their places are kept.
PENDING = ".pending.json"


def write_files(files: DataFrame, root: str) -> int:
    """Write files (path: relative, content) below a root; of rows that repeat a path the greatest content. Gives how many there were.

    Executors write the contents as drafts, a folder each, under Spark's commit protocol: what a failed or repeated task attempt leaves doesn't count, and without all of them
    nothing goes on. Then a manifest names each draft's place, the drafts are renamed, and the manifest goes; a writer that finds one left behind ends its work first. Only names reach the driver. Spark's text writer ends a row with a separator,
    so files are written by their last character, each without it; empty ones are made by name.
    """
    spark, folder = files.sparkSession, Folder(files.sparkSession, root)
    finish(folder)
    drafts = f".drafts-{uuid.uuid4().hex}"
    rows = files.groupBy("path").agg(F.coalesce(F.max("content"), F.lit("")).alias("content")).withColumn("last", F.right("content", F.lit(1)))
    kinds = {r["last"]: r["n"] for r in rows.groupBy("last").agg(F.count("*").alias("n")).collect()}  # one row a character that files end in
    for last in kinds:
        if last:
            some = rows.where(F.col("last") == last).select(F.sha2("path", 256).alias("name"), F.left("content", F.length("content") - 1).alias("value"))
            some.write.mode("append").option("lineSep", last).partitionBy("name").text(f"{folder.root}/{drafts}")
    names = [r["path"] for r in rows.select("path").toLocalIterator()]
    empty = {r["path"] for r in rows.where("last = ''").select("path").toLocalIterator()}
    at = {hashlib.sha256(n.encode()).hexdigest(): n for n in names if n not in empty}
    where = {}
    for status in folder.glob(f"{drafts}/name=*/part-*"):
        _, name, part = str(status.getPath().toString()).rsplit("/", 2)
        where[f"{drafts}/{name}/{part}"] = at[name.removeprefix("name=")]
    folder.put(PENDING, json.dumps({"drafts": drafts, "files": where, "empty": sorted(empty)}))
    finish(folder)
    return sum(kinds.values())


def finish(folder: Folder) -> None:
    """Put pending drafts in place; those that are there already are left."""
    pending = json.loads(folder.get(PENDING) or "null")
    if pending:
        for draft, name in pending["files"].items():
            folder.place(draft, name)
        for name in pending["empty"]:
            folder.put(name, "")
        folder.remove(PENDING)
        folder.remove(pending["drafts"], True)


def write_lines(lines: DataFrame, root: str, name: str, head: str = "") -> None:
    """One file of lines (part, place, line) in that order, parts apart by a blank line."""
    body, part = [head] if head else [], None
    for row in lines.orderBy("part", "place").toLocalIterator():
        if part is not None and row.part != part:
            body.append("")
        part = row.part
        body.append(row.line)
    Folder(lines.sparkSession, root).put(name, "\n".join(body) + "\n")


STYLE = "body{max-width:50em;margin:2em auto;font-family:sans-serif}pre{overflow:auto;background:#eee;padding:.5em}"


def html_pages(pages: DataFrame) -> DataFrame:
    """(path, content): an HTML page for each page (page, title, text) in markdown, links to pages changed to their HTML, and an index of all pages by title."""
    rewritten = pages.select("page", "title", T.rewrite_links(F.col("text")).alias("text"))

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            yield b.assign(body=[to_html(t or "") for t in b["text"]])[["page", "title", "body"]]

    body = rewritten.mapInPandas(run, "page string, title string, body string")
    head = F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>'), T.escape_html(F.col("title")), F.lit(f"</title><style>{STYLE}</style>\n"))
    return body.select(F.concat("page", F.lit(".html")).alias("path"), F.concat(head, "body").alias("content"))


def write_html(pages: DataFrame, root: str) -> int:
    """html_pages below a root, with index.html."""
    n = write_files(html_pages(pages), root)
    link = F.concat(F.lit('<li><a href="'), "page", F.lit('.html">'), T.escape_html(F.col("title")), F.lit("</a></li>"))
    write_lines(pages.select(F.lit(0).alias("part"), "title", link.alias("line")).withColumnRenamed("title", "place"), root, "index.html", f'<!doctype html><meta charset="utf-8"><style>{STYLE}</style><ul>')
    return n


def write_timings(spark: SparkSession, root: str, timings: dict[str, int]) -> None:
    """Milliseconds of a run's stages."""
    Folder(spark, root).put("timings.json", json.dumps({k: int(v) for k, v in sorted(timings.items())}))


def cached_call_index(index: DataFrame, root: str, state: str) -> DataFrame:
    """The call index (name, callers, callees) as it was written for this state of the sources (a commit, or a state's size and time), else written now."""
    spark, folder = index.sparkSession, Folder(index.sparkSession, root)
    key = hashlib.sha256(state.encode()).hexdigest()[:16]
    if folder.get("call-index.json") != key:
        index.write.mode("overwrite").parquet(f"{root.rstrip('/')}/call-index-{key}")
        folder.put("call-index.json", key)
    return spark.read.schema(index.schema).parquet(f"{root.rstrip('/')}/call-index-{key}")
