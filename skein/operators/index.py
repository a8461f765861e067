"""Search indexes on disk: segments that are added, tombstones that delete by file, a manifest, compaction, incremental update."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T

SCHEMA_VERSION = 3
_MANIFEST = "version long, schema int, model string, template int, dims int, segments array<string>, tombstones array<string>, rows long"


class Index:
    """A table of rows with a `file` column below a folder. Writers add a manifest last, so a reader sees a whole version or the one before.

    Deleting adds the files' names with the segments they hold for; nothing is rewritten until compact().
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, model: str = "", template: int = SCHEMA_VERSION, by: str | None = None):
        """`by`: the column whose values are folders of a segment."""
        self.spark, self.path, self.schema, self.model, self.template, self.by = spark, path.rstrip("/"), schema, model, template, by

    def _write(self, rows: DataFrame, name: str) -> None:
        (rows.write.partitionBy(self.by) if self.by else rows.write).parquet(f"{self.path}/{name}")

    def manifest(self) -> dict:
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
            return {"version": 0, "schema": None, "model": None, "template": None, "dims": None, "segments": [], "tombstones": [], "rows": 0}
        return self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest").orderBy(F.col("version").desc()).first().asDict()

    def needs_rebuild(self) -> bool:
        """Whether there is no index, or one of another schema, model or template."""
        m = self.manifest()
        return (m["schema"], m["model"], m["template"]) != (SCHEMA_VERSION, self.model, self.template)

    def _commit(self, old: dict, **new) -> None:
        row = old | {"version": old["version"] + 1, "schema": SCHEMA_VERSION, "model": self.model, "template": self.template} | new
        self.spark.createDataFrame([tuple(row[c.split()[0]] for c in _MANIFEST.split(", "))], _MANIFEST).coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def _dims(self, rows: DataFrame, vector: str | None, known: int | None) -> int | None:
        """The one length of the vectors; an empty or odd one is an error."""
        if vector is None:
            return None
        lo, hi = rows.agg(F.min(F.coalesce(F.size(vector), F.lit(0))), F.max(F.size(vector))).first()
        if lo is not None and (lo != hi or lo == 0):
            raise ValueError(f"vectors of {lo} to {hi} components")
        return hi if hi is not None else known

    def rebuild(self, rows: DataFrame, vector: str | None = None) -> None:
        m = self.manifest()
        name = f"segment-{m['version'] + 1}"
        dims = self._dims(rows, vector, None)
        self._write(rows, name)
        self._commit(m, segments=[name], tombstones=[], dims=dims)

    def add(self, rows: DataFrame, vector: str | None = None) -> None:
        """Append rows; of another schema or with vectors of another length they make the index anew."""
        m = self.manifest()
        dims = self._dims(rows, vector, m["dims"])
        if self.needs_rebuild() or (m["dims"] is not None and dims != m["dims"]):
            return self.rebuild(rows, vector)
        name = f"segment-{m['version'] + 1}"
        self._write(rows, name)
        self._commit(m, segments=[*m["segments"], name], dims=dims)

    def rows(self) -> DataFrame:
        m = self.manifest()
        if not m["segments"]:
            return self.spark.createDataFrame([], self.schema)
        out = None
        for name in m["segments"]:
            at = int(name.rsplit("-", 1)[1])
            part = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")
            later = [f"{self.path}/{t}" for t in m["tombstones"] if int(t.rsplit("-", 1)[1]) > at]
            if later:
                part = part.join(self.spark.read.schema("file string").parquet(*later).distinct(), "file", "left_anti")
            out = part if out is None else out.unionByName(part)
        return out

    def remove(self, files: DataFrame) -> int:
        """Delete the rows of files (file), paths with either slash; gives how many there were."""
        m = self.manifest()
        gone = files.select(T.normal_path(F.col("file")).alias("file")).distinct()
        n = self.rows().join(gone, "file", "left_semi").count()
        if n:
            name = f"tombstone-{m['version'] + 1}"
            gone.write.parquet(f"{self.path}/{name}")
            self._commit(m, tombstones=[*m["tombstones"], name])
        return n

    def update(self, rows: DataFrame, changed: DataFrame, vector: str | None = None) -> None:
        """Delete the changed files (file) and add their rows; all rows where the index must be made anew."""
        if self.needs_rebuild():
            return self.rebuild(rows, vector)
        self.remove(changed)
        self.add(rows.join(changed.select(T.normal_path(F.col("file")).alias("file")).distinct(), "file", "left_semi"), vector)

    def compact(self) -> None:
        self.rebuild(self.rows())

    def clear(self) -> None:
        self._commit(self.manifest(), segments=[], tombstones=[], dims=None)

    def count(self) -> int:
        return self.rows().count()


def stale_artefacts(recorded: DataFrame, rendered: DataFrame, kept_modules: DataFrame) -> DataFrame:
    """Recorded paths (path, module) that were not rendered (path) and belong to no kept module (module); relative ones are never deleted."""
    return recorded.where(F.col("path").startswith("/")).join(rendered.select("path"), "path", "left_anti").join(kept_modules.select("module").distinct(), "module", "left_anti").select("path")


def numbered_notes(notes: DataFrame) -> DataFrame:
    """(day, seq, text) of notes (ts, text): a running number a day."""
    day = notes.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return day.withColumn("seq", F.row_number().over(Window.partitionBy("day").orderBy("ts", "text"))).select("day", "seq", "text")
