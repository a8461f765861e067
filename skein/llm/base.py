"""Shared pieces of the training-data operators: table reading, written tables, word pattern."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a word, in the syntax that Java, Python and RE2 share.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a local master gets a folder of its own (tests); a cluster gets an error, as its executors' folders are not shared.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = os.path.join(tempfile.gettempdir(), "skein-shared")
        os.makedirs(where, exist_ok=True)
        where = f"file://{where}"
    return where.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a path."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the application's folder and read it back.

    This cuts lineage: a lost executor costs a reread of files, not a recomputation, and the file sizes give the
    optimizer true statistics for later joins. What drop_table does not delete before goes with the application.
    """
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/skein/{spark.sparkContext.applicationId}"
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, target = _file_system(spark, own)
    files.deleteOnExit(target)
    back = spark.read.schema(df.schema).parquet(path)
    back._skein_path = path
    return back


#: Rows and bytes of a batch that goes between Spark and Python, for operators that send texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits for Arrow batches to BATCH.

    With Spark's own limits a batch of long texts takes tens of MB, in the executor's memory outside its heap, which keeps what it once took, and in each Python worker.
    """
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """At the end of a Python task: give memory that it has freed back to the system, as its worker goes on to other tasks beside a JVM that needs it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def drop_table(*tables: DataFrame | None) -> None:
    """Delete tables that write_table made and that no later step reads, and with them the shuffle files that only they needed: Spark's cleaner deletes those once the
    driver's garbage is collected."""
    for df in tables:
        path = getattr(df, "_skein_path", None)
        if path:
            files, target = _file_system(df.sparkSession, path)
            files.delete(target, True)
    for context in {df.sparkSession.sparkContext for df in tables if getattr(df, "_skein_path", None)}:
        context._jvm.System.gc()


def free(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as set it apart from `columns` (case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as Spark's expressions take it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


#: Keys that hold more than one in so many rows are joined by broadcast.
HOT_SHARE = 1024


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """`rows` with the other columns of `table`, which has at most one row a key; null keys match null keys; rows without a match get nulls.

    A key with more than one in `share` of the rows is a hot one, so there are fewer than `share` of them, whatever the tables' sizes: those meet their row of `table` by broadcast
    and don't move. The others, of which none is large, meet by a shuffled join.
    """
    most = rows.count() / share
    n, *own = free([*rows.columns, *table.columns], "n_rows", *(f"key{i}" for i in range(len(keys))))
    hot = write_table(rows.groupBy(*map(quoted, keys)).agg(F.count("*").alias(n)).where(F.col(n) > most).drop(n), "hot-keys")
    columns = [*rows.columns, *(c for c in table.columns if c not in keys)]

    def joined(a: DataFrame, b: DataFrame, how: str, small: bool) -> DataFrame:
        b = b.select(*(F.col(quoted(k)).alias(n) for k, n in zip(keys, own, strict=True)), *(F.col(quoted(c)) for c in b.columns if c not in keys))
        on = reduce(and_, (F.col(quoted(k)).eqNullSafe(F.col(n)) for k, n in zip(keys, own, strict=True)))
        return a.join(F.broadcast(b) if small else b, on, how)

    if hot.isEmpty():
        return joined(rows, table, "left", False).select(*map(quoted, columns))
    busy = joined(joined(rows, hot, "left_semi", True), joined(table, hot, "left_semi", True), "left", True)
    rest = joined(joined(rows, hot, "left_anti", True), table, "left", False)
    return busy.select(*map(quoted, columns)).union(rest.select(*map(quoted, columns)))
