"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local master gets a folder of its own (tests), and a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = os.path.join(tempfile.gettempdir(), "skein-tables")
        os.makedirs(where, exist_ok=True)
        where = f"file://{where}"
    return where.rstrip("/")


class Scratch:
    """Tables of one computation: Parquet in a folder of its own, which cuts lineage. What drop() doesn't delete before goes with the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def _files(self, path: str):
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(context._jsc.hadoopConfiguration()), target

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n}"
        df.write.parquet(path)
        if self._n == 1:
            files, target = self._files(self.path)
            files.deleteOnExit(target)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch = path
        return back

    def folder(self) -> str:
        """A folder for files of another kind."""
        self._n += 1
        files, target = self._files(f"{self.path}/{self._n}")
        files.mkdirs(target)
        files.deleteOnExit(target)
        return f"{self.path}/{self._n}"

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            if getattr(df, "_scratch", None):
                files, target = self._files(df._scratch)
                files.delete(target, True)
