"""File-change events: folds, flush rules, and the streaming operator that holds events back until a quiet gap or a deadline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.functions import text as T
from skein.sources.files import NOISE, ROOT_NOISE, language

QUIET_MS, DEADLINE_MS = 2000, 5000


def kind_of(raw: Column) -> Column:
    return F.when(raw == "create", "Created").when(raw == "remove", "Deleted").otherwise("Modified")


def ignored(path: Column, output: str | None = None) -> Column:
    """Whether a path is not watched: in the output folder, in noise at any depth, or in root noise right below the watched folder, which is the path's first name."""
    p = F.regexp_replace(T.normal_path(path), "^([A-Za-z]:)?/+", "")
    s = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    noise = F.exists(s, lambda x: x.isin(*NOISE)) | F.coalesce(F.get(s, F.lit(1)).isin(*ROOT_NOISE), F.lit(False))
    if output is None:
        return noise
    out = output.replace("\\", "/").rstrip("/")
    return noise | (T.normal_path(path) == out) | T.normal_path(path).startswith(f"{out}/")


def reported(events: DataFrame, output: str | None = None) -> DataFrame:
    """Events (path, …) of source files that are not ignored."""
    return events.where(~ignored(F.col("path"), output) & language(F.col("path")).isNotNull())


def batch_groups(events: DataFrame, output: str | None = None) -> DataFrame:
    """(kind, n, paths) of a batch of raw events (path, raw): reported paths by kind, each once, sorted."""
    x = reported(events, output).select(kind_of(F.col("raw")).alias("kind"), "path").distinct()
    return x.groupBy("kind").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("paths"))


def run(events: DataFrame, update: Callable[[DataFrame], None], full: Callable[[], None], checkpoint: str, output: str | None = None) -> StreamingQuery:
    """Watch a stream of events (stream, path, raw): a full run first, then one update for each batch of changes (kind, paths) that a quiet gap or the deadline releases."""
    full()
    held = hold(reported(events, output).select("stream", "path", kind_of(F.col("raw")).alias("kind")))

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            update(batch.select("kind", "paths"))

    return held.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def fold(events: DataFrame) -> DataFrame:
    """(path, kind, first): the last kind of each path of events (path, kind, seq), and where it was first seen."""
    return events.groupBy("path").agg(F.max_by("kind", "seq").alias("kind"), F.min("seq").alias("first"))


def fold_batch(events: DataFrame) -> DataFrame:
    """(path, kind) within one batch: Deleted beats Modified beats Created."""
    rank = F.when(F.col("kind") == "Deleted", 0).when(F.col("kind") == "Modified", 1).otherwise(2)
    return events.groupBy("path").agg(F.min_by("kind", rank).alias("kind"))


def groups(folded: DataFrame) -> DataFrame:
    """(kind, paths): one event a kind, paths in the order first seen."""
    x = folded.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("first", "path"))).alias("x"))
    return x.select("kind", F.transform("x", lambda r: r["path"]).alias("paths"))


def sessions(events: DataFrame, key: str, ts: str, seq: str, gap_s: int) -> DataFrame:
    """(key, n, first): runs of a key's events with less than gap_s between neighbours."""
    w = Window.partitionBy(key).orderBy(ts, seq)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    starts = F.when(F.lag(ts).over(w).isNull() | (at - F.lag(at).over(w) >= gap_s * 1_000_000), 1).otherwise(0)
    x = events.withColumn("starts", starts).withColumn("session", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return x.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(seq).alias("first")).drop("session")


def flushes(events: DataFrame, quiet_s: float, deadline_s: float) -> DataFrame:
    """(stream, flush, n, first, last) of events (stream, ts, seq): a flush ends after quiet_s without event or deadline_s since its first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, start, last = [], None, None
        for ts, seq in pdf.sort_values(["ts", "seq"])[["ts", "seq"]].itertuples(index=False):
            if start is None or (ts - last).total_seconds() >= quiet_s or (ts - start).total_seconds() >= deadline_s:
                start = ts
                out.append([pdf["stream"].iloc[0], len(out), 0, seq, seq])
            last = ts
            out[-1][2] += 1
            out[-1][4] = seq
        return pd.DataFrame(out, columns=["stream", "flush", "n", "first", "last"])

    return events.groupBy("stream").applyInPandas(run, "stream string, flush int, n long, first long, last long")


def hold(events: DataFrame, quiet_ms: int = QUIET_MS, deadline_ms: int = DEADLINE_MS) -> DataFrame:
    """Streaming (stream, kind, paths) of events (stream, path, kind): what flushes() does, on processing time and with folded paths.

    State is one pending map a stream; it is flushed by a timer at the quiet gap or the deadline, whichever comes first, and both clocks start anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        paths, kinds, first = state.get if state.exists else ([], [], now)
        pending = dict(zip(paths, kinds, strict=True))
        if state.hasTimedOut:
            state.remove()
            rows = [(key[0], k, [p for p, v in pending.items() if v == k]) for k in dict.fromkeys(pending.values())]
            yield pd.DataFrame(rows, columns=["stream", "kind", "paths"])
            return
        for b in batches:
            for path, kind in zip(b["path"], b["kind"], strict=True):
                pending[path] = kind
        state.update((list(pending), list(pending.values()), first))
        state.setTimeoutDuration(max(1, min(quiet_ms, first + deadline_ms - now)))
        yield pd.DataFrame([], columns=["stream", "kind", "paths"])

    return events.groupBy("stream").applyInPandasWithState(step, "stream string, kind string, paths array<string>", "paths array<string>, kinds array<string>, first long", "append", "ProcessingTimeTimeout")
