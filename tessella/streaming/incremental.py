"""Incremental work as streams: new files and edits in micro-batches, restartable from their checkpoint."""

from __future__ import annotations

import json
import os
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Intervals in which quick changes are gathered (seconds): search, layout, work queue.
DEBOUNCE = {"search": 0.15, "layout": 0.25, "queue": 0.4}
EDITS = "path string, field string, seq long, value string"


def new_files(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def commit_batches(stream: DataFrame, folder: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Run ``work`` over each micro-batch of what is there now and append its result, one directory for each batch.

    A batch that is run again after a failure overwrites its own directory, so results are neither lost nor doubled.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def fold_edits(stream: DataFrame, folder: str, checkpoint: str, interval: float | None = None) -> StreamingQuery:
    """Append each batch's latest value of every (path, field) of an edit stream to a log; ``present`` folds the log.

    Quick edits of one field within a batch become one change. ``interval`` in seconds (DEBOUNCE has the usual ones), or
    all that is there now. A batch that runs again overwrites its own directory.
    """
    from tessella.operators.catalog import latest

    def write(batch: DataFrame, number: int) -> None:
        latest(batch.select("path", "field", "seq", "value"), ["path", "field"], ["seq", "value"]).write.mode("overwrite").parquet(f"{folder}/log/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{interval} seconds") if interval else writer.trigger(availableNow=True)).start()


def present(spark: SparkSession, folder: str) -> DataFrame:
    """(path, field, seq, value): the compacted edits and the log after them, folded."""
    from pyspark.errors import AnalysisException

    from tessella.operators.catalog import latest
    from tessella.sources.stores import read_table

    rows = read_table(spark, f"{folder}/compacted", EDITS)
    try:
        rows = rows.unionByName(spark.read.schema(EDITS).parquet(f"{folder}/log").select(*rows.columns))
    except AnalysisException:  # no log yet
        pass
    return latest(rows, ["path", "field"], ["seq", "value"])


def compact(spark: SparkSession, folder: str) -> int:
    """Write the present edits as one table. Log rows that it has are folded in again without effect, so the log may stay
    until no stream writes it; returns the version."""
    from tessella.sources.stores import write_table

    return write_table(present(spark, folder), f"{folder}/compacted")


def sounds(stream: DataFrame, key: str, at: str, level: str, threshold: float, gap: str, late: str) -> DataFrame:
    """(key, start, end, frames) of sounds in a stream of levels: session windows over loud frames, closed by a gap.

    A session window ends one gap after its last frame; ``end`` is that frame's own time.
    """
    loud = stream.where(F.col(level) >= threshold).withWatermark(at, late)
    found = loud.groupBy(key, F.session_window(at, gap).alias("_w")).agg(F.count("*").alias("frames"), F.max(at).alias("end"))
    return found.select(key, F.col("_w.start").alias("start"), "end", "frames")


def windowed_levels(stream: DataFrame, key: str, at: str, x: Column, window: str, late: str) -> DataFrame:
    """(key, start, rms) of tumbling windows, with late rows up to a watermark."""
    grouped = stream.withWatermark(at, late).groupBy(key, F.window(at, window).alias("_w"))
    return grouped.agg(F.sqrt(F.avg(x * x)).alias("rms")).select(key, F.col("_w.start").alias("start"), "rms")


class Progress(StreamingQueryListener):
    """Counts what the streams of a session have done: {name: {batches, rows}}."""

    def __init__(self):
        self.done: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event):  # noqa: N802
        self.done.setdefault(event.name or str(event.id), {"batches": 0, "rows": 0})

    def onQueryProgress(self, event):  # noqa: N802
        mine = self.done.setdefault(event.progress.name or str(event.progress.id), {"batches": 0, "rows": 0})
        mine["batches"] += 1
        mine["rows"] += event.progress.numInputRows

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass


class Cancellation:
    """A job group that can be cancelled from another thread; a scan commits nothing then, other steps keep whole batches."""

    def __init__(self, spark: SparkSession, group: str):
        self.spark, self.group = spark, group

    def __enter__(self):
        self.spark.addTag(self.group)
        return self

    def __exit__(self, *_):
        self.spark.removeTag(self.group)

    def cancel(self) -> None:
        self.spark.interruptTag(self.group)


class Watch:
    """While a command runs: its tasks so far in a JSON file, and an end to its jobs when a file appears."""

    SECONDS = 0.04

    def __init__(self, spark: SparkSession, progress: str = "", cancel: str = ""):
        self.spark, self.progress, self.cancel, self.over = spark, progress, cancel, threading.Event()
        self.thread = threading.Thread(target=self._watch, daemon=True)

    def __enter__(self):
        self.tag = f"watch-{uuid.uuid4().hex}"
        self.spark.sparkContext.addJobTag(self.tag)
        if self.progress or self.cancel:
            self.thread.start()
        return self

    def __exit__(self, *_):
        self.over.set()
        if self.thread.is_alive():
            self.thread.join()
        self.spark.sparkContext.removeJobTag(self.tag)

    def _watch(self) -> None:
        while not self.over.wait(self.SECONDS):
            if self.progress:
                self._tell()
            if self.cancel and os.path.exists(self.cancel):
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
        if self.progress:
            self._tell(True)

    def _tell(self, over: bool = False) -> None:
        tracker = self.spark.sparkContext.statusTracker()
        stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
        counts = {"done": sum(s.numCompletedTasks for s in stages), "total": sum(s.numTasks for s in stages), "over": over}
        with open(f"{self.progress}.tmp", "w", encoding="utf-8") as f:
            json.dump(counts, f)
        os.replace(f"{self.progress}.tmp", self.progress)
