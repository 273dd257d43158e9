"""Structured Streaming over a library: file changes and chunked signals."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phonolith.schema import EXTENSIONS
from phonolith.sources import files
from phonolith.sources.scratch import scratch_folder, written


def new_files(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (path, modified_at) of audio files as they appear; contents are not read."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(root)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return files.where(extension.isin(*EXTENSIONS)).select("path", F.col("modificationTime").alias("modified_at"))


def watch(spark: SparkSession, root: str, checkpoint: str, changed: Callable[[int], None], every: str = "3 seconds", available_now: bool = False) -> StreamingQuery:
    """Call changed(number of files) once for each batch that is not empty; the trigger's interval is the debounce.

    Spark's file source tells of each path once and never of deletions, so a
    change is only news; what changed is found by sources.files.difference.
    """

    def tell(batch: DataFrame, _: int) -> None:
        if n := batch.count():
            changed(n)

    writer = new_files(spark, root).writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


class Debounce:
    """What changed in a folder since the last event, told once it has been quiet for some seconds.

    ``look`` lists the folder (in tasks) and compares it with the listing before;
    an event compares with the listing of the last event, so a file that came and
    went in one burst is no news, and deletions are.
    """

    def __init__(self, spark: SparkSession, root: str, changed: Callable[[dict[str, int]], None], quiet: float = 3.0, clock: Callable[[], float] = time.monotonic):
        self.spark, self.root, self.changed, self.quiet, self.clock = spark, root, changed, quiet, clock
        self.told = self.before = self._listed()
        self.moved: float | None = None

    def _listed(self) -> DataFrame:
        return written(files.list_tree(self.spark, self.root).select("path", "modified_at"), scratch_folder(self.spark, "listing"))

    def _counts(self, now: DataFrame, then: DataFrame) -> dict[str, int]:
        news = files.difference(now, then).where("status <> 'unchanged'").groupBy("status").agg(F.count("*").alias("n"))
        return {r["status"]: r["n"] for r in news.collect()}  # three numbers at most

    def look(self) -> None:
        now = self._listed()
        if self._counts(now, self.before):
            self.before, self.moved = now, self.clock()
        elif self.moved is not None and self.clock() - self.moved >= self.quiet:
            news, self.told, self.moved = self._counts(now, self.told), now, None
            if news:
                self.changed(news)


def watch_debounced(spark: SparkSession, root: str, checkpoint: str, changed: Callable[[dict[str, int]], None], quiet: float = 3.0, every: str = "1 second") -> StreamingQuery:
    """Call changed({new, changed, missing: how many}) once after each burst, when nothing has moved for quiet seconds."""
    state = Debounce(spark, root, changed, quiet)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, nth: state.look()).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def chunked(samples: DataFrame, rate: int, seconds: float = 2.0) -> DataFrame:
    """Fixed-size chunks of a stream (or table) of (asset_id, frame, sample); use output mode update or complete."""
    size = max(1, int(rate * seconds))
    return samples.groupBy("asset_id", F.floor(F.col("frame") / size).cast("long").alias("chunk")).agg(F.min("frame").alias("first_frame"), F.count("*").alias("n_frames"), F.max(F.abs("sample")).alias("peak"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: counts and sums by event type and time window, with a watermark for late rows."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


class SingleFlight:
    """At most one scan at a time: a second start is a no-op."""

    def __init__(self):
        self._lock = threading.Lock()

    @contextmanager
    def start(self):
        """Yields whether this caller may run."""
        mine = self._lock.acquire(blocking=False)
        try:
            yield mine
        finally:
            if mine:
                self._lock.release()


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs started inside carry the tag; cancel(spark, tag) from another thread ends them."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)
