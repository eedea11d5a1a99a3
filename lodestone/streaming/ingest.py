"""Incremental ingestion with Structured Streaming: upserts, new addresses, topic filters, a time-limited cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import stem
from ..operators.classify import TOPICS, holds_any
from ..sources.versions import Conflict, VersionedTable


class SnapshotTable(VersionedTable):
    """A versioned table that streams and folders of notes are put into; see ``sources.versions``."""

    def current(self) -> tuple[int, DataFrame | None]:
        """Number of the last version, whoever wrote it, and the table as of then."""
        v = self.version()
        return v.number, None if v.schema is None else self.read(v.number)


def upsert_stream(rows: DataFrame, table: VersionedTable, checkpoint: str, tries: int = 5) -> StreamingQuery:
    """Replace each micro-batch's keys in the table, rewriting only their buckets. A batch that this stream, named by its checkpoint, has
    put there before is left out when it comes again: the version that holds it says so. Streams can share a table: the one that is
    second to a version begins its batch anew upon the other's."""

    def apply(batch: DataFrame, n: int) -> None:
        for k in range(tries):
            base = table.version()
            if base.streams.get(checkpoint, -1) >= n:
                return
            try:
                table.upsert(batch, (checkpoint, n), base)
                return
            except Conflict:
                if k == tries - 1:
                    raise

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_only(rows: DataFrame, key: str, ts: str | None = None, delay: str = "7 days") -> DataFrame:
    """The first row of each key; with an event time, state older than ``delay`` is let go."""
    return rows.dropDuplicates([key]) if ts is None else rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def on_topic(rows: DataFrame, title: str = "title", topics: tuple[str, ...] = TOPICS) -> DataFrame:
    return rows.where(holds_any(F.col(title), topics))


def cached(calls: DataFrame, key: str, seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """(key, ts, hit) of a stream of calls (key, ts): whether the key's last call is within ``seconds``.

    State is one time stamp a key; it goes when event time, which may be ``late``, has passed it by ``seconds``, so that the state is that
    of the keys of this time and not of all keys ever. Calls that come later than ``late`` are left out.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ts = np.sort(np.concatenate([p["ts"].to_numpy("datetime64[us]") for p in parts]))
        before = np.concatenate([[np.datetime64(state.get[0], "us") if state.exists else np.datetime64("NaT")], ts[:-1]])
        state.update((int(ts[-1].astype(np.int64)),))
        # A timer must lie behind the watermark, which may be past an old call already.
        ends = int(ts[-1].astype(np.int64)) // 1000 + seconds * 1000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(ts), "ts": ts, "hit": ts - before <= np.timedelta64(seconds, "s")})

    kind = calls.schema[key].dataType.simpleString()
    timed = calls.select(key, "ts").withWatermark("ts", late)
    return timed.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, ts timestamp, hit boolean", "last long", "append", "EventTimeTimeout")


BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch_folder(spark: SparkSession, root: str, table: VersionedTable, checkpoint: str, rows: Callable[[DataFrame], DataFrame], pattern: str = "*.md", archive: str | None = None, tries: int = 5) -> StreamingQuery:
    """Put the files below ``root`` that the table doesn't have into it and move them to ``archive`` (None: delete them).

    ``rows`` turns files (source, filename, content, modified) into the table's rows, whose key is the source. A micro-batch is one version,
    which names the stream and the batch: a run that is killed before that version leaves the files for the next, one killed after it finds
    the batch there. Files go only when a later batch, or the next run, has seen that theirs was committed.
    """
    clean = {"cleanSource": "delete"} if archive is None else {"cleanSource": "archive", "sourceArchiveDir": archive}
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).options(**clean).load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    files = raw.select(path.alias("source"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified")).withColumn("filename", stem(F.col("source")))

    def apply(batch: DataFrame, n: int) -> None:
        for k in range(tries):
            base = table.version()
            if base.streams.get(checkpoint, -1) >= n:
                return
            old = table.read(base.number) if base.schema else None
            new = batch if old is None else batch.join(old.select("source").distinct(), "source", "left_anti")
            try:
                table.append(rows(new), (checkpoint, n), base)
                return
            except Conflict:
                if k == tries - 1:
                    raise

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, by: str, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def run_once(rows: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there and hand each micro-batch to ``sink``."""
    q = rows.writeStream.outputMode(mode).foreachBatch(lambda b, _: sink(b)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
