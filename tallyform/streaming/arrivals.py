"""What a stream of files has seen, kept in state: contents once each, and paths until they stop changing."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ARRIVAL = "sha256 string, path string, modificationTime timestamp"
OBSERVATION = "path string, length long, modificationTime timestamp, observed_at timestamp"
SETTLED = "path string, length long, modificationTime timestamp, verdict string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Per content: the first path that brought it. Emits a content once, ever."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "path string, modificationTime timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = min(((r["modificationTime"], r["path"]) for r in rows), default=None)
        if first is not None and not self.first.exists():
            self.first.update((first[1], first[0]))
            yield Row(sha256=key[0], path=first[1], modificationTime=first[0])

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.first.update((initialState["path"], initialState["modificationTime"]))


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of streams that start from here on lies in RocksDB on the executors, with its changes in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def first_seen(images: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """ARRIVAL rows of a stream of images whose content neither the stream nor ``held`` (a ledger's images) had before.

    The state is one entry per content, in RocksDB: a batch looks up its own contents, however many were seen before.
    held is read once, when the stream first starts.
    """
    keep_state_on_disk(images.sparkSession)
    start = None if held is None else held.select("sha256", "path", F.col("processed_at").alias("modificationTime")).groupBy("sha256")
    return images.select("sha256", "path", "modificationTime").groupBy("sha256").transformWithState(FirstSeen(), ARRIVAL, "Append", "None", start)


class Settling(StatefulProcessor):
    """Per path: the last size and time, and until when to wait. Emits a verdict once for each state of a file."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "length long, changed long, done boolean, deadline long")

    def _wait(self, now: int, before: int | None) -> int:
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(now + self.wait_ms)
        return now + self.wait_ms

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        length, changed, done, deadline = self.held.get() if self.held.exists() else (None, None, False, None)
        for r in sorted(rows, key=lambda r: r["observed_at"]):
            if deadline is None:
                deadline = self._wait(now, None)
            same = r["length"] > 0 and (r["length"], r["changed"]) == (length, changed)
            if not same:
                if done:
                    deadline = self._wait(now, deadline)  # a new state of a file that had settled
                length, changed, done = r["length"] or None, r["changed"], False
            elif done:
                deadline = self._wait(now, deadline)  # still there, told already
            else:
                done = True
                yield Row(path=key[0], length=length, changed=changed, verdict="stable")
        self.held.update((length, changed, done, deadline))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        length, changed, done, _ = self.held.get()
        if not done:
            yield Row(path=key[0], length=length or 0, changed=changed, verdict="timed_out" if length else "empty")
        self.held.clear()


def settled(observations: DataFrame, wait_seconds: float = 12.0) -> DataFrame:
    """SETTLED rows of a stream of OBSERVATION: a path is stable when two observations in a row agree in size and time
    and it isn't empty. A path that doesn't come to rest within the wait is timed_out, or empty if nothing was in it.

    A path's state goes when it was not seen for the wait after its verdict; a file that changes again gets a new one.
    Waits run by the clock, so start the stream with a processing-time trigger: one that ends when its input does
    (``availableNow``) would go on for as long as any wait may run out.
    """
    keep_state_on_disk(observations.sparkSession)
    looks = observations.select("path", "length", F.unix_micros("modificationTime").alias("changed"), "observed_at")
    told = looks.groupBy("path").transformWithState(Settling(int(wait_seconds * 1000)), "path string, length long, changed long, verdict string", "Append", "ProcessingTime")
    return told.select("path", "length", F.timestamp_micros("changed").alias("modificationTime"), "verdict")


class FolderWatch(DataSource):
    """``spark.readStream.format("folder_watch").load(folder)``: what a mounted folder holds, each time the stream looks."""

    @classmethod
    def name(cls) -> str:
        return "folder_watch"

    def schema(self) -> str:
        return OBSERVATION

    def simpleStreamReader(self, schema: Any) -> SimpleDataSourceStreamReader:
        return _FolderReader(self.options["path"])


class _FolderReader(SimpleDataSourceStreamReader):
    """The offset counts the looks. A look that is repeated after a failure sees the folder as it is then."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"looks": 0}

    def _look(self) -> Iterator[tuple]:
        from datetime import UTC, datetime

        now, found = datetime.now(UTC), []
        for entry in os.scandir(self.path):
            try:
                if entry.is_file():
                    stat = entry.stat()
                    found.append((entry.path, stat.st_size, datetime.fromtimestamp(stat.st_mtime_ns // 1000 / 1e6, UTC), now))
            except FileNotFoundError:
                continue  # moved away meanwhile
        return iter(found)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return self._look(), {"looks": start["looks"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._look()
