"""The crawl frontier as a stateful stream (ST1-ST5): per-host queues, known paths, and politeness by timers.

Links arrive as (host, path) and are keyed by host. What a host has seen and what it still queues are maps in its state, so
a new path costs one look-up and one entry, however many there are; a value holds both ends of the queue and when the host
may be asked next. A host emits at most one request at a time, the oldest of its queue, never sooner than ``POLITE_S`` after
the one before, woken by a timer; robots.txt comes first. ``in_priority`` orders a batch of requests among hosts by policy,
for a ``foreachBatch`` sink. The stream's checkpoint is its restart (ST9). State of this kind needs the RocksDB provider
(``STATE_STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from trawlnet.operators.frontier import POLITE_S, priority

#: Session setting that the stream needs, and its value.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTPUT = "host string, path string, queue_len bigint, due_ms bigint"
ROBOTS = "/robots.txt"


class HostQueue(StatefulProcessor):
    """The state of one host: ``known`` (path: place), ``queue`` (place: path), ``at`` (head, tail, next_ms)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._known = handle.getMapState("known", "path string", "place bigint")
        self._queue = handle.getMapState("queue", "place bigint", "path string")
        self._at = handle.getValueState("at", "head bigint, tail bigint, next_ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if self._at.exists():
            head, tail, next_ms = self._at.get()
        else:
            head, tail, next_ms = 0, 0, now
            tail = self._add(ROBOTS, tail)
        for row in rows:
            tail = self._add(row["path"], tail)
        yield from self._next(key, head, tail, next_ms, now)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._next(key, *self._at.get(), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass

    def _add(self, path: str, tail: int) -> int:
        if self._known.containsKey((path,)):
            return tail
        self._known.updateValue((path,), (tail,))
        self._queue.updateValue((tail,), (path,))
        return tail + 1

    def _next(self, key: Any, head: int, tail: int, next_ms: int, now: int) -> Iterator[Row]:
        out = None
        if head < tail and now >= next_ms:
            path = self._queue.getValue((head,))[0]
            self._queue.removeKey((head,))
            out = Row(host=key[0], path=path, queue_len=tail - head, due_ms=now)
            head, next_ms = head + 1, now + POLITE_S * 1000
        self._at.update((head, tail, next_ms))
        if head < tail:
            self._handle.registerTimer(next_ms)
        if out:
            yield out


def frontier_stream(links: DataFrame) -> DataFrame:
    """Requests (host, path, queue_len, due_ms) from a stream of links (host, path)."""
    return links.select("host", "path").groupBy("host").transformWithState(HostQueue(), OUTPUT, "append", "processingTime")


def in_priority(requests: DataFrame, policy: str = "lsf") -> DataFrame:
    """ST4, SO5, SO6: a batch of requests in the order of ``policy`` among hosts."""
    return requests.withColumnRenamed("due_ms", "ts").orderBy(*priority(policy)).withColumnRenamed("ts", "due_ms")


def minute_counts(log: DataFrame, ts: str = "ts", late: str = "2 minutes") -> DataFrame:
    """ST10, ST11 on a stream: events by minute, closed when the watermark passes."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, "1 minute")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("minute"), "n")
