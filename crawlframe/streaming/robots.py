"""Robots freshness per authority over a stream of robots.txt fetches, and retries that come due.

The state of an authority is keyed state in RocksDB. It does not depend on the
order in which fetches arrive, and it does not hold them one by one. What a later
arrival can still change follows from: the spans of time in which fetches follow
each other within the retry delay, each with its newest fetch; the newest fetch
that was no failure; and the failures after that one. A run of failures thus begins where
the batch operator says, also when a success between two failures comes last.

After a failure the site is due again in ``RETRY_SECONDS``, unless it was fetched
once more until then. An event-time timer decides that when the watermark has
passed the due time (one timer per site, for its next one), so a fetch that arrives late, within the lateness allowed,
still cancels the retry, and each retry is emitted once.
"""

from __future__ import annotations

import posixpath
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crawlframe.functions import robots as R
from crawlframe.streaming.politeness import PROVIDER, ROCKSDB

POINT = "at_us bigint, event_id bigint, access string"
SPAN = f"first_us bigint, {POINT}, told boolean"
EVENT = (
    "authority string, kind string, access string, updated_us bigint, first_tried_us bigint, due_us bigint"
)
STATE = "authority string, access string, updated timestamp, first_tried timestamp"
RETRY = "authority string, failed timestamp, due timestamp"

# A micro-batch then stores what it changed, not the whole store of each partition.
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"

RETRY_US = R.RETRY_SECONDS * 1_000_000
DOWN = "Unreachable"

Point = tuple[int, int, str]
Span = tuple[int, Point, bool]


@dataclass
class Fetches:
    """What the fetches of one authority amount to; bounded by time, but for failures in a row.

    ``spans``: (time of the first fetch, newest fetch, whether its retry was
    emitted), in order, more than the retry delay apart. A failure is due again
    only if it is the newest fetch of its span. ``ok``: the newest fetch that is
    no failure. ``failures``: the failures after it, in order.
    """

    spans: list[Span] = field(default_factory=list)
    ok: Point | None = None
    failures: list[Point] = field(default_factory=list)

    def add(self, batch: pd.DataFrame) -> None:
        """Take in some fetches, whenever they were made and however often they came before."""
        if batch.empty:
            return
        batch = batch.astype({"start_us": "int64", "event_id": "int64"}).sort_values(["start_us", "event_id", "access"])
        times, ids, access = (batch[name].to_numpy() for name in ("start_us", "event_id", "access"))

        def points(at: np.ndarray) -> list[Point]:
            return [(int(a), int(e), x) for a, e, x in zip(times[at], ids[at], access[at])]

        heads = np.concatenate([[0], np.flatnonzero(np.diff(times) > RETRY_US) + 1])
        lasts = np.append(heads[1:], len(times)) - 1
        fresh = [(int(first), last, False) for first, last in zip(times[heads], points(lasts))]
        self.spans = joined(self.spans + fresh)
        down = access == DOWN
        good = np.flatnonzero(~down)
        if len(good):
            newest = points(good[-1:])[0]
            self.ok = newest if self.ok is None else max(self.ok, newest)
            down[: good[-1]] = False
        failures = set(self.failures).union(points(np.flatnonzero(down)))
        self.failures = sorted(p for p in failures if self.ok is None or p > self.ok)

    def forget(self, limit: int) -> None:
        """Leave out what fetches from ``limit`` on cannot change; call it when no older ones can come."""
        self.spans = [s for s in self.spans[:-1] if s[1][0] >= limit or waits(s)] + self.spans[-1:]
        old = bisect_left(self.failures, (limit,))
        del self.failures[1:old]

    def due(self, passed_ms: int) -> list[int]:
        """Times of the failures that have come due, each once."""
        found = [s[1][0] for s in self.spans if waits(s) and due_ms(s[1]) <= passed_ms]
        self.spans = [(a, p, told or (p[2] == DOWN and due_ms(p) <= passed_ms)) for a, p, told in self.spans]
        return found

    def state(self) -> tuple[str, int, int | None]:
        """Latest access and its time, and when the run of failures began that it belongs to."""
        at, _, access = self.spans[-1][1]
        return access, at, None if access != DOWN else self.failures[0][0]


def waits(span: Span) -> bool:
    return span[1][2] == DOWN and not span[2]


def joined(spans: list[Span]) -> list[Span]:
    """Spans in order, those within the retry delay of each other as one."""
    out: list[Span] = []
    for first, last, told in sorted(spans):
        if out and first - out[-1][1][0] <= RETRY_US:
            before = out[-1]
            if last == before[1]:
                told = told or before[2]
            elif last < before[1]:
                last, told = before[1:]
            out[-1] = (before[0], last, told)
        else:
            out.append((first, last, told))
    return out


class RobotsState(StatefulProcessor):
    """:class:`Fetches` of one authority, and its timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", SPAN)
        self.failures = handle.getListState("failures", POINT)
        self.ok = handle.getValueState("ok", POINT)

    def _load(self) -> Fetches:
        spans = self.spans.get() if self.spans.exists() else ()
        failures = self.failures.get() if self.failures.exists() else ()
        return Fetches(
            [(int(first), (int(a), int(e), x), bool(told)) for first, a, e, x, told in spans],
            point_of(self.ok.get()) if self.ok.exists() else None,
            [point_of(row) for row in failures],
        )

    def _store(self, fetches: Fetches) -> None:
        self.spans.put([(first, *last, told) for first, last, told in fetches.spans])
        if fetches.failures:
            self.failures.put(fetches.failures)
        else:
            self.failures.clear()
        if fetches.ok:
            self.ok.update(fetches.ok)
        self._wake_for(fetches)

    def _wake_for(self, fetches: Fetches) -> None:
        """One timer per authority: for the failure that comes due next."""
        wanted = min((due_ms(s[1]) for s in fetches.spans if waits(s)), default=None)
        for timer in self.handle.listTimers():
            if timer == wanted:
                wanted = None
            else:
                self.handle.deleteTimer(timer)
        if wanted is not None:
            self.handle.registerTimer(wanted)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fetches = self._load()
        for batch in rows:
            fetches.add(batch)
        fetches.forget(timerValues.getCurrentWatermarkInMs() * 1000 - RETRY_US)
        self._store(fetches)
        access, updated, first = fetches.state()
        yield pd.DataFrame(
            {
                "authority": [key[0]], "kind": ["state"], "access": [access], "updated_us": [updated],
                "first_tried_us": pd.array([first], "Int64"), "due_us": pd.array([None], "Int64"),
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        fetches = self._load()
        due = fetches.due(passed)
        fetches.forget(timerValues.getCurrentWatermarkInMs() * 1000 - RETRY_US)
        self._store(fetches)
        if due:
            yield pd.DataFrame(
                {
                    "authority": key[0], "kind": "retry", "access": DOWN, "updated_us": due,
                    "first_tried_us": pd.array([None] * len(due), "Int64"),
                    "due_us": pd.array([d + RETRY_US for d in due], "Int64"),
                }
            )

    def close(self) -> None:
        pass


def point_of(row: tuple) -> Point:
    return int(row[0]), int(row[1]), row[2]


def due_ms(point: Point) -> int:
    return -(-(point[0] + RETRY_US) // 1000)


def events(log: DataFrame, lateness: str) -> DataFrame:
    """Streaming frame of changed states and due retries (``EVENT``)."""
    narrow = log.select(
        "authority", "start", F.unix_micros("start").alias("start_us"), "event_id", F.expr(R.access("status")).alias("access")
    )
    return (
        narrow.withWatermark("start", lateness)
        .groupBy("authority")
        .transformWithStateInPandas(RobotsState(), EVENT, "Update", "EventTime")
    )


def start(
    log: DataFrame,
    root: str,
    checkpoint: str,
    trigger: Mapping[str, object] | None = None,
    lateness: str = "7 days",
) -> StreamingQuery:
    """Follow ``log`` (authority, event_id, start, status); running a batch again is harmless.

    Every micro-batch writes the states that it changed and the retries that came
    due to a folder of its own, once. Fetches that arrive more than ``lateness`` after
    newer ones of any site are dropped by the watermark. ``trigger`` holds the
    arguments of Spark's trigger.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        path = posixpath.join(root, f"batch_id={batch_id}")
        batch.write.mode("overwrite").partitionBy("kind").parquet(path)

    writer = (
        events(log, lateness)
        .writeStream.foreachBatch(step)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    conf = log.sparkSession.conf
    settings = {PROVIDER: ROCKSDB, CHANGELOG: "true"}
    before = {key: conf.get(key, None) for key in settings}
    for key, value in settings.items():
        conf.set(key, value)
    try:
        return writer.start()
    finally:
        for key, value in before.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)


def _read(spark: SparkSession, root: str, kind: str) -> DataFrame:
    rows = spark.read.schema(f"{EVENT}, batch_id bigint").parquet(root)
    return rows.filter(F.col("kind") == kind)


def latest(spark: SparkSession, root: str) -> DataFrame:
    """Newest state of each authority."""
    newest = _read(spark, root, "state").groupBy("authority").agg(
        F.max_by(F.struct("access", "updated_us", "first_tried_us"), "batch_id").alias("s")
    )
    return newest.select(
        "authority", "s.access", F.timestamp_micros("s.updated_us").alias("updated"),
        F.timestamp_micros("s.first_tried_us").alias("first_tried"),
    )


def due_retries(spark: SparkSession, root: str) -> DataFrame:
    """All retries that came due so far (``RETRY``): sites whose robots.txt is to be fetched again."""
    return _read(spark, root, "retry").select(
        "authority", F.timestamp_micros("updated_us").alias("failed"), F.timestamp_micros("due_us").alias("due")
    )
