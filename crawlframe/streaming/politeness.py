"""Politeness state per authority over a stream of fetches.

Before the shuffle every Arrow batch keeps only the last ten status-200 rows of
each authority: no older sample can count. The keyed state then sees a handful
of rows even for an authority that owns most of the stream.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crawlframe.operators.politeness import FLOOR_US, SAMPLES, WAIT_FACTOR

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAMPLE = "authority string, start_us bigint, event_id bigint, d bigint"
STATE = "authority string, avg_us bigint, until_us bigint"


def last_samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        good = batch[batch["status"] == 200]
        good = good.assign(d=good["duration_us"].clip(lower=FLOOR_US))
        good = good.sort_values(["authority", "start_us", "event_id"])
        yield good.groupby("authority").tail(SAMPLES)[["authority", "start_us", "event_id", "d"]]


class PolitenessState(StatefulProcessor):
    """The last ten samples of one authority; older ones are dropped as rows arrive."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "start_us bigint, event_id bigint, d bigint"
        self.samples = handle.getListState("samples", schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh: list[tuple[int, int, int]] = []
        for batch in rows:
            values = batch[["start_us", "event_id", "d"]].itertuples(index=False, name=None)
            fresh = sorted([*fresh, *values])[-SAMPLES:]
        # Late rows take their place by time, wherever they arrive.
        kept = sorted(tuple(int(v) for v in s) for s in [*self.samples.get(), *fresh])[-SAMPLES:]
        self.samples.put(kept)
        average = sum(s[2] for s in kept) // len(kept)
        until = kept[-1][0] + WAIT_FACTOR * average
        yield pd.DataFrame({"authority": [key[0]], "avg_us": [average], "until_us": [until]})

    def close(self) -> None:
        pass


def states(log: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Streaming frame with the new state of every authority that had a status 200."""
    narrow = log.select(
        "authority", F.unix_micros("start").alias("start_us"), "event_id", "duration_us", "status"
    )
    return (
        narrow.mapInPandas(last_samples, SAMPLE)
        .groupBy("authority")
        .transformWithStateInPandas(
            PolitenessState(ttl_ms), STATE, "Update", "ProcessingTime" if ttl_ms else "None"
        )
    )


def start(
    log: DataFrame,
    root: str,
    checkpoint: str,
    ttl_ms: int | None = None,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Follow ``log`` and write the changed states of each micro-batch to its own folder.

    The keyed state needs the RocksDB store; the session's own choice is put back
    once the query has started with it.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(posixpath.join(root, f"batch_id={batch_id}"))

    writer = (
        states(log, ttl_ms)
        .writeStream.foreachBatch(step)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
    )
    conf = log.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        conf.set(PROVIDER, before)


def latest(spark: SparkSession, root: str) -> DataFrame:
    """Newest state of each authority."""
    written = spark.read.schema(STATE + ", batch_id bigint").parquet(root)
    return written.groupBy("authority").agg(
        F.max_by(F.struct("avg_us", "until_us"), "batch_id").alias("s")
    ).select("authority", "s.avg_us", "s.until_us")
