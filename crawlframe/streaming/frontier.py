"""Incremental frontier: every micro-batch of fetches adds only unseen URLs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from crawlframe.operators.dispatch import Extractor
from crawlframe.plans.crawl_round import crawl_round
from crawlframe.sources.frontier_store import FrontierStore
from crawlframe.sources.keyed_frontier import KeyedFrontier


def start(
    fetched: DataFrame,
    rules: DataFrame | Callable[[], DataFrame],
    store: FrontierStore | KeyedFrontier,
    checkpoint: str,
    extractors: Mapping[str, Extractor] | None = None,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Run the batch round on each micro-batch.

    A batch sees the frontier as it was before it and replaces its own
    folders, so a batch that runs twice adds nothing twice. Its rejects and
    retries are stored too. With a :class:`KeyedFrontier` the URLs known before
    are not moved. ``rules`` may be a function that reads the rules
    anew for every batch. ``trigger`` holds the arguments of Spark's trigger.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        now = rules() if callable(rules) else rules
        if isinstance(store, KeyedFrontier):
            done = crawl_round(
                batch, now, None, None, batch_id, extractors, merge=lambda offered: store.merge(offered, batch_id)
            )
        else:
            known = store.read("domain", batch_id), store.read("url", batch_id)
            done = crawl_round(batch, now, *known, batch_id, extractors)
        store.write_round(done, batch_id)

    return (
        fetched.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
