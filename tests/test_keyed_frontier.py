"""The bucketed frontier: same rows as the plain one, and a history that stays where it is."""

from __future__ import annotations

import random
import re

import pytest

from crawlframe import schemas
from crawlframe.operators import frontier
from crawlframe.session import fresh_path
from crawlframe.sources.keyed_frontier import KeyedFrontier

OFFER = "name string, path string, query string, context string"


def store_at(spark, path=None):
    return KeyedFrontier(spark, path or fresh_path(spark, "keyed"), buckets=4)


def offer(spark, rows):
    return spark.createDataFrame([(*r, "Other") for r in rows], OFFER)


def keys(store, before=None):
    url, domain = store.read("url", before), store.read("domain", before)
    rows = frontier.named(url, domain).select(*frontier.KEY).collect()
    return sorted((r.name, r.path, "-" if r.query is None else r.query) for r in rows)


def random_rows(rng, n):
    return list({(f"s{rng.randrange(5)}.x", f"/p{rng.randrange(30)}", rng.choice([None, "", "a=1"])) for _ in range(n)})


def test_batches_equal_the_plain_merge(spark):
    rng = random.Random(2)
    store = store_at(spark)
    seen: set = set()
    for batch in range(3):
        rows = random_rows(rng, 60)
        store.add(offer(spark, rows), batch)
        before = set(seen)
        seen |= set(rows)
        added = store.read("url").filter(f"batch_id = {batch}").count()
        assert added == len(seen - before)
    assert keys(store) == sorted((n, p, "-" if q is None else q) for n, p, q in seen)
    ids = [r.url_id for r in store.read("url").collect()]
    assert sorted(ids) == list(range(1, len(seen) + 1))
    domains = [(r.domain_id, r.name) for r in store.read("domain").collect()]
    assert sorted(d for d, _ in domains) == list(range(1, 6)) and len({n for _, n in domains}) == 5


def test_a_batch_runs_again(spark):
    store = store_at(spark)
    store.add(offer(spark, [("a.x", "/1", None), ("a.x", "/1", "")]), 0)
    store.add(offer(spark, [("a.x", "/1", None), ("b.x", "/2", None)]), 1)
    after = keys(store)
    store.add(offer(spark, [("a.x", "/1", None), ("b.x", "/2", None)]), 1)
    assert keys(store) == after == [("a.x", "/1", ""), ("a.x", "/1", "-"), ("b.x", "/2", "-")]
    store.add(offer(spark, []), 1)  # the same batch, now with nothing
    assert keys(store) == after[:2] and store.read("domain").count() == 1
    assert store.next_ids(2) == (2, 3)


def test_another_session_finds_the_tables(spark):
    path = fresh_path(spark, "keyed")
    store_at(spark, path).add(offer(spark, [("a.x", "/1", None)]), 0)
    for table in ("url", "domain", "handed_out"):
        spark.sql(f"DROP TABLE {store_at(spark, path).name(table)}")
    again = store_at(spark, path)
    assert keys(again) == [("a.x", "/1", "-")]
    again.add(offer(spark, [("a.x", "/1", None), ("a.x", "/2", None)]), 1)
    assert [p for _, p, _ in keys(again)] == ["/1", "/2"]


def test_hand_out_and_mark(spark):
    store = store_at(spark)
    rows = [("a.x", f"/{k:02d}", None) for k in range(25)] + [("b.x", "/", None)]
    store.add(offer(spark, rows), 0)
    turns = []
    for batch in range(4):
        out = store.hand_out(batch)
        turns.append(sorted((r.name, r.path, r.rank, r.turn) for r in out.collect()))
        store.mark(out, batch)
    assert [len(t) for t in turns] == [11, 10, 5, 0]
    assert turns[0][:10] == [("a.x", f"/{k:02d}", k + 1, 10 - k) for k in range(10)]
    assert turns[0][10] == ("b.x", "/", 1, 1) and turns[2][0] == ("a.x", "/20", 1, 5)
    store.mark(store.hand_out(0), 0)  # the first turn again
    assert store.read("handed_out").count() == 26
    assert {r.name for r in store.hand_out(0, names=["b.x", "none"]).collect()} == {"b.x"}


@pytest.mark.parametrize("what", ["fresh", "waiting"])
def test_the_history_is_not_moved(spark, what):
    """The only exchange is that of the batch; the history is a bucketed scan right under the join's sort."""
    store = store_at(spark)
    store.add(offer(spark, [("a.x", f"/{k}", None) for k in range(50)]), 0)
    store.mark(store.hand_out(0), 0)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        if what == "fresh":
            plan = store.fresh(offer(spark, [("a.x", "/1", None)]), 1)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        else:
            rows = store.read("url").select("key", "url_id", "domain_id")
            gone = store.read("handed_out").select("key")
            plan = rows.join(gone.hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 0 and plan.count("Bucketed: true") == 2
        assert re.search("SortMergeJoin", plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_schemas_agree(spark):
    store = store_at(spark)
    plain = {f.name for f in schemas.empty(spark, schemas.URL).schema}
    assert set(store.read("url").columns) == plain | {"key"}
