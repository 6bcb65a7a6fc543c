"""Politeness windows against a plain Python loop, with and without busy sites."""

from __future__ import annotations

import random
from collections import deque
from datetime import datetime, timedelta

import pytest

from crawlframe import schemas
from crawlframe.operators import politeness as P
from crawlframe.plans import fixtures

T0 = datetime(2024, 1, 1)
EPOCH = datetime(1970, 1, 1)


def micros(t: datetime) -> int:
    return (t - EPOCH) // timedelta(microseconds=1)


def replay(rows):
    """One fetch after the other, as a crawler would see them."""
    states, out = {}, {}
    for authority, event, start, duration, status in sorted(rows, key=lambda r: (r[2], r[1])):
        window, state = states.get(authority, (deque(maxlen=10), (None, None)))
        if status == 200:
            window.append(max(duration, 150_000))
            average = sum(window) // len(window)
            state = (average, micros(start) + 3 * average)
        states[authority] = (window, state)
        out[authority, event] = state
    return out, {a: s for a, (_, s) in states.items() if s[0] is not None}


def make_log(seed: int, n: int, busy_share: float, gaps: bool):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        authority = "busy.x" if rng.random() < busy_share else f"s{rng.randrange(12)}.x"
        status = rng.choice([200, 200, 200, 404, 429, 503])
        if gaps and authority == "busy.x" and (i // 60) % 3 == 1:
            status = 500  # long stretches without a sample
        start = T0 + timedelta(microseconds=rng.randrange(50) + 1000 * (i // 3))
        rows.append((authority, i, start, rng.randrange(0, 900_000), status))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,share,gaps,parts", [(1, 0.4, False, 40), (2, 0.6, True, 60), (3, 0.0, False, 1), (4, 1.0, True, 200)])
def test_equals_replay(spark, seed, share, gaps, parts):
    rows = make_log(seed, 1200, share, gaps)
    log = spark.createDataFrame(rows, schemas.FETCH_LOG)
    expected, latest = replay(rows)
    got = {(r.authority, r.event_id): (r.avg_us, r.until_us) for r in P.politeness(log, parts).collect()}
    assert got == expected
    ends = {r.authority: (r.avg_us, r.until_us) for r in P.next_allowed(log).collect()}
    assert ends == latest


def test_busy_sites_are_cut_evenly(spark):
    rows = make_log(5, 3000, 0.5, False)
    log = P.clamped(spark.createDataFrame(rows, schemas.FETCH_LOG))
    sizes = [r["count"] for r in P.time_chunks(log, 20).filter("authority = 'busy.x'").groupBy("_chunk").count().collect()]
    assert len(sizes) >= 8
    assert max(sizes) < 3000 / 20 * 2


def test_one_instant_is_cut_too(spark):
    """Many fetches of one site at the same time are dealt by event id."""
    rows = [("busy.x", i, T0, 150_000 + i * 7 % 1000, 200 if i % 3 else 404) for i in range(2000)]
    log = spark.createDataFrame(rows, schemas.FETCH_LOG)
    sizes = [r["count"] for r in P.time_chunks(P.clamped(log), 20).groupBy("_chunk").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 2000 / 20 * 3
    got = {(r.authority, r.event_id): (r.avg_us, r.until_us) for r in P.politeness(log, 20).collect()}
    assert got == replay(rows)[0]


def test_edges(spark):
    def at(s):
        return T0 + timedelta(seconds=s)

    rows = [("a", 0, at(0), 400_000, 404), ("a", 1, at(1), 100, 200), ("a", 2, at(2), 450_000, 200),
            ("a", 3, at(3), 1, 429), ("b", 4, at(0), 5, 503)]
    rows += [("c", 10 + i, at(i), 200_000 + i, 200) for i in range(12)]
    got = {(r.authority, r.event_id): (r.avg_us, r.until_us)
           for r in P.politeness(spark.createDataFrame(rows, schemas.FETCH_LOG)).collect()}
    assert got["a", 0] == (None, None)
    assert got["a", 1] == (150_000, micros(at(1)) + 450_000)
    assert got["a", 2] == (300_000, micros(at(2)) + 900_000)
    assert got["a", 3] == got["a", 2]
    assert got["b", 4] == (None, None)
    assert got["c", 19][0] == 200_000 + 45 // 10
    assert got["c", 20][0] == 200_000 + 55 // 10
    assert got["c", 21][0] == 200_000 + 65 // 10


def test_known_checksum(spark):
    """The log of the survey (50 sites by user number) has a known sum."""
    sf = "/root/testdata/sf0.01"
    first = fixtures.sites(spark, sf).selectExpr("page_id AS slot", "authority").filter("slot < 50")
    log = fixtures.events(spark, sf).selectExpr("*", "user_id % 50 AS slot").join(first, "slot").selectExpr(
        "authority", "event_id", "cast(ts AS timestamp) AS start",
        "cast(greatest(round(value * 10000), 0) AS bigint) AS duration_us",
        "CASE event_type WHEN 'purchase' THEN 404 WHEN 'error' THEN 503 ELSE 200 END AS status",
    )
    got = P.politeness(log).selectExpr(
        "count(1) AS n", "count(until_us) AS k", "sum(cast(until_us AS decimal(38,0))) AS s"
    ).first()
    assert (got.n, got.k, int(got.s)) == (10000, 9975, 17010963549600469599)
