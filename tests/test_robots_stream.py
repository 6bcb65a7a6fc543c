"""The robots stream: any order of arrival, restarts, retries."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from crawlframe.operators.robots import run_heads
from crawlframe.session import fresh_path
from crawlframe.streaming import robots as S

LOG = "authority string, event_id bigint, start timestamp, status int"
T0 = datetime(2024, 1, 1)
DAY = 86400


def follow(spark, batches, lateness="1000 days"):
    """Deliver the batches one after the other, each with a stream that starts anew."""
    inbox, root, checkpoint = (fresh_path(spark, n) for n in ("inbox", "state", "progress"))
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(spark.createDataFrame([], LOG).schema).parquet(inbox)
        S.start(stream, root, checkpoint, lateness=lateness).awaitTermination()
    return root


def states(rows) -> dict:
    return {r.authority: (r.access, r.updated, r.first_tried) for r in rows}


def at(days: float) -> datetime:
    return T0 + timedelta(seconds=days * DAY)


@pytest.fixture(scope="module", autouse=True)
def narrow(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_late_rows_between_failures(spark):
    first = [
        ("ok_between", 1, at(3), 503), ("ok_between", 2, at(7), 503),
        ("ok_before", 1, at(3), 503), ("ok_before", 2, at(7), 503),
        ("fail_before", 1, at(5), 503),
        ("tie", 5, at(4), 200),
    ]
    second = [
        ("ok_between", 3, at(5), 200), ("ok_between", 4, at(9), 503),
        ("ok_before", 3, at(1), 200), ("ok_before", 4, at(9), 503),
        ("fail_before", 2, at(2), 500),
        ("tie", 4, at(4), 503),
        ("ok_between", 3, at(5), 200),  # delivered twice
    ]
    got = states(S.latest(spark, follow(spark, [first, second])).collect())
    assert got == {
        "ok_between": ("Unreachable", at(9), at(7)),
        "ok_before": ("Unreachable", at(9), at(3)),
        "fail_before": ("Unreachable", at(5), at(2)),
        "tie": ("Ok", at(4), None),
    }


def test_random_orders_equal_the_batch_operator(spark):
    rng = random.Random(4)
    log = [
        (f"s{rng.randrange(6)}", k, T0 + timedelta(seconds=rng.randrange(40) * DAY // 4), rng.choice([200, 404, 500, 503, 301]))
        for k in range(150)
    ]
    want = states(run_heads(spark.createDataFrame(log, LOG)).collect())
    rng.shuffle(log)
    assert states(S.latest(spark, follow(spark, [log[:50], log[50:100], log[100:]])).collect()) == want


def test_folded_points_lose_nothing(spark):
    """In time order with a short lateness the state is folded as it grows."""
    rng = random.Random(5)
    log = sorted(
        ((f"s{k % 3}", k, at(k * 0.2 + rng.random() * 0.1), rng.choice([200, 503, 503, 503])) for k in range(120)),
        key=lambda r: r[2],
    )
    want = states(run_heads(spark.createDataFrame(log, LOG)).collect())
    assert states(S.latest(spark, follow(spark, [log[:40], log[40:80], log[80:]], "1 hour")).collect()) == want


def test_retries_come_due_once(spark):
    retry = timedelta(seconds=84_000)
    batches = [
        [("quiet", 1, at(0), 503), ("again", 1, at(0), 503), ("late", 1, at(0), 503), ("ok", 1, at(0), 200)],
        [("again", 2, at(0.5), 200), ("clock", 1, at(0.9), 200)],
        [("late", 2, at(0.8), 404), ("clock", 2, at(1.2), 200)],  # late, but before the watermark has passed the due time
        [("clock", 3, at(3), 200), ("quiet", 2, at(2.5), 500)],
        [("clock", 4, at(6), 200)],
    ]
    root = follow(spark, batches, "12 hours")
    got = sorted(tuple(r) for r in S.due_retries(spark, root).collect())
    assert got == [("quiet", at(0), at(0) + retry), ("quiet", at(2.5), at(2.5) + retry)]


def frame(points):
    return pd.DataFrame(points, columns=["start_us", "event_id", "access"])


def test_a_busy_site_holds_few_points():
    """Before, every fetch within the lateness was held and loaded again for each batch."""
    held = S.Fetches()
    log = [(k * 1_000_000, k, "Unreachable" if k % 5 == 0 else "Ok") for k in range(50_000)]
    for part in range(0, len(log), 10_000):
        held.add(frame(log[part : part + 10_000][::-1]))
    assert held.spans == [(0, log[-1], False)] and held.ok == log[-1] and not held.failures


@pytest.mark.parametrize("seed", range(30))
def test_what_is_held_equals_all_points(seed):
    rng = random.Random(seed)
    step = S.RETRY_US // 4
    log = [(rng.randrange(60) * step, rng.randrange(9), rng.choice(["Ok", "Unreachable", "Unreachable"])) for _ in range(25)]
    held, seen, told = S.Fetches(), set(), []
    for part in range(0, len(log), 5):
        held.add(frame(log[part : part + 5]))
        seen |= set(log[part : part + 5])
        points = sorted(seen)
        ok = max((p for p in points if p[2] != S.DOWN), default=(-1,))
        first = min((p[0] for p in points if p > ok), default=None)
        assert held.state() == (points[-1][2], points[-1][0], first)
    for now in range(0, 70 * step, step):
        told += held.due(now // 1000)
        held.forget(0)
    follow_on = zip(points, points[1:] + [(10**15, 0, "")])
    assert told == [p[0] for p, q in follow_on if p[2] == S.DOWN and q[0] > p[0] + S.RETRY_US and S.due_ms(p) <= 69 * step // 1000]
