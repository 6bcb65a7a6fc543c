"""robots.txt rules, gates and freshness."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from crawlframe.operators import robots as R

FETCH = "authority string, start timestamp, status int, body string"
LOG = "authority string, event_id bigint, start timestamp, status int"
T0 = datetime(2024, 1, 1)


def table(spark, bodies: dict[str, str], bot: str = "MyBot"):
    rows = [(a, T0, 200, b) for a, b in bodies.items()]
    return R.robots_table(spark.createDataFrame(rows, FETCH), bot)


def decide(spark, body: str, paths: list[str]) -> list[bool]:
    pages = spark.createDataFrame(
        [(i, "http://s.x" + p) for i, p in enumerate(paths)], "page_id bigint, url string"
    )
    got = R.fetch_gate(pages, table(spark, {"s.x": body})).orderBy("page_id").collect()
    return [r.decision == "Allowed" for r in got]


def test_group_selection(spark):
    bodies = {
        "own": "User-agent: *\nDisallow: /all\n\nUser-agent: mybot\nDisallow: /own\n",
        "all": "User-agent: other\nDisallow: /o\nUser-agent: *\nDisallow: /all\n",
        "none": "User-agent: other\nDisallow: /\n",
        "twice": "User-agent: MYBOT\nDisallow: /1\nUser-agent: x\nDisallow: /x\nUser-Agent:mybot\nAllow: /2",
        "shared": "User-agent: x\nUser-agent: mybot\nDisallow: /s\nUser-agent: y\nDisallow: /y",
        "sitemap_between": "User-agent: mybot\nSitemap: http://a.b/c\nUser-agent: x\nDisallow: /s",
        "empty_rule": "User-agent: *\nDisallow:\n",
        "no_agent": "Disallow: /a\n",
        "crlf": "﻿user-agent : mybot # me\r\ndisallow:\t/c # why\r\n\rAllow: /d",
        "longer_name": "User-agent: mybot2\nDisallow: /\n",
        "empty": "",
    }
    got = {r.authority: [(x.rx, x.allow) for x in r.rules] for r in table(spark, bodies).collect()}
    assert got == {
        "own": [("^/own", False)],
        "all": [("^/all", False)],
        "none": [],
        "twice": [("^/1", False), ("^/2", True)],
        "shared": [("^/s", False)],
        "sitemap_between": [("^/s", False)],
        "empty_rule": [],
        "no_agent": [],
        "crlf": [("^/c", False), ("^/d", True)],
        "longer_name": [],
        "empty": [],
    }


def test_matching(spark):
    body = "User-agent: *\nDisallow: /de\nAllow: /der\nDisallow: /*.html$\nDisallow: /q?x=*&y=1\n"
    body += "Allow: /tie\nDisallow: /tie\nDisallow: /ü\nDisallow: /robots.txt\nDisallow: /(a+)*"
    paths = {
        "/": True, "/de": False, "/des": False, "/der": True, "/der.html": False, "/a.html": False,
        "/a.html?": True, "/a.htmlx": True, "/q?x=5&y=1": False, "/q?x=5&z=1": True, "/tie/a": True,
        "/ü": False, "/%C3%BC1": False, "/robots.txt": True, "/aaa": True, "/(a+)": False,
    }
    assert decide(spark, body, list(paths)) == list(paths.values())


def brute_match(pattern: str, path: str) -> bool:
    anchored = pattern.endswith("$")
    body = pattern[:-1] if anchored else pattern
    rx = "".join(".*" if c == "*" else re.escape(c) for c in body)
    return re.match(rx + (r"\Z" if anchored else ""), path, re.S) is not None


def test_random_patterns_match_brute_force(spark):
    rng = random.Random(3)

    def word(alphabet: str, most: int) -> str:
        return "/" + "".join(rng.choice(alphabet) for _ in range(rng.randrange(most)))

    bodies, pages, expected = {}, [], []
    for site in range(60):
        rules = [(rng.random() < 0.5, word("ab*/", 6) + rng.choice(["", "", "$"])) for _ in range(6)]
        name = f"s{site}.x"
        lines = [f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rules]
        bodies[name] = "User-agent: *\n" + "\n".join(lines)
        for _ in range(30):
            path = word("ab/", 9)
            best = max(((len(p), a) for a, p in rules if brute_match(p, path)), default=(0, True))
            pages.append((len(pages), f"http://{name}{path}"))
            expected.append(best[1])
    df = spark.createDataFrame(pages, "page_id bigint, url string")
    got = R.fetch_gate(df, table(spark, bodies)).orderBy("page_id").collect()
    assert [r.decision == "Allowed" for r in got] == expected


def test_many_wildcards_stay_fast(spark):
    body = "User-agent: *\nDisallow: /" + "*a" * 60 + "b\n" + "Disallow: /x\n" * 20_000
    assert decide(spark, body, ["/" + "a" * 2000, "/" + "a" * 2000 + "b"]) == [True, False]


def test_access_and_decisions(spark):
    statuses = {200: "Ok", 204: "Unreachable", 301: "Unreachable", 404: "Unavailable",
                429: "Unavailable", 499: "Unavailable", 500: "Unreachable", 503: "Unreachable"}
    rows = [(f"s{s}.x", T0, s, "User-agent: *\nDisallow: /") for s in statuses]
    fetches = spark.createDataFrame(rows, FETCH)
    got = {r.authority: r.access for r in R.robots_access(fetches).collect()}
    assert got == {f"s{s}.x": a for s, a in statuses.items()}
    pages = spark.createDataFrame(
        [(s, f"http://s{s}.x/p") for s in [*statuses, 1]], "page_id bigint, url string"
    )
    gate = R.fetch_gate(pages, R.robots_table(fetches, "b"), datetime(2024, 1, 2))
    decision = {"Ok": "Disallowed", "Unavailable": "Allowed", "Unreachable": "Retry"}
    for r in gate.collect():
        if r.page_id == 1:  # no robots.txt seen yet
            assert (r.decision, r.retry_s, r.next_attempt) == ("Retry", 0, datetime(2024, 1, 2))
        else:
            assert r.decision == decision[statuses[r.page_id]]
            wait = 84000 if r.decision == "Retry" else None
            assert r.retry_s == wait
            assert r.next_attempt == (wait and datetime(2024, 1, 2) + timedelta(seconds=wait))


def test_latest_fetch_wins(spark):
    rows = [
        ("a.x", T0, 200, "User-agent: *\nDisallow: /old\nSitemap: http://a.x/old.xml"),
        ("a.x", T0 + timedelta(days=1), 200, "User-agent: *\nDisallow: /new\nSitemap: /relative\n"
         "sitemap: http://a.x/new.xml # here\nSITEMAP:https://b.y/2.xml"),
    ]
    robots = R.robots_table(spark.createDataFrame(rows, FETCH), "b")
    assert [r.rx for r in R.robots_rules(robots).collect()] == ["^/new"]
    found = sorted(r.sitemap_url for r in R.robots_sitemaps(robots).collect())
    assert found == ["http://a.x/new.xml", "https://b.y/2.xml"]


def test_robots_fetches_come_from_fetch_results(spark):
    rows = [("https://a.x:8080/robots.txt", T0, 200, b"User-agent: \xff"),
            ("https://a.x/robots.txt?x", T0, 200, b""), ("https://a.x/other", T0, 200, b"")]
    df = spark.createDataFrame(rows, "url string, start timestamp, status int, body binary")
    got = [(r.authority, r.body) for r in R.robots_fetches(df).collect()]
    assert got == [("a.x:8080", "User-agent: �")]


def test_root_seeds(spark):
    bodies = {"a.x": "Sitemap: http://a.x/1.xml\nSitemap: http://a.x/2.xml", "b.x": ""}
    urls = ["http://a.x/", "https://a.x", "https://b.x/#top", "http://c.x", "http://b.x/deep"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    got = sorted(tuple(r) for r in R.root_seeds(pages, table(spark, bodies)).collect())
    assert got == [
        ("a.x", "http://a.x/1.xml"),
        ("a.x", "http://a.x/2.xml"),
        ("b.x", "https://b.x/sitemap.xml"),
        ("c.x", "http://c.x/sitemap.xml"),
    ]


def test_age_bands(spark):
    day = 86400
    ages = {day: "reuse", day + 1: "fetch", 30 * day: "fetch", 30 * day + 1: "fetch", -5: "reuse"}
    log, lookups, expected = [], [], {}
    now = datetime(2024, 6, 1)
    for status, access in ((200, "Ok"), (404, "Unavailable"), (500, "Unreachable")):
        for age, verdict in ages.items():
            name = f"{access}{age}"
            log.append((name, 1, now - timedelta(seconds=age, microseconds=999_999 * (age > 0)), status))
            lookups.append((name, now))
            if access == "Unreachable" and age > 30 * day:
                verdict = "unavailable"
            expected[name] = (access, verdict)
    lookups.append(("never", now))
    expected["never"] = (None, "fetch")
    got = R.robots_state(
        spark.createDataFrame(log, LOG), spark.createDataFrame(lookups, "authority string, now timestamp")
    )
    assert {r.authority: (r.access, r.verdict) for r in got.collect()} == expected


CASES = st.lists(
    st.lists(
        st.tuples(st.text(max_size=3), st.integers(0, 255), st.sampled_from([200, 404, 500, 503])),
        min_size=50, max_size=300,
    ),
    min_size=8, max_size=8,
)


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(CASES)
def test_state_keeps_the_latest_entry(spark, cases):
    """For any sequence of inserts the state holds each authority once, with its latest update."""
    rows, expected = [], {}
    for case, inserts in enumerate(cases):
        now = datetime(1970, 1, 1)
        failing: dict[str, datetime | None] = {}
        for i, (authority, delay, status) in enumerate(inserts):
            now += timedelta(seconds=3000 * delay)
            name = f"{case}|{authority}"
            rows.append((name, i, now, status))
            if status < 500:
                failing[name] = None
            else:
                failing[name] = failing.get(name) or now
            expected[name] = (now, failing[name])
    state = R.run_heads(spark.createDataFrame(rows, LOG)).collect()
    assert len(state) == len(expected)
    assert {r.authority: (r.updated, r.first_tried) for r in state} == expected
