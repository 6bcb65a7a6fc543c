"""Hops over the link graph, priorities, and hand-out by priority."""

from __future__ import annotations

import heapq
import random

import pytest
from pyspark.sql import functions as F

from crawlframe import schemas
from crawlframe.operators import priority as P
from crawlframe.operators.links import resolved


def plain_hops(edges, seeds, limit):
    """Dijkstra over edges that cost 0 or 1."""
    out: dict = {}
    for src, dst, crossing in edges:
        out.setdefault(src, []).append((dst, int(crossing)))
    best: dict = {}
    queue = [(0, s) for s in seeds]
    while queue:
        hops, key = heapq.heappop(queue)
        if key in best or hops > limit:
            continue
        best[key] = hops
        for dst, cost in out.get(key, []):
            heapq.heappush(queue, (hops + cost, dst))
    return best


def edge_table(spark, edges):
    rows = [(bytearray(s, "ascii"), bytearray(d, "ascii"), c) for s, d, c in edges]
    return spark.createDataFrame(rows, "src binary, dst binary, crossing boolean")


def counted(df):
    return {bytes(r.key).decode(): r.hops for r in df.collect()}


@pytest.mark.parametrize("seed,limit", [(1, 8), (2, 1)])
def test_hops_equal_shortest_paths(spark, seed, limit):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.random() < 0.5) for _ in range(70)]
    seeds = ["n0", "n1", "absent"]
    table = spark.createDataFrame([(bytearray(s, "ascii"),) for s in [*seeds, "n0"]], "key binary")
    got = counted(P.hop_counts(edge_table(spark, edges), table, limit, buckets=2))
    assert got == plain_hops(edges, seeds, limit)


def test_hops_without_edges_or_seeds(spark):
    key = spark.createDataFrame([(bytearray(b"a"),)], "key binary")
    assert counted(P.hop_counts(edge_table(spark, []), key, buckets=2)) == {"a": 0}
    edges = edge_table(spark, [("a", "b", False)])
    assert counted(P.hop_counts(edges, key.limit(0), buckets=2)) == {}


def test_declared_priorities_are_clamped(spark):
    rows = ["0.8", " 1.0 ", "7", "-1", "0", "NaN", "high", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "p string").selectExpr(f"{P.sitemap_priority('p')} AS v")
    assert [r.v for r in df.collect()] == [0.8, 1.0, 1.0, 0.01, 0.01, 0.5, 0.5, 0.5, 0.5]


def test_scores(spark):
    pages = [
        (1, "http://a.x/", '<a href="/one"><a href="/one/two"><a href="/one?a=1"><a href="http://b.x/"><a href="/map.xml">'),
        (2, "http://b.x/", '<a href="/deep"><a href="/map.xml">'),
        (3, "http://c.x/lost", '<a href="/alone">'),
    ]
    links = resolved(spark.createDataFrame(pages, schemas.PAGES)).filter("reason IS NULL")
    links = links.selectExpr("base", "u", "CASE WHEN u.path = '/map.xml' THEN 'Sitemap' ELSE 'Other' END AS context")
    from crawlframe.operators.urls import parse_urls

    seeds = parse_urls(spark.createDataFrame([("https://a.x/",)], "url string"), "url")
    told = parse_urls(spark.createDataFrame([("http://b.x/", "0.9"), ("http://b.x/", "2"), ("http://no.x/", "1")], "url string, priority string"), "url")
    got = {f"{r.name}{r.path}{'?' + r.query if r.query else ''}": (r.hops, r.priority) for r in P.url_priority(links, seeds, told, 3).collect()}

    def score(base, hops, elements, parameters, crowd):
        return base / (1 + 1.0 * hops) / (1 + 0.1 * elements) / (1 + 0.3 * parameters) / (1 + 0.1 * (crowd / 100))

    assert got == {
        "a.x/one": (0, score(0.5, 0, 1, 0, 5)), "a.x/one/two": (0, score(0.5, 0, 2, 0, 5)),
        "a.x/one?a=1": (0, score(0.5, 0, 1, 1, 5)), "b.x/": (1, score(1.0, 1, 0, 0, 5)),
        "b.x/deep": (1, score(0.5, 1, 1, 0, 2)), "a.x/map.xml": (0, 1.0), "b.x/map.xml": (1, 1.0),
        "c.x/alone": (None, score(0.5, 4, 1, 0, 1)),
    }
    assert got["a.x/one?a=1"][1] < got["a.x/one/two"][1] < got["a.x/one"][1]


def test_next_by_priority(spark):
    rng = random.Random(3)
    domain = spark.createDataFrame([(d, f"d{d}.x", 0) for d in range(4)], schemas.DOMAIN)
    rows = [
        (k, k % 3, f"/{k}", None, "Other", 0, rng.choice([0.0, 0.25, 0.5, 1.0]), None, None, 0) for k in range(60)
    ] + [(100, 3, "/z", None, "Other", 0, 0.125, None, None, 0), (101, 3, "/never", None, "Other", 0, 0.0, None, None, 0)]
    url = spark.createDataFrame(rows, schemas.URL)
    gone = [3, 6, 9, 30]
    handed = spark.createDataFrame([(g,) for g in gone], "url_id bigint")
    got = P.next_by_priority(url, domain, handed, per_domain=4, first=1).orderBy("position").collect()
    waiting = [r for r in rows if r[6] > 0 and r[0] not in gone]
    want = []
    for d in range(4):
        mine = sorted((r for r in waiting if r[1] == d), key=lambda r: (-r[6], r[0]))[:4]
        want += [(rank, -r[6], f"d{d}.x", r[0]) for rank, r in enumerate(mine, 1)]
    want.sort()
    assert [(r.rank, -r.crawl_priority, r.name, r.url_id) for r in got] == want
    assert [r.position for r in got] == list(range(1, len(want) + 1))


def test_with_priorities(spark):
    domain = spark.createDataFrame([(1, "a.x", 0)], schemas.DOMAIN)
    url = spark.createDataFrame(
        [(1, 1, "/p", None, "Other", 0, 1.0, None, None, 0), (2, 1, "/p", "", "Other", 0, 1.0, None, None, 0)], schemas.URL
    )
    new = spark.createDataFrame([("a.x", "/p", None, 0.25), ("a.x", "/q", None, 0.5)], "name string, path string, query string, priority double")
    got = P.with_priorities(url, domain, new)
    assert got.columns == url.columns
    assert {r.url_id: r.crawl_priority for r in got.select("url_id", F.col("crawl_priority")).collect()} == {1: 0.25, 2: 1.0}
