"""Canonical links, chains and cycles, tracking parameters."""

from __future__ import annotations

import random

from crawlframe.operators import canonical as C


def plain_ends(nxt: dict) -> dict:
    ends = {}
    for node in nxt:
        seen, at = [node], nxt[node]
        while at in nxt and at not in seen:
            seen.append(at)
            at = nxt[at]
        ends[node] = min(seen[seen.index(at) :]) if at in seen else at
    return ends


def test_chains_and_cycles(spark):
    rng = random.Random(6)
    cases = [
        {}, {"a": "b"}, {"a": "b", "b": "a"}, {"b": "c", "c": "b", "a": "b", "0": "a"}, {f"n{k:02d}": f"n{k + 1:02d}" for k in range(40)},
        {f"c{k:02d}": f"c{(k + 1) % 30:02d}" for k in range(30)} | {"a": "c07", "zz": "a", "x": "y"},
        {f"r{k}": t for k in range(60) if (t := f"r{rng.randrange(75)}") != f"r{k}"},
        {f"h{k}": "hub" for k in range(50)} | {"hub": "end"},
    ]
    for nxt in cases:
        table = spark.createDataFrame(list(nxt.items()), "node string, next string")
        assert {r.node: r.end for r in C.chain_ends(table).collect()} == plain_ends(nxt)


def test_tracking_parameters(spark):
    queries = {
        "a=1&utm_source=x&b": "a=1&b", "utm_source=x": None, "UTM_Medium&gclid=1&fbclid=2": None, "": "", None: None,
        "utmost=1": "utmost=1", "x=utm_source": "x=utm_source", "gclidx=1&&_ga=2": "gclidx=1&",
    }
    rows = spark.createDataFrame([(q,) for q in queries], "q string").selectExpr("q", f"{C.without_tracking('q')} AS v")
    assert {r.q: r.v for r in rows.collect()} == queries


def test_pages(spark):
    def page(href, more=""):
        return f'<html><head>{more}<link rel="x Canonical" href="{href}"><link rel=canonical href="/second"></head>'

    rows = [
        (1, "http://a.x/1?utm_source=f#t", page("/2?a=1&amp;gclid=3")), (2, "http://a.x/2?a=1", page("https://b.x/3")),
        (3, "https://b.x/3", page("https://b.x/3?utm_term=y")), (4, "http://a.x/4", page("mailto:x")), (5, "bad", page("/6")),
        (6, "http://a.x/6", '<!-- <link rel=canonical href=/no> --><link rel="next" href="/n">'), (7, "http://a.x/7", None),
        (9, "http://a.x/8", page("/2?a=1")), (8, "http://a.x/8", page("/6")), (10, "http://a.x/10", page("")),
    ]
    got = C.canonical_urls(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert {r.page_id: (r.url, r.canonical) for r in got.collect()} == {
        1: ("http://a.x/1", "https://b.x/3"), 2: ("http://a.x/2?a=1", "https://b.x/3"), 3: ("https://b.x/3", "https://b.x/3"),
        4: ("http://a.x/4", "http://a.x/4"), 6: ("http://a.x/6", "http://a.x/6"), 7: ("http://a.x/7", "http://a.x/7"),
        8: ("http://a.x/8", "http://a.x/6"), 9: ("http://a.x/8", "http://a.x/6"), 10: ("http://a.x/10", "http://a.x/10"),
    }
