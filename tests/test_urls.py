"""URL parsing and joining: literal expected results."""

from __future__ import annotations

import pytest

from crawlframe.operators.links import resolved
from crawlframe.operators.urls import domain_roots, parse_urls, url_canonical, url_parts

BASE = "https://ex.com/a/b?q=1"

JOINED = {
    "x": "https://ex.com/a/x",
    "../x": "https://ex.com/x",
    "./x": "https://ex.com/a/x",
    "/x": "https://ex.com/x",
    "?y=2": "https://ex.com/a/b?y=2",
    "?": "https://ex.com/a/b?",
    "//other.com/z": "https://other.com/z",
    "\\\\other.com\\z": "https://other.com/z",
    "HTTP://EX.com:80/": "http://ex.com/",
    "https://ex.com:443/p": "https://ex.com/p",
    "http://ex.com:443/p": "http://ex.com:443/p",
    "/fü r": "https://ex.com/f%C3%BC%20r",
    "/a%20b": "https://ex.com/a%20b",
    "/a\\b": "https://ex.com/a/b",
    "  /x  ": "https://ex.com/x",
    "/x\ty\n": "https://ex.com/xy",
    "http:foo": "http://foo/",
    "http:///e.org/x": "http://e.org/x",
    "https://u:p@h.com:8443/p?#f": "https://u:p@h.com:8443/p?",
    "https://:@h.com/": "https://h.com/",
    "https://a@b@h.com/": "https://a%40b@h.com/",
    "http://0x7f.1/": "http://127.0.0.1/",
    "http://017.0.0.1/": "http://15.0.0.1/",
    "http://1.2/": "http://1.0.0.2/",
    "http://[::1]:80/x": "http://[::1]/x",
    "/a/b/..": "https://ex.com/a/",
    "/a/b/.": "https://ex.com/a/b/",
    "..": "https://ex.com/",
    "../../../x": "https://ex.com/x",
    "/a/./b/%2e%2E/c/": "https://ex.com/a/c/",
    "/..//x": "https://ex.com//x",
    "/a/...": "https://ex.com/a/...",
    "http://a_b.c/": "http://a_b.c/",
    "http://h.%41b.com/": "http://h.ab.com/",
    "/a?q='ü\"<>": "https://ex.com/a?q=%27%C3%BC%22%3C%3E",
    "/{x}`y`": "https://ex.com/%7Bx%7D%60y%60",
    "/a|b^c[d]": "https://ex.com/a|b^c[d]",
    "/😀": "https://ex.com/%F0%9F%98%80",
    "http://h.com?x": "http://h.com/?x",
    "http://h.com#x": "http://h.com/",
    "/a?b?c#d#e": "https://ex.com/a?b?c",
    "/p:q": "https://ex.com/p:q",
    "http://h:080/": "http://h/",
    "http://bücher.de/": "http://xn--bcher-kva.de/",
    "http://BÜCHER.de:80/": "http://xn--bcher-kva.de/",
    "//日本語。jp/x": "https://xn--wgv71a119e.jp/x",
    "http://straße.de": "http://xn--strae-oqa.de/",
    "http://i❤.ws/": "http://xn--i-7iq.ws/",
    "http://b%C3%BCcher.de/": "http://xn--bcher-kva.de/",
    "http://xn--bcher-kva.de/": "http://xn--bcher-kva.de/",
    "http://１２７.0.0.1/": "http://127.0.0.1/",
}

DROPPED = {
    "#f": "self_link",
    "": "self_link",
    "b?q=1#z": "self_link",
    "mailto:a@b.c": "not_http",
    "javascript:void(0)": "not_http",
    "ftp://x/y": "not_http",
    "a:b": "not_http",
    "http://[bad": "unparsable",
    "http://": "unparsable",
    "http://h:99999/": "unparsable",
    "http://h:8x/": "unparsable",
    "http://exa mple.com/": "unparsable",
    "http://a%20b.com/": "unparsable",
    "http://1.2.3.4.5/": "unparsable",
    "http://256.1.1.1/": "unparsable",
    "http://09.1/": "unparsable",
    f"http://{'ü' * 64}.de/": "idn_host",
    "http://a／ü.de/": "unparsable",
}


def escape(href: str) -> str:
    return href.replace("&", "&amp;").replace('"', "&quot;")


@pytest.fixture(scope="module")
def outcome(spark):
    hrefs = [*JOINED, *DROPPED]
    rows = [(i, BASE, f'<a href="{escape(h)}">') for i, h in enumerate(hrefs)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = resolved(pages).selectExpr("page_id", "u.url AS url", "reason").collect()
    return {hrefs[r.page_id]: (r.url, r.reason) for r in got}


@pytest.mark.parametrize("href", JOINED)
def test_joined(outcome, href):
    assert outcome[href] == (JOINED[href], None)


@pytest.mark.parametrize("href", DROPPED)
def test_dropped(outcome, href):
    assert outcome[href][1] == DROPPED[href]


def test_allowed_hosts(spark):
    html = '<a href="/x"><a href="http://o.org/"><a href="http://10.0.0.1/">'
    pages = spark.createDataFrame([(1, BASE, html)], "page_id bigint, url string, html string")
    got = resolved(pages, ["EX.com"]).orderBy("pos").select("reason").collect()
    assert [r.reason for r in got] == [None, "host_not_allowed", "host_not_allowed"]
    assert resolved(pages, []).filter("reason = 'host_not_allowed'").count() == 3


def test_bad_page_url(spark):
    html = '<a href="/x"><a href="http://o.org/">'
    pages = spark.createDataFrame([(1, "nonsense", html)], "page_id bigint, url string, html string")
    got = resolved(pages).orderBy("pos").selectExpr("u.url AS url", "reason").collect()
    assert [tuple(r) for r in got] == [(None, "unparsable"), ("http://o.org/", None)]


def test_parts_keep_empty_query_apart(spark):
    rows = [
        (1, "https://u:p@Ex.com:8443/a?b=c#d"),
        (2, "http://ex.com?"),
        (3, "http://ex.com"),
        (4, "http://10.0.0.1/x"),
        (5, "no url"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    got = {r.page_id: tuple(r)[1:] for r in url_parts(df).collect()}
    assert got == {
        1: ("https", "u:p@ex.com:8443", "ex.com", "/a", "b=c", "d"),
        2: ("http", "ex.com", "ex.com", "/", "", None),
        3: ("http", "ex.com", "ex.com", "/", None, None),
        4: ("http", "10.0.0.1", None, "/x", None, None),
    }
    canonical = {r.page_id: r.url for r in url_canonical(df).collect()}
    assert canonical == {1: "https://ex.com/a?b=c", 2: "https://ex.com/?", 3: "https://ex.com/"}


def test_domain_root(spark):
    expected = {
        "https://ex.com": True,
        "https://ex.com/": True,
        "https://ex.com/#f": True,
        "https://ex.com/?": False,
        "https://ex.com/a": False,
    }
    df = spark.createDataFrame([(u,) for u in expected], "url string")
    assert {r.url: r.is_root for r in domain_roots(df).collect()} == expected


def test_parse_runs_once_per_row(spark):
    """A filter on the parsed struct must not copy the parse below the generator."""
    df = spark.createDataFrame([("http://a.b/",)], "url string")
    plan = parse_urls(df, "url").filter("u.error IS NULL AND u.path = '/'").select("u.url")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("AS _host#") == 1
