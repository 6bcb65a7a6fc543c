"""Feeds, resources, the length rule and what sitemaps declare: literal rows."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest

from crawlframe.operators import feeds, resources, sitemaps
from crawlframe.operators.links import resolved

HEAD = '<?xml version="1.0"?><!-- a > b -->'
ATOM = (
    HEAD + '<a:feed xmlns:a="http://www.w3.org/2005/Atom" xml:base="http://b/x/"><a:link rel="self" href="/f"/>'
    '<a:entry xml:base="y/"><a:link rel="self" href="no"/><a:link rel="alternate" href="a?x=1&amp;y=2"/></a:entry>'
    '<a:entry><a:link href="b#part"></a:link></a:entry><a:entry><a:link rel="related" href="../c"/></a:entry>'
    '<a:entry><a:title>none</a:title></a:entry><a:entry><a:link href="mailto:x@y"/></a:entry></a:feed>'
)
RSS = (
    '<rss version="2.0" xmlns:atom="u"><channel><link>http://c/</link><atom:link href="z" rel="self"/>'
    "<item><title>q &amp; r</title><link> http://c/1?a&amp;b </link></item>"
    '<item><guid isPermaLink="true">http://c/2</guid></item><item><guid>http://c/3</guid></item>'
    '<item><guid isPermaLink="false">http://c/4</guid></item><item><link>/rel</link><description><![CDATA[<item>]]></description></item>'
    "</channel></rss>"
)
RDF = (
    '<rdf:RDF xmlns:rdf="r" xmlns="n"><channel rdf:about="x"><link>http://d/</link></channel>'
    '<item rdf:about="http://d/1"><link>http://d/1</link></item></rdf:RDF>'
)


def test_feeds(spark):
    docs = {
        "http://h/atom": ATOM, "http://h/rss": RSS, "http://h/rdf": RDF, "http://h/null": None, "http://h/empty": "",
        "http://h/html": "<html><p>x", "http://h/cut": RSS[: RSS.index("<item><guid isPermaLink=\"false")] + "<item><link>x",
        "http://h/atom_cut": ATOM[: ATOM.index("<a:entry><a:link rel=\"related")], "http://h/none": "<rss><channel></channel></rss>",
    }
    rows = spark.createDataFrame([(u, b, 7) for u, b in docs.items()], "url string, body string, extra int")
    got: dict = {}
    for r in feeds.all_entries(rows).orderBy("url", "pos").collect():
        got.setdefault(r.url, []).append(r.reason or r.u.url)
        assert r.extra == 7
    assert got == {
        "http://h/atom": ["http://b/x/y/a?x=1&y=2", "http://b/x/b", "http://b/c", "no_link", "not_http"],
        "http://h/rss": ["http://c/1?a&b", "http://c/2", "http://c/3", "no_link", "http://h/rel"],
        "http://h/rdf": ["http://d/1"], "http://h/null": ["bad_xml"], "http://h/empty": ["bad_xml"], "http://h/html": ["bad_xml"],
        "http://h/cut": ["http://c/1?a&b", "http://c/2", "http://c/3", "bad_xml"],
        # the feed's own base is lost with its end
        "http://h/atom_cut": ["http://h/y/a?x=1&y=2", "http://h/b", "bad_xml"],
    }


PAGE = """<!DOCTYPE html><head><link rel="Stylesheet" href="/s.css"><link rel=alternate type="application/rss+xml" href="feed.xml?a&amp;b">
<link rel="shortcut icon" href=/i.ico><link rel=next href=/n><link rel="alternate" type="text/html" href=/de>
<style>@import "im.css"; /* url(no.png) */ body{background:url( "bg.png" )} @font-face{src:url(f.woff)}</style>
<script src="x.js">var s="<img src=no1><!--";</script><script>document.write("<script src=no>")</script></head>
<!-- <img src=no2> --><IMG SRC='a.png' srcset="b.png 1x, c,d.png 2x,e.png" alt="<!--"><picture><source srcset="data:image/png;base64,xx 1x, g.webp 600w"></picture>
<textarea><img src=no3></textarea><div class=q style="background:url('st.png')">t</div><img alt="x>y" src=z.gif><input type=image src=in.png>
<input src=no4><video poster=p.jpg></video><img src="data:,x"><img><img src=" "><a href="/no5">a</a><img src="/page">"""


def test_resources(spark):
    pages = [(1, "http://a.x/page", PAGE), (2, "http://a.x/", None), (3, "http://a.x/", ""), (4, "no url", "<img src=/x>")]
    rows = resources.resource_links(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    got = [(r.page_id, r.context, r.reason or r.u.url) for r in rows.orderBy("page_id", "pos", "item").collect()]
    base = "http://a.x/"
    assert got == [
        (1, "Style", base + "s.css"), (1, "Feed", base + "feed.xml?a&b"), (1, "Img", base + "i.ico"), (1, "Style", base + "im.css"),
        (1, "Img", base + "bg.png"), (1, "Img", base + "f.woff"), (1, "Script", base + "x.js"), (1, "Img", base + "a.png"),
        (1, "Img", base + "b.png"), (1, "Img", base + "c,d.png"), (1, "Img", base + "e.png"), (1, "Img", "not_http"),
        (1, "Img", base + "g.webp"), (1, "Img", base + "st.png"), (1, "Img", base + "z.gif"), (1, "Img", base + "in.png"),
        (1, "Img", base + "p.jpg"), (1, "Img", "not_http"), (1, "Img", "self_link"), (4, "Img", "unparsable"),
    ]


def test_long_page(spark):
    """No backtracking over a document of megabytes, also where nothing is closed."""
    for html in ("<img src=/x>" * 5_000 + "<img src='", "<style>" + "url(" * 100_000, "<!--" + "<img src=/x>" * 30_000):
        rows = spark.createDataFrame([(1, "http://a.x/", html)], "page_id bigint, url string, html string")
        n = resources.resource_links(rows).count()
        assert n == (5_000 if html.startswith("<img") else 0)


def test_length_rule(spark):
    start = len("http://a.x/")
    html = "".join(f'<a href="/{"x" * (n - start)}">l</a>' for n in (2047, 2048)) + f'<a href="/{"ü" * 700}">u</a>'
    pages = spark.createDataFrame([(1, "http://a.x/", html)], "page_id bigint, url string, html string")
    assert [r.reason for r in resolved(pages).orderBy("pos").collect()] == [None, "too_long", "too_long"]


def micros(*parts) -> int:
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1_000_000)


DATES = {
    "2023": (micros(2023, 1, 1), micros(2024, 1, 1)),
    "2024-02": (micros(2024, 2, 1), micros(2024, 3, 1)),
    " 2024-02-29 ": (micros(2024, 2, 29), micros(2024, 3, 1)),
    "2024-02-29T10:20Z": (micros(2024, 2, 29, 10, 20),) * 2,
    "2024-02-29T10:20:30.25+02:00": (micros(2024, 2, 29, 8, 20, 30, 250_000),) * 2,
    "2024-02-29T10:20:30-05:30": (micros(2024, 2, 29, 15, 50, 30),) * 2,
    "2024-02-30": (None, None), "2024-13": (None, None), "24-02-29": (None, None), "2024-02-29T10:20": (None, None),
    "yesterday": (None, None), "": (None, None), None: (None, None),
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(d,) for d in DATES], "d string").selectExpr(
            "d", f"unix_micros({sitemaps.change_start('d')}) AS a", f"unix_micros({sitemaps.change_end('d')}) AS b"
        )
        assert {r.d: (r.a, r.b) for r in rows.collect()} == DATES
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_recrawl(spark):
    def entry(path, lastmod):
        return f"<url><loc>http://a.x/{path}</loc><lastmod>{lastmod}</lastmod><priority>2</priority></url>"

    body = "<urlset>" + "".join(
        entry(*e) for e in [
            ("new", "2020"), ("same_day", "2024-02-10"), ("before", "2024-02-09"), ("after", "2024-02-10T13:00Z"),
            ("later", "2031-01-01"), ("twice", "2020"), ("twice", "2024-02-11"), ("plain", "no date"),
        ]
    ) + "</urlset>"
    fields = sitemaps.sitemap_fields(spark.createDataFrame([(body, "Sitemap")], "body string, context string"))
    noon = datetime(2024, 2, 10, 12, tzinfo=timezone.utc)
    fetched = spark.createDataFrame(
        [(f"http://a.x/{p}#top", noon) for p in ("same_day", "before", "after", "later", "twice", "plain")], "url string, start timestamp"
    )
    got = sitemaps.recrawl_due(fields, fetched, datetime(2024, 3, 1, tzinfo=timezone.utc)).collect()
    assert {r.url[11:]: r.reason for r in got} == {"new": "new", "same_day": "changed", "after": "changed", "twice": "changed"}
    assert {r.priority for r in got} == {1.0}
