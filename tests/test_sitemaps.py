"""Sitemap documents, good and broken."""

from __future__ import annotations

from crawlframe.operators import dispatch
from crawlframe.operators.sitemaps import all_entries, bad_sitemaps, sitemap_entries

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'

DOCS = {
    "plain": f"<urlset {NS}><url><loc>http://a.x/1</loc></url><url><loc>http://a.x/2</loc>"
    "<lastmod>2024-01-01</lastmod></url></urlset>",
    "padded": "<urlset><url><loc>\n  http://a.x/?a=1&amp;b=2 \n</loc></url></urlset>",
    "no_loc": "<urlset><url><lastmod>x</lastmod></url><url><loc>http://a.x/3</loc></url></urlset>",
    "image": f'<urlset {NS} xmlns:image="http://i"><url><image:image><image:loc>http://i.x/</image:loc>'
    "</image:image><loc>http://a.x/4</loc></url></urlset>",
    "cdata": "<urlset><url><loc><![CDATA[http://a.x/5?a&b]]></loc></url></urlset>",
    "index": "<sitemapindex><sitemap><loc>http://a.x/s.xml</loc></sitemap></sitemapindex>",
    "relative": "<urlset><url><loc>/nope</loc></url></urlset>",
    "empty": "<urlset/>",
    "cut": "<urlset><url><loc>http://a.x/6</loc></url><url>",
    "cut_text": "<urlset>\n<url>\n<loc> http://a.x/7?a=1&amp;b=2 </loc>\n</url><url><loc>http://a.x/8",
    "cut_index": "<sitemapindex><sitemap a='b'><loc>http://a.x/s2.xml</loc></sitemap ><sitemap><lo",
    "cut_image": f'<urlset {NS} xmlns:image="http://i"><url><image:image><image:loc>http://i.x/</image:loc>'
    "</image:image><loc>http://a.x/9</loc></url><url><loc>",
    "one_bad": "<urlset><url><loc>http://a.x/&nope;</loc></url><url><loc>http://a.x/10</loc></url></urlset>",
    "entity": "<urlset><url><loc>http://a.x/&nope;</loc></url></urlset>",
    "text": "this is no XML",
}


def test_entries_and_broken_documents(spark):
    df = spark.createDataFrame(
        [(k, k, v) for k, v in DOCS.items()], "authority string, url string, body string"
    )
    got: dict[str, list] = {}
    for r in sitemap_entries(df).collect():
        got.setdefault(r.authority, []).append((r.context, r.loc.strip()))
    assert got == {
        "plain": [("SitemapLink", "http://a.x/1"), ("SitemapLink", "http://a.x/2")],
        "padded": [("SitemapLink", "http://a.x/?a=1&b=2")],
        "no_loc": [("SitemapLink", "http://a.x/3")],
        "image": [("SitemapLink", "http://a.x/4")],
        "cdata": [("SitemapLink", "http://a.x/5?a&b")],
        "index": [("Sitemap", "http://a.x/s.xml")],
        "cut": [("SitemapLink", "http://a.x/6")],
        "cut_text": [("SitemapLink", "http://a.x/7?a=1&b=2")],
        "cut_index": [("Sitemap", "http://a.x/s2.xml")],
        "cut_image": [("SitemapLink", "http://a.x/9")],
        "one_bad": [("SitemapLink", "http://a.x/10")],
    }
    bad = {r.key: r.reason for r in bad_sitemaps(df).collect()}
    assert bad == dict.fromkeys(
        ["cut", "cut_text", "cut_index", "cut_image", "one_bad", "entity", "text"], "bad_xml"
    )
    reasons: dict[str, list] = {}
    for r in all_entries(df).filter("reason IS NOT NULL").collect():
        reasons.setdefault(r.authority, []).append(r.reason)
    assert reasons == {k: ["bad_xml"] for k in bad} | {
        "one_bad": ["no_loc", "bad_xml"], "entity": ["no_loc", "bad_xml"], "no_loc": ["no_loc"], "relative": ["bad_loc"],
    }


def test_dispatch_by_context(spark):
    rows = [
        (1, "http://a.x/", b'<a href="/1"><a href="/2" rel="next">', "Other"),
        (2, "http://a.x/s", DOCS["plain"].encode(), "Sitemap"),
        (3, "http://a.x/f", b'<a href="/no">', "Feed"),
        (4, "http://a.x/i", b'<a href="/no">', "Img"),
        (5, "http://a.x/b", b'\xff<a href="/\xff">', "Other"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, body binary, context string")
    got = sorted((r.page_id, r.pos, r.u.url, r.rel, r.context) for r in dispatch.extract_outlinks(df).collect())
    assert got == [
        (1, 0, "http://a.x/1", None, "Other"),
        (1, 1, "http://a.x/2", "next", "Other"),
        (2, 0, "http://a.x/1", None, "SitemapLink"),
        (2, 1, "http://a.x/2", None, "SitemapLink"),
        (5, 0, "http://a.x/%EF%BF%BD", None, "Other"),
    ]
    rest = dispatch.without_extractor(df, dispatch.default_extractors()).collect()
    assert [(r.key, r.reason) for r in rest] == [("http://a.x/i", "no_extractor")]


def test_plugged_extractor(spark):
    def images(fetched):
        return dispatch.html_extractor()(
            fetched.selectExpr("page_id", "url", "encode(replace(cast(body AS string), 'img src', 'a href'), 'UTF-8') AS body")
        )

    df = spark.createDataFrame(
        [(1, "http://a.x/", b'<img src="/p.png">', "Img")],
        "page_id bigint, url string, body binary, context string",
    )
    got = dispatch.extract_outlinks(df, {"Img": images}).collect()
    assert [r.u.url for r in got] == ["http://a.x/p.png"]


def test_best_context_is_the_first(spark):
    df = spark.sql(
        f"""SELECT {dispatch.best_context('i')} AS c FROM VALUES
        (1, array(named_struct('rel', 'x', 'context', 'Sitemap'), named_struct('rel', 'y', 'context', 'Feed'))),
        (2, cast(array() AS array<struct<rel:string,context:string>>)) AS t(n, i) ORDER BY n"""
    )
    assert [r.c for r in df.collect()] == ["Sitemap", "Other"]
