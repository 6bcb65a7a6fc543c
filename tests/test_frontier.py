"""Frontier merge, selection, storage and the crawl round."""

from __future__ import annotations

from crawlframe import schemas
from crawlframe.operators import frontier as FR
from crawlframe.operators import robots
from crawlframe.operators.links import html_outlinks
from crawlframe.operators.urls import parse_urls
from crawlframe.plans import fixtures
from crawlframe.plans.crawl_round import crawl_round
from crawlframe.session import fresh_path
from crawlframe.sources.frontier_store import FrontierStore


def links(spark, urls: list[str]):
    rows = [(i, u) for i, u in enumerate(urls)]
    parsed = parse_urls(spark.createDataFrame(rows, "page_id bigint, href string"), "href")
    return parsed.selectExpr("page_id", "0 AS pos", "concat('c', page_id) AS context", "u")


def empty(spark):
    return schemas.empty(spark, schemas.DOMAIN), schemas.empty(spark, schemas.URL)


def merge(spark, urls, tables, batch):
    new_domains, new_urls = FR.insert(FR.offered_urls(links(spark, urls)), *tables, batch)
    return new_domains, new_urls, (tables[0].unionByName(new_domains), tables[1].unionByName(new_urls))


def keys(tables):
    domain, url = tables
    return sorted((r.name, r.path, r.query or "-") for r in FR.named(url, domain).collect())


def test_insert(spark):
    first = ["http://a.x/p", "https://a.x/p", "http://u:p@a.x:8080/p#f", "http://a.x/p?", "http://b.x"]
    domains, urls, tables = merge(spark, first, empty(spark), 0)
    assert sorted((r.domain_id, r.name) for r in domains.collect()) == [(1, "a.x"), (2, "b.x")]
    got = sorted((r.url_id, r.domain_id, r.path, r.query, r.context) for r in urls.collect())
    assert got == [(1, 1, "/p", None, "c0"), (2, 1, "/p", "", "c3"), (3, 2, "/", None, "c4")]
    row = urls.filter("url_id = 1").first()
    assert (row.crawl_depth, row.crawl_priority, row.http_etag, row.batch_id) == (0, 1.0, None, 0)

    again = ["http://a.x/p", "http://a.x/p?", "http://c.x/", "http://a.x/q", "http://c.x/"]
    domains, urls, tables = merge(spark, again, tables, 1)
    assert [(r.domain_id, r.name) for r in domains.collect()] == [(3, "c.x")]
    got = sorted((r.url_id, r.domain_id, r.path) for r in urls.collect())
    assert got == [(4, 1, "/q"), (5, 3, "/")]
    assert FR.integrity(tables[1], tables[0]).first().n_orphans == 0
    assert FR.integrity(tables[1], domains).first().n_orphans == 4

    none = merge(spark, [], tables, 2)
    assert none[0].count() == none[1].count() == 0


def test_rejects(spark):
    urls = ["http://10.0.0.1/", "http://[::1]/", f"http://{'a' * 254}/", f"http://{'a' * 255}/", "http://ok/"]
    got = {r.key: r.reason for r in FR.frontier_rejects(links(spark, urls)).collect()}
    assert got == {
        "http://10.0.0.1/": "no_domain",
        "http://[::1]/": "no_domain",
        f"http://{'a' * 255}/": "too_long",
    }


def test_select(spark):
    urls = [f"http://a.x/{i:02d}" for i in range(15)] + ["http://b.x/1", "http://b.x/2"]
    domain, url = merge(spark, urls, empty(spark), 0)[2]
    handed_out = spark.createDataFrame([(1,), (2,)], "url_id bigint")
    got = FR.select_urls(url, domain, handed_out).orderBy("name", "turn").collect()
    a = [r for r in got if r.name == "a.x"]
    assert [r.path for r in a] == [f"/{i:02d}" for i in range(11, 1, -1)]
    assert [r.rank for r in a] == list(range(10, 0, -1))
    assert [(r.path, r.turn) for r in got if r.name == "b.x"] == [("/2", 1), ("/1", 2)]
    only = FR.select_urls(url, domain, handed_out, ["b.x"], 1).collect()
    assert [(r.name, r.path) for r in only] == [("b.x", "/1")]


def test_counts_of_the_survey(spark):
    """Links of odd pages against those of even pages: 673 offered, 669 new, 4 new domains."""
    pages = fixtures.pages(spark, "/root/testdata/sf0.01")
    even, odd = (FR.offered_urls(html_outlinks(pages.filter(f"page_id % 2 = {k}"))) for k in (0, 1))
    domain, url = FR.insert(even, *empty(spark), 0)
    new_domains, new_urls = FR.insert(odd, domain, url, 1)
    assert (odd.count(), new_urls.count(), new_domains.count()) == (673, 669, 4)


def robots_for(spark, bodies: dict[str, tuple[int, str]]):
    rows = [(a, s, b) for a, (s, b) in bodies.items()]
    fetches = spark.createDataFrame(rows, "authority string, status int, body string")
    return robots.robots_table(fetches.selectExpr("authority", "timestamp_seconds(0) AS start", "status", "body"), "bot")


def test_round_and_store(spark):
    rules = robots_for(spark, {
        "a.x": (200, "User-agent: *\nDisallow: /no\nSitemap: http://a.x/map.xml"),
        "b.x": (404, ""), "c.x": (503, ""),
    })
    html = b'<a href="/1"><a href="/no/1"><a href="http://b.x/"><a href="http://c.x/"><a href="http://d.x/"><a href="http://1.2.3.4/">'
    rows = [
        (1, "http://a.x/", html, "Other"),
        (2, "http://a.x/no/page", b'<a href="/never">', "Other"),
        (3, "http://b.x/s.xml", b"<urlset><url><loc>http://b.x/2</loc></url></urlset>", "Sitemap"),
        (4, "http://b.x/bad.xml", b"<urlset>", "Sitemap"),
        (5, "http://b.x/i.png", b"", "Img"),
        (6, "http://b.x", b"", "Other"),
    ]
    fetched = spark.createDataFrame(rows, "page_id bigint, url string, body binary, context string")
    store = FrontierStore(spark, fresh_path(spark, "frontier"))

    def run(batch: int):
        done = crawl_round(fetched, rules, store.read("domain", batch), store.read("url", batch), batch)
        store.write_round(done, batch)
        return done

    done = run(0)
    everything = keys((store.read("domain"), store.read("url")))
    assert everything == [
        ("a.x", "/1", "-"), ("a.x", "/map.xml", "-"), ("b.x", "/", "-"), ("b.x", "/2", "-"), ("b.x", "/sitemap.xml", "-"),
    ]
    contexts = {r.path: r.context for r in store.read("url").collect()}
    assert contexts == {"/1": "Other", "/map.xml": "Sitemap", "/": "Other", "/2": "SitemapLink", "/sitemap.xml": "Sitemap"}
    rejects = sorted(tuple(r) for r in done.rejects.collect())
    assert rejects == [
        ("extract", "http://b.x/i.png", "no_extractor"),
        ("page", "http://a.x/no/page", "disallowed"),
        ("robots", "http://1.2.3.4/", "retry"),
        ("robots", "http://a.x/no/1", "disallowed"),
        ("robots", "http://c.x/", "retry"),
        ("robots", "http://d.x/", "retry"),
        ("sitemap", "http://b.x/bad.xml", "bad_xml"),
    ]
    run(0)  # the same batch again
    assert keys((store.read("domain"), store.read("url"))) == everything
    assert store.read("reject").count() == len(rejects) and store.read("retry").count() == 0
    run(1)  # the same fetches as a later batch
    assert keys((store.read("domain"), store.read("url"))) == everything


def test_batch_that_yields_nothing_the_second_time(spark):
    store = FrontierStore(spark, fresh_path(spark, "frontier"))
    rows = spark.createDataFrame([(1, "a.x", 0)], "domain_id bigint, name string, batch_id bigint")
    store.write("domain", rows, 0)
    store.write("domain", rows.withColumn("domain_id", rows.domain_id + 1), 1)
    store.write("domain", rows.filter("false"), 1)
    assert [tuple(r) for r in store.read("domain").collect()] == [(1, "a.x", 0)]
