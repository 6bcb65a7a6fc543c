"""The registered queries: each reads the given tables whole and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe import schemas
from crawlframe.operators import archive, canonical, dispatch, feeds, frontier, links, politeness, priority, resources, robots
from crawlframe.operators import sitemaps, urls
from crawlframe.operators.urls import parse_urls
from crawlframe.plans import fixtures as X
from crawlframe.plans.crawl_round import Round, crawl_round
from crawlframe.session import fresh_path, written
from crawlframe.sources import warc
from crawlframe.sources.keyed_frontier import KeyedFrontier
from crawlframe.streaming import frontier as frontier_stream
from crawlframe.streaming import politeness as politeness_stream
from crawlframe.streaming import robots as robots_stream

Query = Callable[[SparkSession, str], DataFrame]
Tables = tuple[DataFrame, DataFrame]

ROUND_TIME = datetime(2024, 3, 1, tzinfo=timezone.utc)


def link_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Links and distinct targets per domain."""
    found = X.links(spark, sf).filter("u.domain IS NOT NULL")
    per_url = found.groupBy("u.domain", "u.url").agg(F.count(F.lit(1)).alias("n"))
    return per_url.groupBy("domain").agg(
        F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_targets")
    )


def _site_roots(spark: SparkSession, sf: str) -> DataFrame:
    """The main page of every site that occurs, per scheme."""
    return (
        X.sites(spark, sf)
        .select("scheme", "authority")
        .distinct()
        .selectExpr("concat(scheme, '://', authority, '/') AS url")
    )


def _with_roots(spark: SparkSession, sf: str) -> DataFrame:
    return X.pages(spark, sf).select("url").unionByName(_site_roots(spark, sf))


def _empty(spark: SparkSession) -> Tables:
    return schemas.empty(spark, schemas.DOMAIN), schemas.empty(spark, schemas.URL)


def _merge(spark: SparkSession, found: DataFrame, tables: Tables, batch_id: int) -> Tables:
    """Both frontier tables after one insert."""
    domain, url = tables
    new_domains, new_urls = frontier.insert(frontier.offered_urls(found), domain, url, batch_id)
    return domain.unionByName(new_domains), url.unionByName(new_urls)


def _known(spark: SparkSession, sf: str) -> Tables:
    """The frontier after an earlier round over the pages fetched by plain http."""
    found = links.html_outlinks(X.known_pages(spark, sf))
    return _merge(spark, found, _empty(spark), 0)


def _keys(url: DataFrame, domain: DataFrame) -> DataFrame:
    return frontier.named(url, domain).select(*frontier.KEY)


def _with_bad_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with three more anchors that must not pass."""
    return parse_urls(X.pages(spark, sf), "url").selectExpr(
        "page_id",
        "url",
        """concat(html, '<a href="mailto:info@', u.authority, '">m</a><a href="',
           replace(url, '&', '&amp;'), '">s</a><a href=\\'http://', u.authority,
           ':99999/\\'>p</a>') AS html""",
    )


def outlink_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return links.outlink_rejects(_with_bad_anchors(spark, sf))


def outlinks_by_context(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["page_id", "url", "body", "context"]
    maps = X.sitemaps(spark, sf).selectExpr(
        "-1 - abs(xxhash64(url)) AS page_id", "url", "encode(body, 'UTF-8') AS body", "context"
    )
    return dispatch.outlinks_by_context(
        X.fetches(spark, sf).select(*columns).unionByName(maps.select(*columns))
    )


def frontier_new_domains(spark: SparkSession, sf: str) -> DataFrame:
    domain, _ = _known(spark, sf)
    return frontier.new_domain_names(frontier.offered_urls(X.links(spark, sf)), domain)


def frontier_insert(spark: SparkSession, sf: str) -> DataFrame:
    domain, url = _known(spark, sf)
    found = frontier.offered_urls(X.links(spark, sf))
    new_domains, new_urls = frontier.insert(found, domain, url, 1)
    return _keys(new_urls, domain.unionByName(new_domains))


def frontier_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with a link to an address and one to a host whose name is too long."""
    bad = parse_urls(X.pages(spark, sf), "url").selectExpr(
        "page_id",
        "url",
        """concat(html, '<a href="http://10.', shiftright(page_id, 16) & 255, '.',
           shiftright(page_id, 8) & 255, '.', page_id & 255, '/a">a</a>',
           '<a href="http://', repeat('sub.', 64), u.domain, '/b">b</a>') AS html""",
    )
    return frontier.frontier_rejects(links.html_outlinks(bad)).select("key", "reason")


def frontier_stats(spark: SparkSession, sf: str) -> DataFrame:
    domain, url = _known(spark, sf)
    found = written(X.links(spark, sf).select("page_id", "pos", "context", "u"), "links")
    _, new_urls = frontier.insert(frontier.offered_urls(found), domain, url, 1)
    offered = found.agg(F.count(F.lit(1)).alias("offered")).scalar()
    inserted = new_urls.agg(F.count(F.lit(1)).alias("inserted"))
    return inserted.select(offered.alias("offered"), "inserted")


def frontier_integrity(spark: SparkSession, sf: str) -> DataFrame:
    domain, url = _merge(spark, X.links(spark, sf), _known(spark, sf), 1)
    return frontier.integrity(url, domain)


def _handed_out(spark: SparkSession, sf: str, domain: DataFrame, url: DataFrame) -> DataFrame:
    """The rows of a frontier that the http pages link to."""
    gone = frontier.offered_urls(links.html_outlinks(X.known_pages(spark, sf))).alias("g")
    rows = frontier.named(url, domain).alias("f")
    return rows.join(
        gone,
        (F.col("f.name") == F.col("g.name"))
        & (F.col("f.path") == F.col("g.path"))
        & F.col("f.query").eqNullSafe(F.col("g.query")),
        "left_semi",
    ).select("url_id")


def _waiting(spark: SparkSession, sf: str) -> DataFrame:
    """What a frontier over all pages hands out after the http pages' links went."""
    domain, url = _merge(spark, X.links(spark, sf), _empty(spark), 0)
    return frontier.select_urls(url, domain, _handed_out(spark, sf, domain, url))


def frontier_select(spark: SparkSession, sf: str) -> DataFrame:
    return _waiting(spark, sf).select(*frontier.KEY, "rank", "turn")


def _keyed(spark: SparkSession) -> KeyedFrontier:
    return KeyedFrontier(spark, fresh_path(spark, "keyed"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))


def frontier_keyed_insert(spark: SparkSession, sf: str) -> DataFrame:
    """The second of two batches into the bucketed frontier, the first one run twice."""
    store = _keyed(spark)
    known = frontier.offered_urls(links.html_outlinks(X.known_pages(spark, sf)))
    store.add(known, 0)
    store.add(known, 0)
    store.add(frontier.offered_urls(X.links(spark, sf)), 1)
    return _keys(store.read("url").filter("batch_id = 1"), store.read("domain"))


def frontier_keyed_select(spark: SparkSession, sf: str) -> DataFrame:
    """What a bucketed frontier over all pages hands out in its second turn."""
    store = _keyed(spark)
    store.add(frontier.offered_urls(X.links(spark, sf)), 0)
    store.mark(store.hand_out(0), 0)
    return store.hand_out(1).select(*frontier.KEY, "rank", "turn")


def _graph_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of all pages, each of which also links to three others: a tree and a chord."""
    pages = X.pages(spark, sf)
    n = pages.count()
    ends = pages.selectExpr("page_id", f"explode(array(2 * page_id + 1, 2 * page_id + 2, page_id * page_id % {n})) AS to")
    more = (
        ends.join(pages.selectExpr("page_id AS to", "url AS target"), "to")
        .selectExpr("page_id", "concat('<a href=\"', replace(target, '&', '&amp;'), '\">t</a>') AS tag")
        .groupBy("page_id")
        .agg(F.expr("array_join(collect_list(tag), '') AS tags"))
    )
    linked = pages.join(more, "page_id", "left").selectExpr("page_id", "url", "concat(html, coalesce(tags, '')) AS html")
    return links.resolved(linked).filter("reason IS NULL").selectExpr("base", "u", "'Other' AS context")


def url_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Priorities of all links, from the first page by URL and three domain crossings on."""
    pages = X.pages(spark, sf)
    first = parse_urls(pages.agg(F.min("url").alias("url")), "url")
    told = "concat(page_id % 13 DIV 10, '.', page_id % 13 % 10) AS priority"
    declared = parse_urls(pages.selectExpr("url", told), "url")
    return priority.url_priority(_graph_links(spark, sf), first, declared, max_hops=3)


def next_by_priority(spark: SparkSession, sf: str) -> DataFrame:
    """What a frontier over all pages hands out by priority after the http pages' links went."""
    domain, url = _merge(spark, X.links(spark, sf), _empty(spark), 0)
    value = priority.score("1D", "0", "path", "query", "length(path)")
    url = url.withColumn("crawl_priority", F.expr(f"cast(CASE WHEN length(path) % 7 = 0 THEN 0 ELSE {value} END AS float)"))
    url = written(url, "url")
    chosen = priority.next_by_priority(url, domain, _handed_out(spark, sf, domain, url), per_domain=5)
    return chosen.select(*frontier.KEY, "crawl_priority", "rank", "position")


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    return robots.robots_table(X.robots(spark, sf), X.BOT)


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """The fetch log as the stored, narrow table that it is outside of tests."""
    return written(X.fetch_log(spark, sf), "log")


def robots_state(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    return _plain_times(robots.robots_state(log, X.lookups(log)))


def _plain_times(state: DataFrame) -> DataFrame:
    return state.selectExpr(
        "authority", "access", "unix_micros(updated) AS updated_us",
        "unix_micros(first_tried) AS first_tried_us", "verdict",
    )


def fetch_schedule(spark: SparkSession, sf: str) -> DataFrame:
    waiting = written(_waiting(spark, sf), "waiting")
    return politeness.fetch_schedule(waiting, _rules(spark, sf), X.fetch_log(spark, sf)).select(
        "name", "path", "query", "earliest_us"
    )


def warc_records(spark: SparkSession, sf: str) -> DataFrame:
    records = archive.warc_records(X.fetches(spark, sf))
    return records.selectExpr(
        "page_id", "content_length", "warc_date",
        "cast(octet_length(record) - octet_length(record_id) AS bigint) AS fixed_bytes",
    )


def warc_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Write all pages as an archive, read it back, and look into the HTTP blocks."""
    warc.register(spark)
    path = fresh_path(spark, "archive")
    archive.warc_records(X.fetches(spark, sf)).select("record").write.format("warc").mode(
        "append"
    ).save(path)
    return spark.read.format("warc").load(path).selectExpr(
        "target_uri", "content_length", "warc_date",
        "split(make_valid_utf8(cast(http AS string)), '\\r\\n\\r\\n', 2)[1] AS body",
    )


def _archive(spark: SparkSession, sf: str) -> str:
    """An archive sorted by key that holds two captures of every page, a day apart, in two jobs."""
    path = fresh_path(spark, "archive")
    first = X.fetches(spark, sf)
    again = first.withColumn("start", F.expr("start + INTERVAL 1 DAY")).withColumn("body", F.expr("concat(body, X'0A')"))
    for fetched in (first, again):
        warc.write_sorted(archive.archive_records(fetched), path)
    return path


def _captured(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "target_uri", "warc_date", "split(make_valid_utf8(cast(http AS string)), '\\r\\n\\r\\n', 2)[1] AS body"
    )


def archive_by_url(spark: SparkSession, sf: str) -> DataFrame:
    """The captures of the first and the last page by URL."""
    path = _archive(spark, sf)
    chosen = list(X.pages(spark, sf).agg(F.min("url"), F.max("url")).first())
    return _captured(archive.captures(spark, path, chosen))


def archive_by_table(spark: SparkSession, sf: str) -> DataFrame:
    """The captures of all pages that were fetched by plain http, asked for by https and twice."""
    path = _archive(spark, sf)
    asked = X.known_pages(spark, sf).selectExpr("replace(url, 'http://', 'https://') AS url")
    return _captured(archive.captures_of(asked.union(asked), path))


def archive_below_path(spark: SparkSession, sf: str) -> DataFrame:
    """What the last site by name holds below /en, and all sites below example.com under /de."""
    path = _archive(spark, sf)
    site = archive.captures_below(spark, path, _two_names(spark, sf)[1], "/en", payload=False)
    zone = archive.captures_below(spark, path, "example.com", "/de", subdomains=True, payload=False)
    return site.unionByName(zone).select("target_uri", "warc_date")


def idn_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with links to international hosts below its site, and one that has no ASCII form."""
    hosts = ["bücher", "BÜCHER", "日本語", "straße", "ü" * 64]
    more = ", ".join(f"'<a href=\"//{host}.', u.authority, '/x\">i</a>'" for host in hosts)
    pages = parse_urls(X.pages(spark, sf), "url").selectExpr("page_id", "url", f"concat({more}) AS html")
    return links.resolved(pages).selectExpr("page_id", "pos", "u.url AS url", "u.domain AS domain", "reason")


def resource_links(spark: SparkSession, sf: str) -> DataFrame:
    """All references of all pages, each with an image set, a script, a sheet and a feed more at its end."""
    more = """<img src="/i.png" srcset="/i.png 1x, /j,2.png 2x"><script src="/s.js">"<img src=n>"</script>
        <style>@import "/t.css"; p { background: url( '/b.png' ) }</style>
        <link rel="alternate" type="application/rss+xml" href="/feed?a&amp;b"><img src="data:,x">"""
    pages = X.pages(spark, sf).withColumn("html", F.concat("html", F.lit(more)))
    return resources.resource_links(pages).selectExpr("page_id", "context", "href", "u.url AS url", "reason")


def feed_links(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.feed_links(X.feeds(spark, sf))


def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in tens: the first names none, six more each the one before, the last three one another in a ring."""
    pages = X.pages(spark, sf)
    step = "page_id + CASE page_id % 10 WHEN 0 THEN NULL WHEN 7 THEN 1 WHEN 8 THEN 1 WHEN 9 THEN -2 ELSE -1 END"
    to = pages.selectExpr("page_id AS to", "concat('<link href=\"', replace(url, '&', '&amp;'), '\" rel=\"canonical\">') AS tag")
    named = pages.withColumn("to", F.expr(step)).join(to, "to", "left").selectExpr("page_id", "url", "concat(coalesce(tag, ''), html) AS html")
    return canonical.canonical_urls(named)


def long_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of 2,047 and of 2,048 characters on every page."""
    start = "length(concat(u.scheme, '://', u.authority, '/'))"
    tags = [f"'<a href=\"/', repeat('x', {n} - {start}), '\">l</a>'" for n in (2047, 2048)]
    pages = parse_urls(X.pages(spark, sf), "url").selectExpr("page_id", "url", f"concat({', '.join(tags)}) AS html")
    return links.resolved(pages).selectExpr("page_id", "pos", "length(u.url) AS n_chars", "reason")


def sitemap_fields(spark: SparkSession, sf: str) -> DataFrame:
    fields = sitemaps.sitemap_fields(X.dated_sitemaps(spark, sf).select("body"))
    return fields.selectExpr(
        "context", "loc", "unix_micros(changed_from) AS from_us", "unix_micros(changed_to) AS to_us", "priority"
    )


def recrawl_due(spark: SparkSession, sf: str) -> DataFrame:
    """What the sitemaps say is due when the pages on plain http were fetched on 1 January."""
    fields = sitemaps.sitemap_fields(X.dated_sitemaps(spark, sf).filter("url NOT LIKE '%main.xml'").select("body"))
    fetched = X.fetches(spark, sf).filter("url LIKE 'http:%'").select("url", "start")
    return sitemaps.recrawl_due(fields, fetched, ROUND_TIME)


def _round_fetches(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, the main page of each site and the sitemap files, all in one round."""
    columns = ["page_id", "url", "body", "context"]
    number = "-1 - abs(xxhash64(url)) AS page_id"
    roots = _site_roots(spark, sf).selectExpr(number, "url", "X'' AS body", "'Other' AS context")
    maps = X.sitemaps(spark, sf).selectExpr(
        number, "url", "encode(body, 'UTF-8') AS body", "context"
    )
    return X.fetches(spark, sf).select(*columns).unionByName(roots).unionByName(maps)


def crawl_round_query(spark: SparkSession, sf: str) -> DataFrame:
    domain, url = _known(spark, sf)
    rules = written(_rules(spark, sf), "rules")
    done = crawl_round(_round_fetches(spark, sf), rules, domain, url, 1)
    named = frontier.named(done.new_urls, domain.unionByName(done.new_domains))
    return named.select(*frontier.KEY, "context")


def _troubled_round(spark: SparkSession, sf: str) -> Round:
    """A round over all pages, each with three anchors that must not pass, and a bad page URL per site."""
    columns = ["page_id", "url", "body", "context"]
    more = _with_bad_anchors(spark, sf).selectExpr(
        "page_id", "url", "encode(html, 'UTF-8') AS body", "'Other' AS context"
    )
    bad = X.sites(spark, sf).select("authority").distinct().selectExpr(
        "-1 - abs(xxhash64(authority)) AS page_id",
        "concat('http://', authority, ':99999/') AS url",
        "encode('<a href=\"http://never.example/\">n</a>', 'UTF-8') AS body",
        "'Other' AS context",
    )
    fetched = more.select(*columns).unionByName(bad.select(*columns))
    rules = written(_rules(spark, sf), "rules")
    return crawl_round(fetched, rules, *_empty(spark), 0, checked_at=ROUND_TIME)


def round_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _troubled_round(spark, sf).rejects


def round_retries(spark: SparkSession, sf: str) -> DataFrame:
    return _troubled_round(spark, sf).retries.selectExpr(
        "url", "retry_s", "unix_micros(next_attempt) AS next_attempt_us"
    )


def sitemap_broken(spark: SparkSession, sf: str) -> DataFrame:
    """Every sitemap file cut inside an entry, every index file with one bad entry more."""
    bad = X.sitemaps(spark, sf).withColumn(
        "body",
        F.expr(
            """replace(replace(body, '</urlset>', '<url><loc>http://cut.example'), '</sitemapindex>',
               '<sitemap><loc>http://bad.example/&nope;</loc></sitemap></sitemapindex>')"""
        ),
    )
    broken = sitemaps.bad_sitemaps(bad).selectExpr("reason AS context", "key AS loc")
    return sitemaps.sitemap_entries(bad).select("context", "loc").unionByName(broken)


def frontier_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without a domain when the domains with names of even length are lost."""
    domain, url = _merge(spark, X.links(spark, sf), _empty(spark), 0)
    return frontier.integrity(url, domain.filter("length(name) % 2 = 1"))


def _two_names(spark: SparkSession, sf: str) -> list[str]:
    """The first and the last site by name."""
    return list(X.sites(spark, sf).agg(F.min("authority"), F.max("authority")).first())


def outlinks_allowed_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return links.outlink_counts(X.pages(spark, sf), _two_names(spark, sf))


def frontier_select_named(spark: SparkSession, sf: str) -> DataFrame:
    """What two sites hand out, from the frontier over all pages."""
    domain, url = _merge(spark, X.links(spark, sf), _empty(spark), 0)
    none = url.filter("url_id IS NULL")
    chosen = frontier.select_urls(url, domain, none, _two_names(spark, sf))
    return chosen.select(*frontier.KEY, "rank", "turn")


def robots_from_fetches(spark: SparkSession, sf: str) -> DataFrame:
    """robots.txt files found among the fetches of all pages."""
    files = X.robots(spark, sf).selectExpr(
        "concat('https://', authority, '/robots.txt') AS url", "start", "status", "encode(body, 'UTF-8') AS body"
    )
    fetched = X.fetches(spark, sf).select("url", "start", "status", "body").unionByName(files)
    table = robots.robots_table(robots.robots_fetches(fetched), X.BOT)
    return table.selectExpr("authority", "access", "coalesce(size(rules), 0) AS n_rules")


def _log_slices(spark: SparkSession, log: DataFrame) -> list[DataFrame]:
    """The log as three deliveries, one after the other in time."""
    first, last = log.selectExpr("min(unix_micros(start))", "max(unix_micros(start))").first()
    third = (last - first) // 3 + 1
    part = F.expr(f"(unix_micros(start) - {first}L) DIV {third}L")
    return [log.filter(part == i) for i in range(3)]


def stream_politeness(spark: SparkSession, sf: str) -> DataFrame:
    log = _log(spark, sf)
    inbox, root, checkpoint = (fresh_path(spark, n) for n in ("inbox", "state", "progress"))
    for part in _log_slices(spark, log):
        part.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(log.schema).parquet(inbox)
        politeness_stream.start(stream, root, checkpoint).awaitTermination()
    return politeness_stream.latest(spark, root)


def _follow_robots(spark: SparkSession, log: DataFrame, slices: list[DataFrame], lateness: str) -> str:
    """Deliver the slices one by one to the robots stream; returns the folder of its results."""
    inbox, root, checkpoint = (fresh_path(spark, n) for n in ("inbox", "state", "progress"))
    for part in slices:
        part.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(log.schema).parquet(inbox)
        robots_stream.start(stream, root, checkpoint, lateness=lateness).awaitTermination()
    robots_stream.start(stream, root, checkpoint, lateness=lateness).awaitTermination()  # a restart without new rows
    return root


def stream_robots(spark: SparkSession, sf: str) -> DataFrame:
    """The log in three deliveries, each from all times: late fetches keep their place."""
    log = _log(spark, sf)
    mixed = [log.filter(F.expr(f"pmod(xxhash64(event_id), 3) = {i}")) for i in range(3)]
    root = _follow_robots(spark, log, mixed, "1000 days")
    state = robots_stream.latest(spark, root)
    found = X.lookups(log).join(state, "authority", "left")
    return _plain_times(
        found.withColumn("verdict", F.expr(robots.verdict("access", "updated", "now")))
    )


def stream_retries(spark: SparkSession, sf: str) -> DataFrame:
    """The log in three deliveries by time: sites that come due after a failure without another fetch."""
    log = _log(spark, sf)
    root = _follow_robots(spark, log, _log_slices(spark, log), "0 seconds")
    return robots_stream.due_retries(spark, root).selectExpr(
        "authority", "unix_micros(failed) AS failed_us", "unix_micros(due) AS due_us"
    )


def stream_frontier(spark: SparkSession, sf: str) -> DataFrame:
    """First the http pages arrive, then the others; the frontier grows by what is new."""
    fetched = X.fetches(spark, sf).select("page_id", "url", "body", "context")
    rules = written(_rules(spark, sf), "rules")
    inbox, root, checkpoint = (fresh_path(spark, n) for n in ("inbox", "frontier", "progress"))
    store = KeyedFrontier(spark, root, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    plain = F.col("url").startswith("http:")
    for part in (fetched.filter(plain), fetched.filter(~plain)):
        part.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(fetched.schema).parquet(inbox)
        frontier_stream.start(stream, rules, store, checkpoint).awaitTermination()
    return _keys(store.read("url"), store.read("domain"))


QUERIES: dict[str, Query] = {
    "link_summary": link_summary,
    "url_parts": lambda s, d: urls.url_parts(X.pages(s, d)),
    "url_canonical": lambda s, d: urls.url_canonical(X.pages(s, d)),
    "well_known_urls": lambda s, d: urls.well_known_urls(X.pages(s, d)),
    "domain_roots": lambda s, d: urls.domain_roots(_with_roots(s, d)),
    "body_text": lambda s, d: archive.body_text(X.fetches(s, d)),
    "outlinks_raw": lambda s, d: links.outlinks_raw(X.pages(s, d)),
    "outlinks_resolved": lambda s, d: links.outlinks_resolved(X.pages(s, d)),
    "outlink_rejects": outlink_rejects,
    "outlink_counts": lambda s, d: links.outlink_counts(X.pages(s, d)),
    "outlinks_by_context": outlinks_by_context,
    "frontier_new_domains": frontier_new_domains,
    "frontier_insert": frontier_insert,
    "frontier_keyed_insert": frontier_keyed_insert,
    "frontier_keyed_select": frontier_keyed_select,
    "url_priority": url_priority,
    "next_by_priority": next_by_priority,
    "frontier_rejects": frontier_rejects,
    "frontier_stats": frontier_stats,
    "frontier_integrity": frontier_integrity,
    "frontier_select": frontier_select,
    "robots_access": lambda s, d: robots.robots_access(X.robots(s, d)),
    "robots_rules": lambda s, d: robots.robots_rules(_rules(s, d)),
    "robots_gate": lambda s, d: robots.robots_gate(X.links(s, d), _rules(s, d)),
    "fetch_gate": lambda s, d: robots.fetch_gate(X.pages(s, d), _rules(s, d)),
    "robots_sitemaps": lambda s, d: robots.robots_sitemaps(_rules(s, d)).select(
        "authority", "sitemap_url"
    ),
    "root_seeds": lambda s, d: robots.root_seeds(_with_roots(s, d), _rules(s, d)),
    "sitemap_entries": lambda s, d: sitemaps.sitemap_entries(X.sitemaps(s, d)),
    "robots_state": robots_state,
    "politeness": lambda s, d: politeness.politeness(_log(s, d)),
    "fetch_schedule": fetch_schedule,
    "warc_records": warc_records,
    "warc_roundtrip": warc_roundtrip,
    "archive_by_url": archive_by_url,
    "archive_by_table": archive_by_table,
    "archive_below_path": archive_below_path,
    "idn_links": idn_links,
    "resource_links": resource_links,
    "feed_links": feed_links,
    "long_links": long_links,
    "canonical_urls": canonical_urls,
    "sitemap_fields": sitemap_fields,
    "recrawl_due": recrawl_due,
    "crawl_round": crawl_round_query,
    "round_rejects": round_rejects,
    "round_retries": round_retries,
    "sitemap_broken": sitemap_broken,
    "frontier_orphans": frontier_orphans,
    "frontier_select_named": frontier_select_named,
    "outlinks_allowed_hosts": outlinks_allowed_hosts,
    "robots_from_fetches": robots_from_fetches,
    "stream_robots": stream_robots,
    "stream_retries": stream_retries,
    "stream_politeness": stream_politeness,
    "stream_frontier": stream_frontier,
}


def in_utc(query: Query) -> Query:
    """Timestamps without a zone in the tables are UTC."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return query(spark, sf)

    return run


def queries() -> dict[str, Query]:
    return {name: in_utc(query) for name, query in QUERIES.items()}
