"""Crawl tables that Spark derives from the given tables, all rows and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe import schemas
from crawlframe.operators.links import html_outlinks
from crawlframe.operators.urls import parse_urls

BOT = "crawlframe"
URLS_PER_SITEMAP = 1000

ROBOTS_BODY = "User-agent: *\\nDisallow: /de\\nAllow: /der\\nDisallow: /*.html$\\n"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(f"{sf}/pages.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    return spark.read.schema(schema).parquet(f"{sf}/events.parquet")


def fetches(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a fetch result with two headers, one of them repeated."""
    return pages(spark, sf).selectExpr(
        "page_id",
        "url",
        "timestamp_seconds(1704067200 + page_id) AS start",
        "200 AS status",
        "'HTTP/1.1' AS http_version",
        """array(named_struct('name', 'content-type', 'value', 'text/html'),
                 named_struct('name', 'x-page', 'value', cast(page_id AS string)),
                 named_struct('name', 'x-page', 'value', url)) AS headers""",
        "encode(html, 'UTF-8') AS body",
        "'Other' AS context",
    )


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Authority and domain of each page URL."""
    return (
        parse_urls(pages(spark, sf).select("page_id", "url"), "url")
        .filter("u.error IS NULL")
        .selectExpr("page_id", "url", "u.scheme", "u.authority", "u.domain")
    )


def robots(spark: SparkSession, sf: str) -> DataFrame:
    """A robots.txt fetch per authority: found, missing or failing by the length of its name."""
    return (
        sites(spark, sf)
        .select("authority")
        .distinct()
        .selectExpr(
            "authority",
            "timestamp_seconds(1704067200) AS start",
            "CASE length(authority) % 5 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS status",
            f"""CASE WHEN length(authority) % 5 < 2 THEN ''
                WHEN length(authority) % 5 = 2 THEN concat('{ROBOTS_BODY}', 'Sitemap: https://',
                     authority, '/sitemap_main.xml\\n')
                ELSE '{ROBOTS_BODY}' END AS body""",
        )
    )


def sitemaps(spark: SparkSession, sf: str, declared: str = "''") -> DataFrame:
    """Sitemap files that list every page of a site, at most a thousand per file.

    Sites with a declared sitemap also get an index file. ``declared`` is SQL for
    more fields of a page's entry.
    """
    listed = sites(spark, sf).selectExpr(
        "authority",
        f"page_id DIV {URLS_PER_SITEMAP} AS part",
        "struct(page_id, concat('<url><loc>', replace(url, '&', '&amp;'), '</loc>',"
        f" {declared}, '</url>') AS x) AS e",
    )
    files = (
        listed.groupBy("authority", "part")
        .agg(F.sort_array(F.collect_list("e")).alias("es"))
        .selectExpr(
            "authority",
            "concat('https://', authority, '/sitemap_', part, '.xml') AS url",
            """concat('<?xml version="1.0" encoding="UTF-8"?>',
               '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">',
               array_join(transform(es, e -> e.x), ''), '</urlset>') AS body""",
        )
    )
    index = (
        robots(spark, sf)
        .filter("body LIKE '%Sitemap:%'")
        .selectExpr(
            "authority",
            "concat('https://', authority, '/sitemap_main.xml') AS url",
            """concat('<sitemapindex><sitemap><loc> https://', authority,
               '/sitemap_0.xml </loc></sitemap></sitemapindex>') AS body""",
        )
    )
    return files.unionByName(index).withColumn("context", F.lit("Sitemap"))


def fetch_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a fetch from the site of the page that its user number names."""
    return (
        events(spark, sf)
        .join(sites(spark, sf).select("page_id", "authority"), F.col("user_id") == F.col("page_id"))
        .selectExpr(
            "authority",
            "event_id",
            "cast(ts AS timestamp) AS start",
            "cast(greatest(round(value * 10000), 0) AS bigint) AS duration_us",
            "CASE event_type WHEN 'purchase' THEN 404 WHEN 'error' THEN 503 ELSE 200 END AS status",
        )
    )


def lookups(log: DataFrame) -> DataFrame:
    """When each site of the log is looked up: 0, 20 or 40 days after 31 January 2024."""
    return (
        log.select("authority")
        .distinct()
        .selectExpr(
            "authority",
            "timestamp_seconds(1706659200 + 86400 * 20 * (length(authority) % 3)) AS now",
        )
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    return html_outlinks(pages(spark, sf))


def known_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The pages of an earlier round: those fetched over plain http."""
    return pages(spark, sf).filter("url LIKE 'http:%'")


# A page's declared change: a year, a month, a day, a time, one beside Greenwich, and no date at all.
DECLARED = """concat('<lastmod>', element_at(array('2023', '2024-01', '2024-01-01', '2024-01-01T00:20Z',
    '2024-01-01T02:20:30.5+02:00', 'yesterday', '2031-05'), cast(page_id % 7 + 1 AS int)), '</lastmod><priority>',
    page_id % 13 DIV 10, '.', page_id % 13 % 10, '</priority>')"""


def dated_sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemaps whose entries say when a page changed and how important it is."""
    return sitemaps(spark, sf, DECLARED)


def feeds(spark: SparkSession, sf: str) -> DataFrame:
    """A feed per site that lists all its pages: RSS where the site's name has an even length, else Atom.

    Atom entries name their pages relative to the entry's base.
    """
    listed = parse_urls(pages(spark, sf).select("page_id", "url"), "url").filter("u.error IS NULL").selectExpr(
        "u.authority AS authority",
        """struct(page_id, CASE WHEN length(u.authority) % 2 = 0
            THEN concat('<item><title>t</title><link> ', replace(url, '&', '&amp;'), ' </link></item>')
            ELSE concat('<entry xml:base="', u.scheme, '://', u.authority, '/x/"><link rel="self" href="/self"/><link href="..',
                u.path, replace(coalesce(concat('?', u.query), ''), '&', '&amp;'), '"/></entry>') END AS x) AS e""",
    )
    return listed.groupBy("authority").agg(F.sort_array(F.collect_list("e")).alias("es")).selectExpr(
        "concat('https://', authority, '/feed') AS url",
        """CASE WHEN length(authority) % 2 = 0
            THEN concat('<rss version="2.0"><channel>', array_join(transform(es, e -> e.x), ''), '</channel></rss>')
            ELSE concat('<feed xmlns="http://www.w3.org/2005/Atom">', array_join(transform(es, e -> e.x), ''), '</feed>') END AS body""",
    )
