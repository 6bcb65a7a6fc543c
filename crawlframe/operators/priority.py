"""URL priorities: domain-crossing hops over the link graph, and what a URL looks like.

A URL's hops are the fewest changes of domain on any path of links from a seed.
They are found layer by layer: all URLs of one layer are closed under links
inside a domain before the links that leave it open the next. So every URL is
reached once, and its links are followed once. Each round is written; the links
are bucketed by their source and the URLs reached by their key, so a round moves
only the URLs that it newly reaches and the ends of their links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import urls as U
from crawlframe.operators.frontier import KEY
from crawlframe.operators.skew import shuffle_width, with_dense_ids
from crawlframe.session import fresh_path, written
from crawlframe.sources.buckets import BucketTable

MAX_HOPS = 8
# What a URL without a priority of its own starts with; sitemaps name the same default.
USUAL = 0.5
# How much a hop, a query parameter, a path element and a hundred links beside it cost.
HOP, PARAMETER, ELEMENT, CROWD = 1.0, 0.3, 0.1, 0.1


def key_of(struct: str) -> str:
    return U.frontier_key(*[f"{struct}.{part}" for part in ("domain", "path", "query")])


def link_edges(links: DataFrame) -> DataFrame:
    """(src, dst, crossing) of links with the parsed URLs ``base`` and ``u``, each edge once."""
    return links.selectExpr(
        f"{key_of('base')} AS src", f"{key_of('u')} AS dst", "base.domain <=> u.domain AS inside"
    ).selectExpr("src", "dst", "NOT inside AS crossing").filter("src <> dst").distinct()


def hop_counts(edges: DataFrame, seeds: DataFrame, max_hops: int = MAX_HOPS, buckets: int | None = None) -> DataFrame:
    """(key, hops) of all keys that are reached from ``seeds`` (key) by at most ``max_hops`` crossings.

    Stops when a layer reaches nothing new or after the last layer. The number
    of rounds is that of the longest shortest path inside a domain, per layer.
    """
    spark = edges.sparkSession
    buckets = buckets or shuffle_width(edges)
    links = BucketTable(spark, fresh_path(spark, "edges"), "src binary, dst binary, crossing boolean", "src", buckets, "part")
    links.write(edges, 0)
    reached = BucketTable(spark, fresh_path(spark, "reached"), "key binary, hops int", "key", buckets, "round")

    def step(found: DataFrame, hops: int, turn: int) -> DataFrame | None:
        """Note the keys that no earlier round reached; None if there are none."""
        known = reached.read(turn).select("key")
        new = reached.dealt(found.distinct()).join(known.hint("merge"), "key", "left_anti")
        reached.write(written(new.withColumn("hops", F.lit(hops)), "round"), turn)
        part = reached.read().filter(F.col("round") == turn).select("key")
        return None if part.isEmpty() else part

    def ends(keys: DataFrame, crossing: bool) -> DataFrame:
        out = links.read().filter(F.col("crossing") == crossing).select("src", "dst")
        return out.join(keys.withColumnRenamed("key", "src").hint("merge"), "src", "left_semi").select(F.col("dst").alias("key"))

    turn = 0
    found = seeds.select("key")
    for hops in range(max_hops + 1):
        first = turn
        while (part := step(found, hops, turn)) is not None:
            turn += 1
            found = ends(part, False)
        turn += 1
        if part is None and turn == first + 1:
            break
        found = ends(reached.read().filter(F.col("hops") == hops).select("key"), True)
    return reached.read().select("key", "hops")


def sitemap_priority(declared: str) -> str:
    """A declared priority as a number above 0 and at most 1; the usual one where it is none."""
    value = f"try_cast(trim({declared}) AS double)"
    return f"CASE WHEN isnan({value}) OR {value} IS NULL THEN {USUAL}D ELSE least(greatest({value}, 0.01D), 1D) END"


def score(base: str, hops: str, path: str, query: str, crowd: str) -> str:
    """A priority between 0 and 1. A parameter costs more than a path element."""
    elements = f"size(filter(split({path}, '/'), e -> e <> ''))"
    parameters = f"size(filter(split(coalesce({query}, ''), '&'), e -> e <> ''))"
    return f"""{base} / (1D + {HOP}D * {hops}) / (1D + {ELEMENT}D * {elements})
        / (1D + {PARAMETER}D * {parameters}) / (1D + {CROWD}D * ({crowd} / 100D))"""


def url_priority(
    links: DataFrame, seeds: DataFrame, declared: DataFrame | None = None, max_hops: int = MAX_HOPS
) -> DataFrame:
    """(name, path, query, hops, priority) of every URL that is linked to.

    ``links``: parsed URLs ``base`` and ``u`` and the link's ``context``; ``seeds``:
    a parsed URL ``u``; ``declared``: a parsed URL ``u`` and ``priority``, a sitemap's
    text for it. A sitemap has priority 1. ``crowd`` is the number of links on
    the page with the fewest of those that a URL was found on. A URL out of
    reach counts as one hop beyond ``max_hops`` and has NULL hops.
    """
    known = written(links.select("base", "u", "context"), "links")
    hops = hop_counts(link_edges(known), seeds.selectExpr(f"{key_of('u')} AS key"), max_hops)
    pairs = known.selectExpr(
        f"{key_of('base')} AS src", f"{key_of('u')} AS key", "u.domain AS name", "u.path", "u.query", "context = 'Sitemap' AS map"
    )
    crowds = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("crowd"))
    # The locations of a URL combine before they meet; a URL found on very many pages is one row per page size.
    places = pairs.groupBy("key", *KEY, "src").agg(F.max("map").alias("map"))
    urls = places.join(crowds, "src").groupBy("key", *KEY).agg(F.min("crowd").alias("crowd"), F.max("map").alias("map"))
    placed = urls.join(hops, "key", "left")
    if declared is None:
        placed = placed.withColumn("base", F.lit(USUAL))
    else:
        told = declared.selectExpr(f"{key_of('u')} AS key", f"{sitemap_priority('priority')} AS base")
        best = told.groupBy("key").agg(F.max("base").alias("base"))
        placed = placed.join(best, "key", "left").withColumn("base", F.coalesce("base", F.lit(USUAL)))
    value = score("base", f"coalesce(hops, {max_hops + 1})", "path", "query", "crowd")
    return placed.selectExpr(*KEY, "hops", f"CASE WHEN map THEN 1D ELSE {value} END AS priority")


def with_priorities(url: DataFrame, domain: DataFrame, priorities: DataFrame) -> DataFrame:
    """``url`` rows with ``crawl_priority`` from :func:`url_priority`; others keep theirs."""
    found = priorities.selectExpr(f"{U.frontier_key(*KEY)} AS _key", "cast(priority AS float) AS _priority")
    named = url.join(domain.select("domain_id", "name"), "domain_id", "left").withColumn("_key", F.expr(U.frontier_key(*KEY)))
    joined = named.join(found, "_key", "left")
    kept = [F.coalesce("_priority", c).alias(c) if c == "crawl_priority" else c for c in url.columns]
    return joined.select(*kept)


def next_by_priority(
    url: DataFrame, domain: DataFrame, handed_out: DataFrame, per_domain: int = 10, first: int = 1
) -> DataFrame:
    """What to crawl next: the best URLs of each domain in turn, round after round.

    Every domain gives its best ``per_domain`` URLs that were not handed out;
    ``rank`` is the place inside the domain, ``position`` the order over all: first
    the best URL of every domain, by priority, then the second best, and so on.
    URLs of priority 0 are never crawled. Ids and priorities alone are ranked,
    cut to ``per_domain`` per domain and task before they move; the order over all
    comes from range partitions, not from a sort in one task.
    """
    narrow = url.filter("crawl_priority > 0").select("url_id", "domain_id", "crawl_priority")
    waiting = narrow.join(handed_out.select("url_id"), "url_id", "left_anti")
    ranked = waiting.selectExpr(
        "*", "row_number() OVER (PARTITION BY domain_id ORDER BY crawl_priority DESC, url_id) AS rank"
    ).filter(F.col("rank") <= per_domain)
    texts = url.select("url_id", "path", "query")
    rows = ranked.join(texts, "url_id").join(domain.select("domain_id", "name"), "domain_id")
    ordered = rows.withColumn("_down", -F.col("crawl_priority"))
    placed = with_dense_ids(ordered, ["rank", "_down", "name", "url_id"], "position", first)
    return placed.select("url_id", *KEY, "crawl_priority", "rank", "position")
