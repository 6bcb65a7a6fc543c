"""One crawl round as a batch: gate, parse, seed, gate the links, merge the frontier."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.operators import dispatch, frontier, robots
from crawlframe.operators.urls import parse_urls
from crawlframe.session import written


@dataclass
class Round:
    """Tables that a round adds. ``new_urls`` and ``new_domains`` go to the frontier.

    ``rejects`` (stage, key, reason) has every page and link that was dropped,
    ``retries`` (url, retry_s, next_attempt) the pages whose robots.txt must be
    fetched first. A link that is in neither is new or was known before.
    """

    new_domains: DataFrame
    new_urls: DataFrame
    rejects: DataFrame
    retries: DataFrame


def barred_pages(fetched: DataFrame, rules: DataFrame) -> DataFrame:
    """The fetches that robots.txt does not allow (page_id, url, decision, retry_s), from narrow rows only.

    A page whose own URL cannot be parsed has no rules to pass and is barred too.
    """
    parsed = parse_urls(fetched.select("page_id", "url"), "url")
    keys = parsed.filter("u.error IS NULL").selectExpr(
        "page_id", "url", "u.authority AS authority", "u.path AS path", "u.query AS query"
    )
    denied = robots.gate(keys, rules, ["page_id"]).filter("decision <> 'Allowed'")
    return denied.select("page_id", "url", "decision", "retry_s").unionByName(
        parsed.filter("u.error IS NOT NULL").selectExpr(
            "page_id", "url", "'Unparsable' AS decision", "NULL AS retry_s"
        )
    )


def seed_links(fetched: DataFrame, rules: DataFrame) -> DataFrame:
    """Sitemap links for the main pages among the fetches."""
    seeds = robots.root_seeds(fetched.select("url"), rules)
    return parse_urls(seeds.withColumnRenamed("url", "href"), "href").selectExpr(
        "cast(NULL AS bigint) AS page_id",
        "0 AS pos",
        "cast(NULL AS string) AS base_url",
        "href",
        "cast(NULL AS string) AS rel",
        "'Sitemap' AS context",
        "u",
        "cast(NULL AS string) AS reason",
    )


def gated_links(links: DataFrame, rules: DataFrame) -> DataFrame:
    """Links whose URL robots.txt allows.

    Distinct URLs, without fragment, keep their first inlink; each is matched
    once. Seeds count as found after the links of all pages.
    """
    parts = ["url", "authority", "domain", "path", "query"]
    first = (
        links.select("page_id", "pos", "context", *[F.col(f"u.{p}") for p in parts])
        .groupBy(*parts)
        .agg(F.min(F.struct(F.isnull("page_id"), "page_id", "pos", "context")).alias("s"))
        .select(
            F.struct(*parts).alias("u"),
            "authority", "path", "query", "s.page_id", "s.pos", "s.context",
        )
    )
    return robots.gate(first, rules, ["path", "query"])


def crawl_round(
    fetched: DataFrame,
    rules: DataFrame,
    domain: DataFrame | None,
    url: DataFrame | None,
    batch_id: int,
    extractors: Mapping[str, dispatch.Extractor] | None = None,
    checked_at: datetime | None = None,
    merge: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
) -> Round:
    """Links of ``fetched`` (page_id, url, body, context) merged into the frontier.

    Bodies are never shuffled: links leave them in the task that reads them, and
    the gate for the page itself applies to its links. The links are written
    once, with those that extraction drops, so the bodies are parsed a single
    time. Retries count from ``checked_at``, by default from now. ``merge`` turns
    the distinct keys on offer into new domains and URLs; without it they meet
    the given tables.
    """
    chosen = extractors or dispatch.default_extractors()
    barred = written(barred_pages(fetched, rules), "barred")
    ids = barred.select("page_id")
    pages = fetched.select("page_id", "url", "context").join(ids, "page_id", "left_anti")
    found = dispatch.extract_all(fetched, chosen).join(ids, "page_id", "left_anti")
    links = written(found.unionByName(seed_links(pages, rules)), "links")
    gated = written(gated_links(links.filter("reason IS NULL"), rules), "gated")
    kept = gated.filter("decision = 'Allowed'")
    offered = frontier.offered_urls(kept)
    new_domains, new_urls = merge(offered) if merge else frontier.insert(offered, domain, url, batch_id)
    rejects = (
        gated.filter("decision <> 'Allowed'")
        .selectExpr("'robots' AS stage", "u.url AS key", "lower(decision) AS reason")
        .unionByName(frontier.frontier_rejects(kept))
        .unionByName(dispatch.without_extractor(pages, chosen))
        .unionByName(
            barred.filter("decision <> 'Retry'").selectExpr(
                "'page' AS stage", "url AS key", "lower(decision) AS reason"
            )
        )
        .unionByName(
            links.filter("reason IS NOT NULL").selectExpr(
                "CASE WHEN reason IN ('bad_xml', 'no_loc', 'bad_loc') THEN 'sitemap' ELSE 'extract' END AS stage",
                "CASE WHEN reason IN ('bad_xml', 'no_loc') THEN base_url ELSE href END AS key",
                "reason",
            )
        )
    )
    now = F.current_timestamp() if checked_at is None else F.lit(checked_at).cast("timestamp")
    retries = barred.filter("decision = 'Retry'").select(
        "url", "retry_s", (now + F.make_dt_interval(secs=F.col("retry_s"))).alias("next_attempt")
    )
    return Round(new_domains, new_urls, rejects, retries)
