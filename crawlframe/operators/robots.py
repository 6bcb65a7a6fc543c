"""robots.txt as tables: rules per authority, link and fetch gates, freshness."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import robots as R
from crawlframe.functions import urls as U
from crawlframe.functions.bodies import body_text, older_than
from crawlframe.operators.skew import split_join
from crawlframe.operators.urls import parse_urls

DAY = 86400


def robots_fetches(fetch_results: DataFrame) -> DataFrame:
    """The robots.txt fetches among all fetch results."""
    parsed = parse_urls(fetch_results.select("url", "start", "status", "body"), "url")
    return parsed.filter("u.path = '/robots.txt' AND u.query IS NULL").selectExpr(
        "u.authority AS authority", "start", "status", f"{body_text('body')} AS body"
    )


def robots_access(fetches: DataFrame) -> DataFrame:
    """Latest access result per authority."""
    seen = fetches.selectExpr("authority", f"struct(start, {R.access('status')} AS access) AS s")
    return seen.groupBy("authority").agg(F.max("s").alias("s")).select("authority", "s.access")


def robots_table(fetches: DataFrame, bot: str) -> DataFrame:
    """One row per authority from its latest robots.txt: access, rules, sitemaps.

    Bodies are parsed where they are read; only the parsed rules are shuffled,
    after the partial aggregate.
    """
    ok = "access = 'Ok'"
    parsed = fetches.selectExpr(
        "authority",
        "start AS updated",
        f"{R.access('status')} AS access",
        f"{R.plain_lines('body')} AS _lines",
        f"CASE WHEN {ok} THEN {R.rules('_lines', bot)} END AS rules",
        f"CASE WHEN {ok} THEN {R.sitemaps('body')} END AS sitemaps",
    )
    latest = parsed.groupBy("authority").agg(
        F.max(F.struct("updated", "access", "rules", "sitemaps")).alias("s")
    )
    return latest.select("authority", "s.access", "s.updated", "s.rules", "s.sitemaps")


def robots_rules(robots: DataFrame) -> DataFrame:
    return robots.selectExpr("authority", "inline(rules)").select(
        "authority", "rx", "len", "allow"
    )


def gate(urls: DataFrame, robots: DataFrame, spread: list[str]) -> DataFrame:
    """Add access, decision and retry_s to rows with authority, path and query."""
    rules = robots.select("authority", "access", "rules")
    joined = split_join(urls, rules, "authority", spread, store=True)
    kept = [f"`{c}`" for c in urls.columns]
    return joined.selectExpr(
        *kept,
        "access",
        f"{U.target('path', 'query')} AS _pq",
        f"{R.decision('access', 'rules', '_pq')} AS decision",
        f"{R.retry_seconds('access', 'decision')} AS retry_s",
    ).drop("_pq")


def robots_gate(links: DataFrame, robots: DataFrame) -> DataFrame:
    """Decision per link row; each distinct URL is matched once.

    Pages of a site repeat the same links, so the URLs are made distinct before
    they meet the rules.
    """
    targets = links.selectExpr(
        "u.authority AS authority", "u.path AS path", "u.query AS query", "u.url AS url"
    ).distinct()
    return gate(targets, robots, ["url"]).select("url", "decision")


def fetch_gate(pages: DataFrame, robots: DataFrame, checked_at: datetime | None = None) -> DataFrame:
    """Decision per page to fetch; a Retry says when to try again."""
    parsed = parse_urls(pages.select("page_id", "url"), "url").filter("u.error IS NULL")
    rows = parsed.selectExpr(
        "page_id", "u.authority AS authority", "u.path AS path", "u.query AS query"
    )
    out = gate(rows, robots, ["page_id"]).select("page_id", "decision", "retry_s")
    if checked_at is None:
        return out
    now = F.lit(checked_at).cast("timestamp")
    return out.withColumn("next_attempt", now + F.make_dt_interval(secs=F.col("retry_s")))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Sitemap URLs that robots.txt files declare, with context Sitemap."""
    listed = robots.selectExpr("authority", "explode(sitemaps) AS declared")
    parsed = parse_urls(listed, "declared").filter("u.error IS NULL")
    return parsed.selectExpr("authority", "u.url AS sitemap_url", "u", "'Sitemap' AS context")


def root_seeds(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """Sitemaps of each site whose main page was fetched; /sitemap.xml if none is declared."""
    parsed = parse_urls(pages.select("url"), "url")
    root = U.is_domain_root("u.authority", "u.path", "u.query")
    roots = parsed.filter(f"u.error IS NULL AND {root}").selectExpr(
        "u.authority AS authority", "u.scheme AS scheme"
    ).distinct()
    declared = robots_sitemaps(robots).selectExpr("authority", "u.url AS declared")
    joined = roots.join(declared, "authority", "left")
    default = U.with_path_only("scheme", "authority", "sitemap.xml")
    return joined.selectExpr("authority", f"coalesce(declared, {default}) AS url").distinct()


def run_heads(log: DataFrame) -> DataFrame:
    """Per authority: latest access and, if unreachable, when that run of failures began.

    ``log``: authority, event_id, start, status. Two aggregates that combine
    before they shuffle; no window over a whole authority.
    """
    rows = log.selectExpr(
        "authority", "struct(start, event_id) AS at", f"{R.access('status')} AS access"
    )
    latest = rows.groupBy("authority").agg(
        F.max(F.struct("at", "access")).alias("s"),
        F.max(F.when(F.col("access") != "Unreachable", F.col("at"))).alias("last_ok"),
    ).select("authority", "s.access", "s.at", "last_ok")
    down = latest.filter("access = 'Unreachable'").select("authority", "last_ok")
    failures = rows.filter("access = 'Unreachable'").select("authority", "at")
    first = (
        split_join(failures, down, "authority", ["at"], how="inner")
        .filter("last_ok IS NULL OR at > last_ok")
        .groupBy("authority")
        .agg(F.min("at").alias("first"))
    )
    return latest.join(first, "authority", "left").selectExpr(
        "authority",
        "access",
        "at.start AS updated",
        "first.start AS first_tried",
        "last_ok IS NOT NULL AS had_ok",
    )


def verdict(access: str, updated: str, now: str) -> str:
    """What a lookup at ``now`` does with the entry: reuse, fetch or unavailable."""
    return f"""CASE WHEN {access} IS NULL THEN 'fetch'
        WHEN NOT {older_than(updated, now, DAY)} THEN 'reuse'
        WHEN {access} = 'Unreachable' AND {older_than(updated, now, 30 * DAY)} THEN 'unavailable'
        ELSE 'fetch' END"""


def robots_state(log: DataFrame, lookups: DataFrame) -> DataFrame:
    """State of each authority at its lookup time (``lookups``: authority, now)."""
    state = run_heads(log)
    return lookups.join(state, "authority", "left").selectExpr(
        "authority", "access", "updated", "first_tried", f"{verdict('access', 'updated', 'now')} AS verdict"
    )
