"""Sitemap documents: entries and broken files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.sql import null_text, text
from crawlframe.functions.urls import URL_LIMIT
from crawlframe.operators.urls import parse_urls

ENTRY_FIELDS = "loc string, lastmod string, priority string"
FIELDS = f"array<struct<{ENTRY_FIELDS.replace(' ', ':').replace(',:', ',')}>>"
SCHEMA = f"url {FIELDS}, sitemap {FIELDS}, _corrupt_record string"
BROKEN = "x IS NULL OR x._corrupt_record IS NOT NULL"

# A complete entry without another one inside; possessive, so a file is scanned once.
ENTRY = (
    r"<(url|sitemap)(?=[\s>])[^>]*+>"
    r"(?:[^<]++|<(?!/?(?:url|sitemap)[\s>]))*+</\1\s*+>"
)


def read_xml(sitemaps: DataFrame) -> DataFrame:
    """Parse each body once; a broken document fills ``x._corrupt_record``."""
    rest = [f"`{c}`" for c in sitemaps.columns]
    return sitemaps.selectExpr(*rest, f"from_xml(body, {text(SCHEMA)}) AS x")


def all_entries(sitemaps: DataFrame) -> DataFrame:
    """One row per ``<url>`` (SitemapLink) and ``<sitemap>`` (Sitemap), with a ``reason`` to drop it, if any.

    A document that is not well-formed gives its complete entries, each parsed
    on its own, and one row more with reason ``bad_xml``. Other reasons:
    ``no_loc`` and ``bad_loc``, also for an entry that is broken itself, and
    ``too_long``. ``lastmod`` and ``priority`` are as declared.
    """
    rest = [f"`{c}`" for c in sitemaps.columns if c not in ("body", "context")]

    none = null_text()
    no_fields = f"named_struct('loc', {none}, 'lastmod', {none}, 'priority', {none})"

    def row(context: str, fields: str, entry: str) -> str:
        return f"named_struct('context', {context}, 'fields', {fields}, 'entry', {entry})"

    whole = f"""concat(
        transform(coalesce(x.url, array()), e -> {row("'SitemapLink'", "e", none)}),
        transform(coalesce(x.sitemap, array()), e -> {row("'Sitemap'", "e", none)}))"""
    context = "CASE WHEN startswith(b, '<url') THEN 'SitemapLink' ELSE 'Sitemap' END"
    pieces = f"""concat(
        transform(regexp_extract_all(coalesce(body, ''), {text(ENTRY)}, 0), b -> {row(context, no_fields, "b")}),
        array({row(none, no_fields, none)}))"""
    exploded = (
        read_xml(sitemaps)
        .selectExpr(*rest, f"posexplode(CASE WHEN {BROKEN} THEN {pieces} ELSE {whole} END) AS (pos, e)")
        .selectExpr(
            *rest,
            "pos",
            "e.context AS context",
            f"CASE WHEN e.entry IS NULL THEN e.fields ELSE from_xml(e.entry, {text(ENTRY_FIELDS)}) END AS _fields",
        )
        .selectExpr(*rest, "pos", "context", "_fields.loc AS loc", "_fields.lastmod AS lastmod", "_fields.priority AS priority")
    )
    return parse_urls(exploded, "loc").selectExpr(
        "*",
        f"""CASE WHEN context IS NULL THEN 'bad_xml' WHEN loc IS NULL THEN 'no_loc'
        WHEN u.error IS NOT NULL THEN 'bad_loc' WHEN length(u.url) >= {URL_LIMIT} THEN 'too_long' END AS reason""",
    )


def entries(sitemaps: DataFrame) -> DataFrame:
    """The entries that have a good loc, also those of broken documents."""
    return all_entries(sitemaps).filter("reason IS NULL").drop("reason")


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    found = entries(sitemaps.select("authority", "body"))
    return found.select("authority", "context", "loc")


def bad_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """Documents that are not well-formed."""
    return (
        read_xml(sitemaps.select("url", "body"))
        .filter(BROKEN)
        .selectExpr("'sitemap' AS stage", "url AS key", "'bad_xml' AS reason")
    )


TIME = r"T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})"


def change_start(lastmod: str) -> str:
    """The first instant that a W3C date stands for: a year, month, day or time; NULL if it is none."""
    v = f"trim({lastmod})"
    return f"""CASE
        WHEN {v} RLIKE '^\\\\d{{4}}$' THEN try_cast(concat({v}, '-01-01T00:00:00Z') AS timestamp)
        WHEN {v} RLIKE '^\\\\d{{4}}-\\\\d{{2}}$' THEN try_cast(concat({v}, '-01T00:00:00Z') AS timestamp)
        WHEN {v} RLIKE '^\\\\d{{4}}-\\\\d{{2}}-\\\\d{{2}}$' THEN try_cast(concat({v}, 'T00:00:00Z') AS timestamp)
        WHEN {v} RLIKE {text(rf"^\d{{4}}-\d{{2}}-\d{{2}}{TIME}$")} 
            THEN try_cast(regexp_replace({v}, '^(.{{16}})([Z+-])', '$1:00$2') AS timestamp) END"""


def change_end(lastmod: str) -> str:
    """Where the period of a W3C date ends; a full time is its own end."""
    v, start = f"trim({lastmod})", change_start(lastmod)

    def after(day: str, months: int) -> str:
        return f"try_cast(concat(cast(add_months(try_cast({day} AS date), {months}) AS string), 'T00:00:00Z') AS timestamp)"

    return f"""transform(array({start}), s -> CASE WHEN s IS NULL THEN s
        WHEN length({v}) = 4 THEN {after(f"concat({v}, '-01-01')", 12)}
        WHEN length({v}) = 7 THEN {after(f"concat({v}, '-01')", 1)}
        WHEN length({v}) = 10 THEN s + INTERVAL 24 HOURS ELSE s END)[0]"""


def sitemap_fields(sitemaps: DataFrame) -> DataFrame:
    """Every good entry with what it declares: loc, url, changed_from, changed_to, priority.

    A date of less than a time stands for a period, so a change may lie anywhere
    in it. Priorities are clamped to more than 0 and at most 1; one that is no
    number, or none, is the usual one.
    """
    from crawlframe.operators.priority import sitemap_priority

    return entries(sitemaps).selectExpr(
        *[f"`{c}`" for c in sitemaps.columns if c not in ("body", "context")],
        "context", "loc", "u.url AS url",
        f"{change_start('lastmod')} AS changed_from",
        f"{change_end('lastmod')} AS changed_to",
        f"{sitemap_priority('priority')} AS priority",
    )


def recrawl_due(fields: DataFrame, fetched: DataFrame, now: datetime) -> DataFrame:
    """(url, reason, priority): listed URLs to fetch, ``new`` ones and those ``changed`` since their last fetch.

    ``fields`` comes from :func:`sitemap_fields`; ``fetched``: url, start. A change
    counts up to ``now``; a date that begins later says nothing. Where the
    period of a change is not over at the last fetch, the URL is due once more.
    Entries and fetches combine to one row per URL before they meet.
    """
    moment = F.lit(now).cast("timestamp")
    known = F.when(F.col("changed_from") <= moment, F.least("changed_to", moment))
    listed = fields.groupBy("url").agg(F.max(known).alias("changed"), F.max("priority").alias("priority"))
    last = parse_urls(fetched.select("url", "start"), "url").filter("u.error IS NULL")
    last = last.groupBy(F.col("u.url").alias("url")).agg(F.max("start").alias("last"))
    reason = F.when(F.col("last").isNull(), "new").when(F.col("last") < F.col("changed"), "changed")
    return listed.join(last, "url", "left").select("url", reason.alias("reason"), "priority").filter("reason IS NOT NULL")
