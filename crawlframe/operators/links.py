"""Anchors of HTML pages: extract, resolve, filter, count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import html
from crawlframe.functions.sql import text
from crawlframe.functions.urls import URL_LIMIT
from crawlframe.operators.urls import parse_urls


def anchors(pages: DataFrame, outer: bool = False) -> DataFrame:
    """One row per ``<a href>`` in document order; ``html`` ends here.

    With ``outer`` a page without anchors keeps one row whose ``pos`` is NULL.
    """
    spread = "posexplode_outer" if outer else "posexplode"
    rest = [f"`{c}`" for c in pages.columns if c != "html"]
    return (
        pages.selectExpr(*rest, f"{spread}({html.anchor_attributes('html')}) AS (pos, _attrs)")
        .selectExpr(
            *rest,
            "pos",
            f"{html.attribute('_attrs', 'href')} AS _href",
            f"{html.attribute('_attrs', 'rel')} AS _rel",
            f"{html.decode_references('_href')} AS href",
            f"{html.decode_references('_rel')} AS rel",
        )
        .drop("_href", "_rel")
    )


def outlinks_raw(pages: DataFrame) -> DataFrame:
    return anchors(pages.select("page_id", "html")).select("page_id", "pos", "href")


def resolved(
    pages: DataFrame, allowed_hosts: Sequence[str] | None = None, outer: bool = False
) -> DataFrame:
    """All anchors with their joined URL ``u`` and the ``reason`` to drop one, if any.

    Reasons: ``not_http``, ``unparsable``, ``idn_host``, ``self_link``,
    ``too_long``, ``host_not_allowed``. The fragment of the page URL is not part of the
    self-link test.
    """
    based = parse_urls(pages.withColumnRenamed("url", "base_url"), "base_url", out="base")
    links = parse_urls(anchors(based, outer), "href", out="u", base="base")
    outside = "false"
    if allowed_hosts is not None:
        hosts = ", ".join(text(h.lower()) for h in allowed_hosts) or "NULL"
        outside = f"NOT coalesce(u.domain IN ({hosts}), false)"
    return links.withColumn(
        "reason",
        F.expr(
            f"""CASE WHEN pos IS NULL THEN NULL
            WHEN u.error = 'scheme' THEN 'not_http'
            WHEN u.error = 'idn_host' THEN 'idn_host'
            WHEN u.error IS NOT NULL THEN 'unparsable'
            WHEN u.url = base.url THEN 'self_link'
            WHEN length(u.url) >= {URL_LIMIT} THEN 'too_long'
            WHEN {outside} THEN 'host_not_allowed' END"""
        ),
    )


def html_outlinks(pages: DataFrame, allowed_hosts: Sequence[str] | None = None) -> DataFrame:
    """The links that a page contributes, with the parts later steps key on."""
    kept = [c for c in pages.columns if c not in ("url", "html", "context")]
    return (
        resolved(pages, allowed_hosts)
        .filter("reason IS NULL")
        .selectExpr(*kept, "pos", "base_url", "href", "rel", "'Other' AS context", "u")
    )


def outlinks_resolved(
    pages: DataFrame, allowed_hosts: Sequence[str] | None = None
) -> DataFrame:
    links = html_outlinks(pages.select("page_id", "url", "html"), allowed_hosts)
    return links.selectExpr("page_id", "pos", "u.url AS url")


def outlink_rejects(pages: DataFrame, allowed_hosts: Sequence[str] | None = None) -> DataFrame:
    """Anchors that were dropped, and why."""
    return (
        resolved(pages.select("page_id", "url", "html"), allowed_hosts)
        .filter("reason IS NOT NULL")
        .select("page_id", "pos", "href", "reason")
    )


def outlink_counts(pages: DataFrame, allowed_hosts: Sequence[str] | None = None) -> DataFrame:
    """Links kept per page; pages without links count 0."""
    return (
        resolved(pages.select("page_id", "url", "html"), allowed_hosts, outer=True)
        .groupBy("page_id")
        .agg(F.expr("count(CASE WHEN pos IS NOT NULL AND reason IS NULL THEN 1 END) AS n_links"))
    )
