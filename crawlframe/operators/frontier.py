"""The frontier: domains and URLs seen so far, merged and handed out set-wise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.operators.skew import split_join, with_dense_ids
from crawlframe.session import written

KEY = ("name", "path", "query")

DOMAIN_PROBLEM = r"""CASE
    WHEN name IS NULL THEN 'no_domain'
    WHEN name <> lower(name) THEN 'not_lowercase'
    WHEN name <> trim(name) THEN 'not_trimmed'
    WHEN name RLIKE '\\p{Cn}' THEN 'not_unicode'
    WHEN length(name) >= 255 THEN 'too_long' END"""


def keyed(links: DataFrame) -> DataFrame:
    """Frontier key of each link, with the reason that bars it, if any.

    Scheme, port, user information and fragment are not part of the key.
    ``first`` orders the inlinks of one URL; seeds, which have no page, come last.
    """
    return links.selectExpr(
        "u.domain AS name",
        "u.path AS path",
        "u.query AS query",
        "u.url AS url",
        "context",
        "struct(page_id IS NULL AS seed, page_id, pos) AS first",
        f"transform(array(u.domain), name -> {DOMAIN_PROBLEM})[0] AS reason",
    )


def offered_urls(links: DataFrame) -> DataFrame:
    """Distinct keys on offer; the context comes from the first inlink."""
    return (
        keyed(links)
        .filter("reason IS NULL")
        .groupBy(*KEY)
        .agg(F.min(F.struct("first", "context")).alias("s"))
        .select(*KEY, "s.context")
    )


def frontier_rejects(links: DataFrame) -> DataFrame:
    """Links whose host can not be a frontier domain."""
    bad = keyed(links).filter("reason IS NOT NULL")
    return bad.selectExpr("'frontier' AS stage", "url AS key", "reason").distinct()


def new_domain_names(offered: DataFrame, domain: DataFrame) -> DataFrame:
    return offered.select("name").distinct().join(domain.select("name"), "name", "left_anti")


def next_id(table: DataFrame, column: str) -> int:
    """One more than the largest id; a single value comes to the driver."""
    return (table.agg(F.max(column)).first()[0] or 0) + 1


def insert(
    offered: DataFrame, domain: DataFrame, url: DataFrame, batch_id: int
) -> tuple[DataFrame, DataFrame]:
    """New ``domain`` rows and new ``url`` rows for the keys in ``offered``.

    Names meet the domain table once. Known URLs are removed by a null-safe
    anti-join on (domain_id, path, query), which spreads even one huge domain.
    Ids are assigned last and only to new rows. An empty offer inserts nothing.
    The offer is written first, because two branches read it.
    """
    offered = written(offered, "offered")
    new_domains = with_dense_ids(
        new_domain_names(offered, domain), ["name"], "domain_id", next_id(domain, "domain_id")
    ).select("domain_id", "name", F.lit(batch_id).cast("bigint").alias("batch_id"))
    ids = domain.select("domain_id", "name").unionByName(new_domains.select("domain_id", "name"))
    placed = split_join(offered, ids, "name", ["path", "query"], how="inner")
    known = url.selectExpr("domain_id AS k_domain", "path AS k_path", "query AS k_query")
    fresh = placed.join(
        known,
        (F.col("domain_id") == F.col("k_domain"))
        & (F.col("path") == F.col("k_path"))
        & F.col("query").eqNullSafe(F.col("k_query")),
        "left_anti",
    )
    numbered = with_dense_ids(fresh, list(KEY), "url_id", next_id(url, "url_id"))
    new_urls = numbered.selectExpr(
        "url_id",
        "domain_id",
        "path",
        "query",
        "context",
        "cast(0 AS smallint) AS crawl_depth",
        "cast(1 AS float) AS crawl_priority",
        "cast(NULL AS string) AS http_etag",
        "cast(NULL AS timestamp) AS http_last_modified",
        f"{batch_id}L AS batch_id",
    )
    return new_domains, new_urls


def named(url: DataFrame, domain: DataFrame) -> DataFrame:
    """Frontier rows with the name of their domain."""
    return split_join(url, domain.select("domain_id", "name"), "domain_id", ["url_id"], "inner")


def integrity(url: DataFrame, domain: DataFrame) -> DataFrame:
    """Rows whose domain does not exist; one summary row, 0 when sound."""
    ids = url.groupBy("domain_id").agg(F.count(F.lit(1)).alias("n"))
    orphans = ids.join(domain.select("domain_id"), "domain_id", "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_orphans"))


def select_urls(
    url: DataFrame,
    domain: DataFrame,
    handed_out: DataFrame,
    names: Sequence[str] | None = None,
    per_domain: int = 10,
) -> DataFrame:
    """Up to ``per_domain`` URLs of each domain that were not handed out yet.

    The lowest ids come first (``rank``); ``turn`` is the hand-out order, last
    in, first out. The top-k limit runs before the shuffle, so the domain name
    joins at most ``per_domain`` rows per domain.
    """
    wanted = domain.select("domain_id", "name")
    rows = url.select("url_id", "domain_id", "path", "query")
    if names is not None:
        wanted = wanted.filter(F.col("name").isin(list(names)))
        rows = rows.join(wanted.select("domain_id"), "domain_id", "left_semi")
    waiting = rows.join(handed_out.select("url_id"), "url_id", "left_anti")
    ranked = waiting.selectExpr(
        "*", "row_number() OVER (PARTITION BY domain_id ORDER BY url_id) AS rank"
    ).filter(F.col("rank") <= per_domain)
    turned = ranked.selectExpr(
        "*", "cast(count(1) OVER (PARTITION BY domain_id) - rank + 1 AS int) AS turn"
    )
    return turned.join(wanted, "domain_id").select("url_id", *KEY, "rank", "turn")
