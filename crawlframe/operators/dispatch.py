"""Choose a link extractor by the context of a fetch; extractors can be plugged in."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions.bodies import body_text
from crawlframe.operators.links import resolved
from crawlframe.operators.sitemaps import all_entries
from crawlframe.schemas import PARSED_URL

OUTLINK = ("page_id", "pos", "base_url", "href", "rel", "context", "u")

Extractor = Callable[[DataFrame], DataFrame]


def html_extractor(allowed_hosts: Sequence[str] | None = None) -> Extractor:
    def extract(fetched: DataFrame) -> DataFrame:
        pages = fetched.selectExpr("page_id", "url", f"{body_text('body')} AS html")
        return resolved(pages, allowed_hosts).withColumn("context", F.lit("Other")).select(*OUTLINK, "reason")

    return extract


def sitemap_extractor(fetched: DataFrame) -> DataFrame:
    """Sitemap links pass no scheme, fragment, self or host filter."""
    docs = fetched.selectExpr("page_id", "url AS base_url", f"{body_text('body')} AS body")
    return all_entries(docs).selectExpr(
        "page_id", "pos", "base_url", "loc AS href", "cast(NULL AS string) AS rel", "context", "u", "reason"
    )


def feed_extractor(fetched: DataFrame) -> DataFrame:
    """Feeds give no links yet."""
    return fetched.filter(F.lit(False)).selectExpr(
        "page_id", "0 AS pos", "url AS base_url", "url AS href", "url AS rel", "context",
        f"cast(NULL AS {PARSED_URL}) AS u",
    )


def default_extractors(allowed_hosts: Sequence[str] | None = None) -> dict[str, Extractor]:
    return {
        "Other": html_extractor(allowed_hosts),
        "Sitemap": sitemap_extractor,
        "Feed": feed_extractor,
    }


def best_context(inlinks: str) -> str:
    """Context of the first inlink, Other if there is none."""
    return f"coalesce(try_element_at({inlinks}, 1).context, 'Other')"


def extract_all(
    fetched: DataFrame, extractors: Mapping[str, Extractor] | None = None
) -> DataFrame:
    """Links of each fetch by the extractor for its context (bag union), dropped ones with a ``reason``.

    ``fetched``: page_id, url, body, context. Each branch filters at the scan.
    An extractor of one's own may leave out the column ``reason``.
    """
    chosen = extractors or default_extractors()

    def part(name: str, extract: Extractor) -> DataFrame:
        rows = extract(fetched.filter(F.col("context") == name))
        reason = F.col("reason") if "reason" in rows.columns else F.lit(None).cast("string").alias("reason")
        return rows.select(*OUTLINK, reason)

    return reduce(DataFrame.unionByName, [part(*item) for item in chosen.items()])


def extract_outlinks(
    fetched: DataFrame, extractors: Mapping[str, Extractor] | None = None
) -> DataFrame:
    """The links that no reason drops."""
    return extract_all(fetched, extractors).filter("reason IS NULL").select(*OUTLINK)


def without_extractor(fetched: DataFrame, extractors: Mapping[str, Extractor]) -> DataFrame:
    missing = ~F.col("context").isin(list(extractors))
    return fetched.filter(missing | F.col("context").isNull()).selectExpr(
        "'extract' AS stage", "url AS key", "'no_extractor' AS reason"
    )


def outlinks_by_context(fetched: DataFrame) -> DataFrame:
    return extract_outlinks(fetched).groupBy("context").agg(F.count(F.lit(1)).alias("n"))
