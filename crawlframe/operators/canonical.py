"""Canonical URLs: what pages name as their canonical address, followed to its end, without tracking parameters.

Each URL names at most one other. Chains are followed by pointer jumping: every
round a URL's pointer moves to where its target's pointer leads, so a chain of n
links takes log n rounds. What is left when no chain can be longer lies on, or
leads into, a cycle; there the least URL of the cycle stands for all. URLs whose
end is known leave the rounds. Each round is written, and a target that very many
URLs name is dealt over pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import html
from crawlframe.functions import urls as U
from crawlframe.functions.sql import text
from crawlframe.operators.resources import tags_of
from crawlframe.operators.skew import split_join
from crawlframe.operators.urls import parse_urls
from crawlframe.session import written

# Query parameters that say where a visitor came from and nothing about the page.
TRACKING = "utm_[^=]*|gclid|dclid|gbraid|wbraid|fbclid|msclkid|yclid|igshid|mc_cid|mc_eid|_ga|_gl"


def without_tracking(query: str) -> str:
    """A query without its tracking parameters; none if nothing else was in it."""
    kept = f"filter(split({query}, '&'), p -> NOT p RLIKE {text(f'(?i)^(?:{TRACKING})(?:=|$)')})"
    return f"CASE WHEN size({kept}) > 0 OR {query} IS NULL THEN array_join({kept}, '&') END"


def clean_url(u: str) -> str:
    """The URL of a parsed struct without fragment and tracking parameters."""
    return f"concat({u}.scheme, '://', {u}.authority, {U.target(f'{u}.path', without_tracking(f'{u}.query'))})"


def declared(pages: DataFrame) -> DataFrame:
    """(page_id, url, target): each page's clean URL and the one its first canonical link names, NULL without one.

    A link that is no good http(s) URL counts as none. Pages whose own URL is
    bad are left out.
    """
    links = f"filter({tags_of('html')}, t -> t RLIKE '(?i)^link')"
    rel = html.decode_references(html.attribute("a", "rel"))
    href = html.decode_references(html.attribute("a", "href"))
    named = f"transform({links}, t -> transform(array(regexp_replace(substr(t, 5), '>$', '')), a -> named_struct('rel', {rel}, 'href', {href}))[0])"
    first = f"try_element_at(filter({named}, l -> array_contains(split(lower(trim(l.rel)), '\\\\s+'), 'canonical') AND l.href IS NOT NULL), 1).href"
    based = parse_urls(pages.selectExpr("page_id", "url", f"{first} AS _href"), "url", out="base").filter("base.error IS NULL")
    joined = parse_urls(based, "_href", out="u", base="base")
    return joined.selectExpr("page_id", f"{clean_url('base')} AS url", f"CASE WHEN u.error IS NULL THEN {clean_url('u')} END AS target")


def chain_ends(links: DataFrame) -> DataFrame:
    """(node, end) for every ``node`` of ``links`` (node, next), which has one row per node and none to itself."""
    live = written(links.selectExpr("node", "next AS at", "node AS low"), "live")
    done: DataFrame | None = None
    reach, left = 1, live.count()
    last = False
    # After a round, open chains are at least as long as the pointers reach, and their last ``reach``
    # nodes are done. So one round more than the open nodes ask for ends every chain.
    while left and not last:
        last = reach >= left
        known = live.selectExpr("node AS at", "at AS to", "low AS to_low", "false AS ended")
        if done is not None:
            known = known.unionByName(done.selectExpr("node AS at", "end AS to", "cast(NULL AS string) AS to_low", "true AS ended"))
        met = written(split_join(live, known, "at", ["node"], how="left"), "met")
        ended = met.filter("to IS NULL OR ended").selectExpr("node", "coalesce(to, at) AS end")
        done = ended if done is None else done.unionByName(ended)
        live = met.filter("NOT ended").selectExpr("node", "to AS at", "least(low, to_low) AS low")
        reach, left = 2 * reach, live.count()
    if left:  # cycles, and what leads into them: the pointer's target has been all around its cycle
        around = live.selectExpr("node AS at", "low AS end")
        done = done.unionByName(split_join(live.select("node", "at"), around, "at", ["node"], how="inner").select("node", "end"))
    return done if done is not None else live.selectExpr("node", "at AS end")


def canonical_urls(pages: DataFrame) -> DataFrame:
    """(page_id, url, canonical) of every page with a good URL.

    Of several pages with one clean URL the first by page_id that names another
    decides for all. ``canonical`` is the end of the chain, and the URL itself
    where it names none.
    """
    found = written(declared(pages), "declared")
    links = found.filter("target <> url").groupBy(F.col("url").alias("node")).agg(
        F.expr("min_by(target, struct(page_id, target)) AS next")
    )
    ends = chain_ends(links).selectExpr("node AS url", "end")
    return split_join(found.select("page_id", "url"), ends, "url", ["page_id"], how="left").selectExpr(
        "page_id", "url", "coalesce(end, url) AS canonical"
    )
