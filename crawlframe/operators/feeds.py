"""Syndication feeds: RSS 0.9x to 2.0, RSS 1.0 (RDF) and Atom, as rows of links."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crawlframe.functions.sql import null_text, text
from crawlframe.functions.urls import URL_LIMIT
from crawlframe.operators.urls import parse_urls

RSS_ITEM = "struct<link:string,guid:struct<_VALUE:string,_isPermaLink:string>>"
RSS = f"channel struct<item:array<{RSS_ITEM}>>, item array<{RSS_ITEM}>, _corrupt_record string"
ATOM_ENTRY = "struct<_base:string,link:array<struct<_rel:string,_href:string>>>"
ATOM = f"_base string, entry array<{ATOM_ENTRY}>, _corrupt_record string"
# Atom's names may have a prefix of any kind; RSS has elements of other namespaces beside its own.
NO_PREFIXES = "map('ignoreNamespace', 'true')"

IS_ATOM = r"^[^<]*+(?:<[?!][^>]*+>[^<]*+)*+<(?:[\w.-]++:)?feed[\s>]"

# Complete entries without another one inside; possessive, so a file is scanned once.
ITEM = r"<(item)(?=[\s>])[^>]*+>(?:[^<]++|<(?!/?item[\s>]))*+</item\s*+>"
ENTRY = r"<((?:[\w.-]++:)?entry)(?=[\s>])[^>]*+>(?:[^<]++|<(?!/?(?:[\w.-]++:)?entry[\s>]))*+</\1\s*+>"


def _rss_link(item: str) -> str:
    """An item's link; without one, its guid unless that says it is no address."""
    guid = f"CASE WHEN lower(coalesce({item}.guid._isPermaLink, 'true')) <> 'false' THEN {item}.guid._VALUE END"
    return f"coalesce(nullif(trim({item}.link), ''), trim({guid}))"


def _atom_link(entry: str) -> str:
    """An entry's first alternate link; without one, its first link."""
    alternate = f"filter({entry}.link, l -> coalesce(l._rel, 'alternate') = 'alternate')"
    return f"coalesce(try_element_at({alternate}, 1)._href, try_element_at({entry}.link, 1)._href)"


def _row(href: str, base: str, reason: str) -> str:
    return f"named_struct('href', {href}, 'base', {base}, 'bad', {reason})"


def _entries(body: str) -> str:
    """Entries of a feed as an array of (href, base, bad).

    A feed that is not well-formed gives its complete entries, each parsed on
    its own, and one more with ``bad_xml``.
    """
    none = null_text()
    rss = f"""transform(concat(coalesce(x.channel.item, array()), coalesce(x.item, array())),
        i -> {_row(_rss_link('i'), none, none)})"""
    atom = f"transform(coalesce(a.entry, array()), e -> {_row(_atom_link('e'), 'e._base', none)})"
    bad = f"array({_row(none, none, text('bad_xml'))})"
    pieces_rss = f"""transform(regexp_extract_all(coalesce({body}, ''), {text(ITEM)}, 0), p ->
        transform(array(from_xml(p, {text(RSS_ITEM[7:-1].replace('link:', 'link ').replace(',guid:', ', guid '))})), i -> {_row(_rss_link('i'), none, none)})[0])"""
    pieces_atom = f"""transform(regexp_extract_all(coalesce({body}, ''), {text(ENTRY)}, 0), p ->
        transform(array(from_xml(p, {text('_base string, link array<struct<_rel:string,_href:string>>')}, {NO_PREFIXES})),
            e -> {_row(_atom_link('e'), 'e._base', none)})[0])"""
    return f"""CASE WHEN is_atom THEN CASE WHEN a IS NULL OR a._corrupt_record IS NOT NULL
            THEN concat({pieces_atom}, {bad}) ELSE {atom} END
        ELSE CASE WHEN x IS NULL OR x._corrupt_record IS NOT NULL
            THEN concat({pieces_rss}, {bad}) ELSE {rss} END END"""


def all_entries(feeds: DataFrame, url: str = "url") -> DataFrame:
    """One row per feed entry (pos, href, u) with a ``reason`` to drop it, if any.

    ``feeds``: the column ``url`` names, ``body`` as text, and columns that are kept.
    A relative link is joined with the entry's ``xml:base``, that with the feed's,
    that with the feed's URL. Reasons: ``bad_xml`` (for the feed), ``no_link``,
    ``not_http``, ``unparsable``, ``too_long``.
    """
    rest = [f"`{c}`" for c in feeds.columns if c != "body"]
    parsed = feeds.selectExpr(
        *rest,
        "body",
        f"coalesce(body RLIKE {text(IS_ATOM)}, false) AS is_atom",
        f"CASE WHEN is_atom THEN from_xml(body, {text(ATOM)}, {NO_PREFIXES}) END AS a",
        f"CASE WHEN NOT is_atom THEN from_xml(body, {text(RSS)}) END AS x",
    )
    rows = parsed.selectExpr(*rest, "a._base AS _feed_base", f"posexplode({_entries('body')}) AS (pos, e)").selectExpr(
        *rest, "pos", "_feed_base", "e.base AS _entry_base", "e.href AS href", "e.bad AS _bad"
    )
    based = parse_urls(rows, url, out="base")
    for column in ("_feed_base", "_entry_base"):
        joined = parse_urls(based, column, out="_next", base="base")
        based = joined.selectExpr(
            *[f"`{c}`" for c in joined.columns if c not in ("base", "_next", column)],
            f"CASE WHEN {column} IS NULL THEN base ELSE _next END AS base",
        )
    linked = parse_urls(based, "href", out="u", base="base")
    reason = """CASE WHEN _bad IS NOT NULL THEN _bad WHEN href IS NULL THEN 'no_link'
        WHEN u.error = 'scheme' THEN 'not_http' WHEN u.error IS NOT NULL THEN 'unparsable'
        WHEN length(u.url) >= {0} THEN 'too_long' END AS reason""".format(URL_LIMIT)
    return linked.selectExpr(*rest, "pos", "href", "u", reason)


def feed_links(feeds: DataFrame) -> DataFrame:
    """The links of feeds (``url``, ``body``): url, pos, link."""
    good = all_entries(feeds.select("url", "body")).filter("reason IS NULL")
    return good.selectExpr("url", "pos", "u.url AS link")
