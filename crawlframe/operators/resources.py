"""Links of a page other than anchors: images, scripts, style sheets, feeds, what CSS refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.functions import html
from crawlframe.functions.sql import null_text, text
from crawlframe.functions.urls import URL_LIMIT
from crawlframe.operators.urls import parse_urls

WS = html.WS
# One pass over the tokens of a page. The group holds a tag of interest with its attributes; of a
# script element that is the start tag, of a style element all of it.
TOKEN = (
    r"(?is)<(?:"
    rf"((?:img|source|link|input|video)(?=[{WS}/>]){html.ANY_ATTRIBUTES}>|script(?=[{WS}/>]){html.ANY_ATTRIBUTES}>|style(?=[{WS}/>]){html.ANY_ATTRIBUTES}>.*?(?=</style(?=[{WS}/>])|\z)"
    rf"|[a-z][^{WS}/>]*+(?=[{WS}/])(?=[^>]*?\bstyle\s*=){html.ANY_ATTRIBUTES}>)"
    r"|!--(?:-?>|.*?(?:--!?>|\z))"
    r"|[!?][^>]*+(?:>|\z)"
    r"|/[^a-z>][^>]*+(?:>|\z)"
    rf"|/?[a-z][^{WS}/>]*+{html.ANY_ATTRIBUTES}>"
    r"|/?[a-z].*)"
)
# Comments and the text of text elements go first, in one pass that steps over whole tags; start tags
# of scripts and whole style sheets (groups 1 and 2) and all other tags (group 4) stay.
HIDDEN = "textarea|title|xmp|iframe|noembed|noframes|noscript"
TEXTS = (
    rf"(?is)(<script(?=[{WS}/>]){html.ANY_ATTRIBUTES}>).*?(?:</script(?=[{WS}/>])|\z)"
    rf"|(<style(?=[{WS}/>]){html.ANY_ATTRIBUTES}>.*?(?:</style(?=[{WS}/>])|\z))"
    rf"|<({HIDDEN})(?=[{WS}/>]){html.ANY_ATTRIBUTES}>.*?(?:</\3(?=[{WS}/>])|\z)"
    r"|<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|(</?[a-z][^{WS}/>]*+{html.ANY_ATTRIBUTES}>)"
)

CANDIDATE = r"([^\s,]\S*[^\s,]|[^\s,])(?:\s+(?:[^,(]|\([^)]*\))*)?(?:,|$)"
CSS_COMMENT = r"(?s)/\*.*?(?:\*/|\z)"
# An address without quotes holds no bracket, so a sheet is scanned once.
CSS_ADDRESS = r"""url\(\s*+(?:"[^"]*+"|'[^']*+'|[^()"'\s]*+)\s*+\)"""
CSS_URL = rf"""(?i)@import\s++(?:"[^"]*+"|'[^']*+'|{CSS_ADDRESS})|{CSS_ADDRESS}"""
CSS_VALUE = r"""(?is)^(?:@import\s+)?(?:url\(\s*)?["']?(.*?)["']?\s*\)?$"""

# The media types that mark a feed in a link element.
FEED_TYPES = ("application/rss+xml", "application/atom+xml")


def _item(context: str, href: str, rel: str) -> str:
    return f"named_struct('context', {context}, 'href', {href}, 'rel', {rel})"


def _value(tag: str, name: str) -> str:
    return html.decode_references(html.attribute(tag, name))


def _one(context: str, tag: str, name: str, rel: str) -> str:
    """An attribute as a list of one item, or of none."""
    return f"""transform(filter(array({_value(tag, name)}), v -> trim(v) <> ''), v -> {_item(context, 'v', rel)})"""


def _candidates(tag: str, rel: str) -> str:
    """The addresses of a ``srcset``: each ends at white space or at commas before it."""
    found = f"regexp_extract_all({_value(tag, 'srcset')}, {text(CANDIDATE)}, 1)"
    return f"transform(coalesce({found}, cast(array() AS array<string>)), v -> {_item(text('Img'), 'v', rel)})"


def _css(sheet: str, rel: str) -> str:
    """What style rules refer to: imported sheets, and images and fonts by ``url()``."""
    found = f"regexp_extract_all(regexp_replace({sheet}, {text(CSS_COMMENT)}, ' '), {text(CSS_URL)}, 0)"
    context = "CASE WHEN lower(v) LIKE '@import%' THEN 'Style' ELSE 'Img' END"
    href = f"regexp_extract(v, {text(CSS_VALUE)}, 1)"
    return f"filter(transform(coalesce({found}, cast(array() AS array<string>)), v -> {_item(context, href, rel)}), i -> trim(i.href) <> '')"


def _items(tag: str) -> str:
    """All items of one tag of interest, in the order of its attributes' kinds."""
    none = null_text()
    empty = f"filter(array({_item(none, none, none)}), i -> false)"
    attrs = f"regexp_replace({tag}, '(?is)^[a-z]+', '')"
    rel = f"transform(array({_value('t.a', 'rel')}), r -> lower(r))[0]"
    words = f"split(trim({rel}), '[\\\\s]+')"
    feed = f"array_contains({words}, 'alternate') AND lower(trim({_value('t.a', 'type')})) IN {FEED_TYPES}"
    context = f"""CASE WHEN array_contains({words}, 'stylesheet') THEN 'Style' WHEN {feed} THEN 'Feed'
        WHEN exists({words}, w -> w IN ('icon', 'apple-touch-icon')) THEN 'Img' END"""
    own = f"""CASE
        WHEN t.name = 'img' THEN concat({_one(text('Img'), 't.a', 'src', none)}, {_candidates('t.a', none)})
        WHEN t.name = 'source' THEN {_candidates('t.a', none)}
        WHEN t.name = 'input' THEN CASE WHEN lower({_value('t.a', 'type')}) = 'image' THEN {_one(text('Img'), 't.a', 'src', none)} ELSE {empty} END
        WHEN t.name = 'video' THEN {_one(text('Img'), 't.a', 'poster', none)}
        WHEN t.name = 'script' THEN {_one(text('Script'), 't.a', 'src', none)}
        WHEN t.name = 'link' THEN filter({_one(context, 't.a', 'href', rel)}, i -> i.context IS NOT NULL)
        WHEN t.name = 'style' THEN {_css("regexp_replace(t.a, '(?is)^[^>]*>', '')", none)}
        ELSE {empty} END"""
    style = f"CASE WHEN t.name <> 'style' AND lower(t.a) LIKE '%style%' THEN {_css(_value('t.a', 'style'), none)} ELSE {empty} END"
    struct = f"named_struct('name', lower(regexp_extract({tag}, '^([a-zA-Z][a-zA-Z0-9]*)', 1)), 'a', regexp_replace({attrs}, '>$', ''))"
    return f"transform(array({struct}), t -> concat({own}, {style}))[0]"


def tags_of(document: str) -> str:
    """The tags of interest of a page with their attributes, in document order."""
    bare = f"regexp_replace({document}, {text(TEXTS)}, '$1$2$4')"
    return f"filter(regexp_extract_all({bare}, {text(TOKEN)}, 1), t -> t <> '')"


def resources(pages: DataFrame) -> DataFrame:
    """One row per reference (pos, context, href, rel) in document order; ``html`` ends here.

    Contexts: ``Img`` (img, source and srcset candidates, posters, icons, CSS
    images and fonts), ``Script``, ``Style`` (sheets and imports), ``Feed`` (alternate
    links of a feed's media type).
    """
    rest = [f"`{c}`" for c in pages.columns if c != "html"]
    tags = tags_of("html")
    tagged = pages.selectExpr(*rest, f"posexplode({tags}) AS (_at, _tag)")
    items = tagged.selectExpr(*rest, "_at", f"posexplode({_items('_tag')}) AS (_k, _i)")
    return items.selectExpr(*rest, "_at", "_k", "_i.context AS context", "_i.href AS href", "_i.rel AS rel")


def resource_links(pages: DataFrame) -> DataFrame:
    """References of pages (page_id, url, html) with their joined URL: page_id, pos, item, context, href, rel, u, reason.

    ``pos`` is the place of the tag among those of interest, ``item`` that of the
    reference in it. Reasons: ``not_http`` (``data:`` among others), ``idn_host``,
    ``unparsable``, ``self_link``, ``too_long``.
    """
    based = parse_urls(pages.select("page_id", F.col("url").alias("base_url"), "html"), "base_url", out="base")
    linked = parse_urls(resources(based), "href", out="u", base="base")
    return linked.selectExpr(
        "page_id", "_at AS pos", "_k AS item", "base_url", "context", "href", "rel", "u",
        """CASE WHEN u.error = 'scheme' THEN 'not_http' WHEN u.error = 'idn_host' THEN 'idn_host'
           WHEN u.error IS NOT NULL THEN 'unparsable' WHEN u.url = base.url THEN 'self_link'
           WHEN length(u.url) >= {0} THEN 'too_long' END AS reason""".format(URL_LIMIT),
    )
