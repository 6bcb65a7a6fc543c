"""Anchor extraction against hand-made markup and Python's own HTML tokeniser."""

from __future__ import annotations

import random
from html.parser import HTMLParser

from crawlframe.operators.links import anchors, outlink_counts

PAGE = "page_id bigint, url string, html string"


def extract(spark, docs: list[str]) -> list[list[tuple]]:
    rows = [(i, "http://x.y/", d) for i, d in enumerate(docs)]
    out: list[list[tuple]] = [[] for _ in docs]
    for r in anchors(spark.createDataFrame(rows, PAGE)).orderBy("page_id", "pos").collect():
        assert r.pos == len(out[r.page_id])
        out[r.page_id].append((r.href, r.rel))
    return out


def test_markup(spark):
    cases = {
        "<A HREF='x'>t</a>": [("x", None)],
        "<a href=y/z>": [("y/z", None)],
        '<a title=">" href="q">': [("q", None)],
        "<!-- <a href=no> --><a href=1>": [("1", None)],
        "<!--><a href=1>-->": [("1", None)],
        '<script>"<a href=no>"</script><a href=1>': [("1", None)],
        "<style><a href=no></style><textarea><a href=no></textarea>": [],
        "<script>x": [],
        "<a name=x><area href=no><abbr href=no><article href=no>": [],
        '<a rel="nofollow" href\n=\t"n">': [("n", "nofollow")],
        '<a href="n" rel=next rel=prev>': [("n", "next")],
        "<a href><a href=>": [("", None), ("", None)],
        '<a href="">': [("", None)],
        "<a data-href=no><a hrefx=no><a xhref=no>": [],
        "<a href=one href=two>": [("one", None)],
        '<a title=foo"bar href=z>': [("z", None)],
        '<a href="x"rel="r">': [("x", "r")],
        '<a/href="x"/>': [("x", None)],
        '<a href="unclosed><b>': [],
        "a < b <a href=1> > c": [("1", None)],
        '<a href="a&amp;b&#47;&#x2F;c&quot;&lt;&gt;&#39;">': [("a&b//c\"<>'", None)],
        '<a href="?a=1&copy=2&copy;&copyx&eacute;&hellip;&amp;lt;">': [
            ("?a=1&copy=2©&copyxé…&lt;", None)
        ],
        '<a href="&#x80;&#0;&#xD800;&#1114112;&#99999999999;&nosuch;&">': [
            ("€����&nosuch;&", None)
        ],
        "": [],
    }
    assert extract(spark, list(cases)) == list(cases.values())


class Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.found: list[tuple] = []

    def handle_starttag(self, tag, attrs):
        first = {}
        for name, value in attrs:
            first.setdefault(name, value)
        if tag == "a" and "href" in first:
            self.found.append((first["href"] or "", first.get("rel")))


def test_random_documents_match_a_tokeniser(spark):
    rng = random.Random(7)
    pieces = [
        '<a href="/p{0}">', "<a href='/q{0}'>", "<a href=/r{0}>", "<A HREF=\"/s{0}\" REL='x y'>",
        "<a name=n{0}>", '<a title="a > b" href="/t{0}">', "</a>", "<p>", "text {0} ", "é–ß ",
        "<!-- c <a href=/no> -->", "<script>if (a<b) '<a href=/no>'</script>",
        "<style>a > b</style>", "<br/>", '<img src="i.png" alt=\'"\'>', "<li class=x>", "\n",
        '<a href="/u?x=1&amp;y={0}">', "<a\nhref = '/v{0}'\n>", "<abbr title='<a href=/no>'>",
    ]
    docs = [
        "".join(rng.choice(pieces).format(rng.randrange(99)) for _ in range(rng.randrange(60)))
        for _ in range(300)
    ]
    expected = []
    for doc in docs:
        parser = Anchors()
        parser.feed(doc)
        parser.close()
        expected.append(parser.found)
    assert extract(spark, docs) == expected


def test_long_documents_neither_overflow_nor_hang(spark):
    docs = [
        "<a " + "x " * 200_000 + "href=1>",
        '<a title="' + "y" * 1_000_000 + '" href=2>',
        "<!--" + "-" * 500_000 + "--><a href=3>",
        "<a href=4>" + "<b " * 200_000,
        "<a href=4>" + "<b x='" * 200_000,
        "<p>" * 50_000 + "<a href=5>",
    ]
    assert [d[0][0] if d else None for d in extract(spark, docs)] == ["1", "2", "3", "4", "4", "5"]


def test_pages_without_links_count_zero(spark):
    pages = spark.createDataFrame(
        [(1, "http://x.y/", "<p>"), (2, "http://x.y/", '<a href="/"><a href="/z">')], PAGE
    )
    got = {r.page_id: r.n_links for r in outlink_counts(pages).collect()}
    assert got == {1: 0, 2: 1}
