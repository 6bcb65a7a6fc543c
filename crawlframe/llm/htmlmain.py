"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every element that may hold a part of the page is a node with features of its
subtree (text, links, tags), its depth, siblings, tag and attribute tokens.
Boosted trees give the odds that a node belongs to the article; a decoding over
the tree then picks the best labels that fit together: what is cut out of the
article stays out with all that is below it.

The trees are trained here, on a bounded sample of the table's own pages and on
pages put together from their paragraphs in other layouts, so that labels are
known by construction.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = re.compile(r"[ \t\n\r\f\v]+")
TOKEN = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Fixed values of the HTML standard: elements without an end tag, and those whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MUTE = frozenset("script style noscript template svg math head title select option button textarea iframe object canvas".split())
# Fixed values of the HTML standard: what a head holds, and how comments end.
HEAD_PARTS = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
COMMENT_END = re.compile(r"--!?>")
SHORT_COMMENT = re.compile(r"<!--(?:-?>)")
# Formatting elements stand for no part of the page unless they carry a class or an id.
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr li main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
FENCES = frozenset("ul ol dl table article section div main aside nav footer header form body html".split())

TAGS = ("article", "main", "section", "div", "p", "li", "ul", "nav", "header", "footer", "aside", "form", "table", "blockquote", "figure", "span")
GOOD = frozenset("article articlebody content post entry story main body text page".split())
BAD = frozenset(
    "ad ads advert advertisement adslot banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead"
    " footer foot copyright sidebar side aside related recommended widget comment comments reply replies disqus discussion cookie cookies"
    " consent gdpr notice notices alert popup modal share social follow newsletter subscribe signup login form search pagination pager toc skip"
    " toolbar topbar legal disclaimer".split()
)
BUCKETS = 32  # of hashed attribute tokens
FEATURES = 20 + 2 * len(TAGS) + BUCKETS


class Page(HTMLParser):
    """The nodes of a page in page order, and its text as (node, text, block number)."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.tokens = ["#page"], [-1], [[]]
        self.segments: list[tuple[int, str, int, bool]] = []  # the last: inside a link
        self.open: list[tuple[str, int]] = [("#page", 0)]  # tag and its node (that of the parent if it has none)
        self.block, self.mute, self.links = 0, 0, 0
        self.feed(html)
        self.close()

    # Declarations, comments and instructions end where browsers end them; one without an end takes the
    # rest of the page. None of them is text, and none can stop the parser.
    def parse_comment(self, i: int, report: int = 1) -> int:
        end = SHORT_COMMENT.match(self.rawdata, i) or COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        return self.rawdata.find(">", i + 2) + 1 or len(self.rawdata)

    def parse_pi(self, i: int) -> int:
        return self.rawdata.find(">", i + 2) + 1 or len(self.rawdata)

    def _leave_head(self) -> None:
        """A head without an end tag is over where something stands that no head holds."""
        if self.open[-1][0] == "head":
            self._pop_to("head")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD_PARTS:
            self._leave_head()
        if tag in CLOSES_P:
            self._close_p()
        if tag in SIBLINGS:
            self._close_sibling(SIBLINGS[tag])
        inline = tag in INLINE
        if not inline:
            self.block += 1
        if tag in VOID:
            return
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
        if inline and not names or tag in MUTE:
            node = self.open[-1][1]
        else:
            node = len(self.tags)
            self.tags.append(tag)
            self.parents.append(self.open[-1][1])
            self.tokens.append(TOKEN.findall(CAMEL.sub(" ", names).lower()))
        self.open.append((tag, node))
        self.mute += tag in MUTE
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if any(name == tag for name, _ in self.open[1:]):
            self._pop_to(tag)
        if tag not in INLINE:
            self.block += 1

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._leave_head()
        if not self.mute and data:
            self.segments.append((self.open[-1][1], data, self.block, self.links > 0))

    def _pop_to(self, tag: str) -> None:
        while True:
            name, _ = self.open.pop()
            self.mute -= name in MUTE
            self.links -= name == "a"
            if name == tag:
                return

    def _close_p(self) -> None:
        for name, _ in reversed(self.open):
            if name == "p":
                self._pop_to("p")
                return
            if name not in INLINE:
                return

    def _close_sibling(self, names: tuple[str, ...]) -> None:
        for name, _ in reversed(self.open):
            if name in names:
                self._pop_to(name)
                return
            if name in FENCES:
                return


def features(page: Page) -> np.ndarray:
    """One row per node."""
    n = len(page.tags)
    own = np.zeros((n, 5))  # characters, words, in links, punctuation, segments
    for node, text, _, linked in page.segments:
        words = text.split()
        chars = sum(map(len, words))
        own[node] += (chars, len(words), chars * linked, sum(text.count(c) for c in ".,;:!?"), chars > 0)
    total = own.copy()
    tags = np.ones(n)
    parents = page.parents
    children = np.zeros(n)
    place = np.zeros(n)
    depth = np.zeros(n)
    paragraphs = np.array([t == "p" for t in page.tags], float)
    for k in range(1, n):
        depth[k] = depth[parents[k]] + 1
        place[k] = children[parents[k]]
        children[parents[k]] += 1
    for k in range(n - 1, 0, -1):
        total[parents[k]] += total[k]
        tags[parents[k]] += tags[k]
        paragraphs[parents[k]] += paragraphs[k]
    out = np.zeros((n, FEATURES))
    whole = max(total[0, 0], 1)
    good = np.array([sum(t in GOOD for t in tokens) for tokens in page.tokens], float)
    bad = np.array([sum(t in BAD for t in tokens) for tokens in page.tokens], float)
    good_above, bad_above = np.zeros(n), np.zeros(n)
    up = np.zeros((n, len(TAGS)))
    here = np.array([[tag == t for t in TAGS] for tag in page.tags], float)
    for k in range(1, n):
        p = parents[k]
        good_above[k], bad_above[k] = good_above[p] + good[p], bad_above[p] + bad[p]
        up[k] = np.maximum(up[p], here[p])
        for token in page.tokens[k]:
            out[k, 20 + 2 * len(TAGS) + zlib.crc32(token.encode()) % BUCKETS] = 1
    siblings = np.array([children[p] if p >= 0 else 1 for p in parents])
    base = (
        depth, place, siblings, place / np.maximum(siblings, 1), children, np.log1p(total[:, 0]), np.log1p(own[:, 0]),
        total[:, 1] / np.maximum(tags, 1), total[:, 2] / np.maximum(total[:, 0], 1), total[:, 3] / np.maximum(total[:, 1], 1),
        tags / np.maximum(total[:, 0], 1), total[:, 0] / whole, paragraphs, np.log1p(total[:, 1]), good, bad, good_above, bad_above,
        np.array([t[:1] == "h" and t[1:].isdigit() for t in page.tags], float), np.arange(n) / n,
    )
    out[:, :20] = np.stack(base, axis=1)
    out[:, 20 : 20 + len(TAGS)] = here
    out[:, 20 + len(TAGS) : 20 + 2 * len(TAGS)] = up
    return out


@dataclass
class Boosted:
    """Boosted regression trees of one depth for the log odds, kept as arrays."""

    base: float
    split: list[np.ndarray]  # feature of each inner node, heap order
    cut: list[np.ndarray]
    leaf: list[np.ndarray]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        line = np.arange(len(x))
        for split, cut, leaf in zip(self.split, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range((len(split) + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[line, split[at]] > cut[at])
            out += leaf[at - len(split)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32) -> Boosted:
    """Fit by second-order boosting over binned features."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), [], [], [])
    raw = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        split, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = 1e-6
            if len(mine) >= 8:
                g, h = grad[mine], hess[mine]
                whole = g.sum() ** 2 / (h.sum() + 1)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[mine, f]
                    gl = np.bincount(b, g, len(e) + 1).cumsum()[:-1]
                    hl = np.bincount(b, h, len(e) + 1).cumsum()[:-1]
                    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, split[node], cut[node] = gain[k], f, e[k]
            at[mine] = 2 * node + 1 + (x[mine, split[node]] > cut[node])
        leaf = np.zeros(inner + 1)
        for k in range(inner + 1):
            mine = at == inner + k
            leaf[k] = rate * grad[mine].sum() / (hess[mine].sum() + 1)
        raw += leaf[at - inner]
        model.split.append(split)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model


def decode(parents: list[int], odds: np.ndarray) -> np.ndarray:
    """Which nodes are main text: the best labels without a main node below one that was cut out.

    States are outside, main and cut. Outside may turn into main, main into
    cut, and cut stays. Found from the leaves up.
    """
    n = len(parents)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best = np.stack([no, yes, no], axis=1)
    for k in range(n - 1, 0, -1):
        outside, main, cut = best[k]
        best[parents[k]] += (max(outside, main), max(main, cut), cut)
    state = np.zeros(n, np.int64)
    state[0] = int(best[0, 1] > best[0, 0])
    for k in range(1, n):
        above = state[parents[k]]
        outside, main, cut = best[k]
        state[k] = 2 if above == 2 else (1 + int(cut > main)) if above == 1 else int(main > outside)
    return state == 1


def text_of(page: Page, main: np.ndarray) -> str:
    """Blocks of the chosen nodes in page order, white space within a block as one space."""
    blocks: list[list[str]] = []
    last = None
    for node, text, block, _ in page.segments:
        if main[node]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    return " ".join(line for parts in blocks if (line := SPACE.sub(" ", "".join(parts)).strip(" ")))


def weak_labels(page: Page) -> np.ndarray | None:
    """Labels of a page that marks its article itself; None for other pages."""
    n = len(page.tags)
    inside, out = np.zeros(n, bool), np.zeros(n, bool)
    for k in range(1, n):
        p = page.parents[k]
        marks = page.tags[k] in ("article", "main") or "articlebody" in "".join(page.tokens[k])
        cut = page.tags[k] in ("nav", "header", "footer", "aside", "form") or any(t in BAD for t in page.tokens[k])
        inside[k] = inside[p] or marks
        out[k] = out[p] or cut
    main = inside & ~out
    return main if main.any() else None


def made_up(texts: list[str], rng: random.Random) -> str:
    """A page in one of many layouts around given paragraphs.

    ``@MAIN@`` and ``@CUT@`` stand before and after what is main and what is cut out of it.
    """
    take = lambda low, high: [rng.choice(texts) for _ in range(rng.randint(low, high))]
    para = lambda text: f"<p>{text}</p>"

    def links(count: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{" ".join(t.split()[:2])}</a></li>' for t in take(count, count + 4)) + "</ul>"

    def junk(names: tuple[str, ...], tags: tuple[str, ...], inner: str) -> str:
        tag, name = rng.choice(tags), rng.choice(names)
        mark = rng.choice((f' class="{name}"', f' id="{name}"', f' class="box {name}-1"', ""))
        if tag in ("div", "section", "p") and not mark:
            mark = f' class="{name}"'
        return f"<{tag}{mark}>{inner}</{tag}>"

    short = lambda: " ".join(rng.choice(texts).split()[: rng.randint(3, 14)])
    menu = junk(("nav", "menu", "navbar"), ("nav", "div"), links(4))
    header = junk(("header", "masthead", "topbar"), ("header", "div"), f'<a href="/">{short()}</a>' + rng.choice(("", menu)))
    footer = junk(("footer", "copyright"), ("footer", "div"), rng.choice((para(short()), "&copy; " + short(), links(2))))
    side = junk(("sidebar", "related", "widget"), ("aside", "div"), rng.choice((links(3), "".join(map(para, take(1, 2))))))
    advert = lambda: junk(("ad", "ads", "advert", "promo", "sponsored"), ("div", "aside"), rng.choice((short(), para(rng.choice(texts)))))
    notice = junk(("cookie-notice", "consent", "banner", "notice", "alert"), ("div", "section"), para(short()))
    form = rng.choice((f"<form><label>{short()}</label><input></form>", junk(("newsletter", "subscribe"), ("div",), f"<form>{short()}</form>")))
    comments = junk(
        ("comments", "comment-list", "replies", "discussion"), ("section", "div"),
        "".join(rng.choice(('<div class="comment"><p>{}</p></div>', "<p>{}</p>", "<li>{}</li>")).format(t) for t in take(1, 6)),
    )
    body = [f"<h1>{short()}</h1>"] + [
        rng.choice((para, para, para, para, lambda t: f"<h2>{' '.join(t.split()[:5])}</h2>{para(t)}", lambda t: f"<ul><li>{t}</li><li>{short()}</li></ul>",
                    lambda t: f"<blockquote>{para(t)}</blockquote>", lambda t: f'<p><b>{t}<br><a href="/y">{short()}</a>'))(t)
        for t in take(1, 12)
    ]
    cut = "@CUT@"
    for extra in (advert(), form, side, comments, junk(("share", "social"), ("div",), links(2))):
        if rng.random() < 0.15:
            body.insert(rng.randint(1, len(body)), cut + extra + cut)
    tag, mark = rng.choice(
        (("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="article-body"'),
         ("div", ' class="entry-content"'), ("section", ' class="story"'), ("div", ' class="post-text"'))
    )
    main = f"@MAIN@<{tag}{mark}>" + "".join(body) + f"</{tag}>@MAIN@"
    before = [x for x in (header, menu, notice, advert(), form, side) if rng.random() < 0.5]
    after = [x for x in (comments, side, advert(), footer, form, notice) if rng.random() < 0.5]
    rng.shuffle(before)
    inner = "".join(before) + main + "".join(after)
    if rng.random() < 0.4:
        inner = f'<div class="{rng.choice(("wrapper", "container", "page", "site"))}">{inner}</div>'
    return f"<!DOCTYPE html><html><head><title>{short()}</title></head><body>{inner}</body></html>"


def made_up_rows(texts: list[str], pages: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of pages in other layouts."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        html = made_up(texts, rng)
        labels = marked_labels(html)
        page = Page(html.replace("@MAIN@", "").replace("@CUT@", ""))
        if len(labels) == len(page.tags):
            xs.append(features(page))
            ys.append(labels)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (np.zeros((0, FEATURES)), np.zeros(0))


class _Marked(Page):
    """Reads the marks while parsing: a node that opens between them is main or cut."""

    def __init__(self, html: str) -> None:
        self.main, self.cut, self.labels = False, False, [0.0]
        super().__init__(html)

    def handle_data(self, data: str) -> None:
        if data.count("@MAIN@") % 2:
            self.main = not self.main
        if data.count("@CUT@") % 2:
            self.cut = not self.cut
        data = data.replace("@MAIN@", "").replace("@CUT@", "")
        super().handle_data(data)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        super().handle_starttag(tag, attrs)
        if len(self.labels) < len(self.tags):
            self.labels.append(float(self.main and not self.cut))


def marked_labels(html: str) -> np.ndarray:
    return np.array(_Marked(html).labels)


@dataclass(frozen=True)
class Training:
    """``pages`` of the table at most are used, by hash order, and as many ``layouts`` made from their text."""

    pages: int = 200
    layouts: int = 600
    seed: int = 11


def train(pages: DataFrame, html: str = "html", settings: Training = Training()) -> Boosted:
    """Fit the trees on a bounded sample; the same table gives the same trees."""
    # First the hashes alone, then the pages they name: what reaches the driver does not grow with the
    # table, however many rows and partitions there are and however often a page repeats.
    hashed = pages.filter(F.col(html).isNotNull()).select(F.col(html).alias("h"), F.xxhash64(html).alias("o"))
    chosen = [r.o for r in hashed.select("o").distinct().orderBy("o").limit(settings.pages).collect()]
    rows = hashed.filter(F.col("o").isin(chosen)).groupBy("o").agg(F.min("h").alias("h")).orderBy("o").collect()
    xs, ys, texts = [], [], []
    for row in rows:
        page = Page(row["h"])
        labels = weak_labels(page)
        texts += [t for k, text, _, _ in page.segments if len(t := SPACE.sub(" ", text).strip()) >= 20 and page.tags[k] == "p"][:20]
        if labels is not None:
            xs.append(features(page))
            ys.append(labels.astype(float))
    texts = [t.replace("&", "&amp;").replace("<", "&lt;") for t in texts] or ["Plain words stand here. They are many, and they end."]
    more_x, more_y = made_up_rows(texts, settings.layouts, settings.seed)
    return boost(np.concatenate([*xs, more_x]), np.concatenate([*ys, more_y]))


def extract(html: list[str | None], model: Boosted) -> list[str]:
    """Main texts of some pages, scored together."""
    pages = [Page(one) if one else None for one in html]
    rows = [features(page) for page in pages if page]
    odds = model.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page in pages:
        if page is None:
            out.append("")
            continue
        size = len(page.tags)
        chosen = decode(page.parents, odds[at : at + size])
        out.append(text_of(page, chosen) or text_of(page, outside_of_parts(page)))
        at += size
    return out


def outside_of_parts(page: Page) -> np.ndarray:
    """For a page of which the trees choose nothing: all nodes but the parts that say they are no text."""
    keep = np.ones(len(page.tags), bool)
    for k in range(1, len(page.tags)):
        aside = page.tags[k] in ("nav", "header", "footer", "aside", "form") or any(t in BAD for t in page.tokens[k])
        keep[k] = keep[page.parents[k]] and not aside
    return keep


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", model: Boosted | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row; null or empty html gives an empty text.

    Any text is a page: broken declarations, comments and heads without an end
    cost no more than themselves. A page of which the trees choose nothing gives
    its text outside of menus, headers, footers, sidebars and forms. Pages are
    taken whole, of any length.

    Repeated rows are extracted one by one; other columns are ignored.
    """
    model = model or train(pages, html)

    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[str] = []
            for at in range(0, len(batch), 200):
                out += extract(batch.slice(at, 200).to_pylist(), model)
            yield pa.array(out, pa.string())

    text = extracted(pages[html]).alias("text")
    return pages.select(pages[key], pages[url], text).withColumn("n_chars", F.char_length("text").cast("bigint"))
