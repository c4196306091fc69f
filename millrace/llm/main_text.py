"""Main text of web pages from parser events, tag ratios and threshold clustering.

The standard library's parser streams a page's events. Block borders cut them into lines; each line knows its
text, its tags, the share of its text inside links and the element that holds it. A line's ratio is its characters
a tag. The ratios, in page order, are smoothed by a Gaussian and weighted: the linked share of a line counts nothing,
article and main elements raise a line (BONUS), and boxes that look like menus, page headers, footers, sidebars, forms,
scripts, notices, adverts or reader comments (by tag, role, class or id, or hidden), and lists of links alone outside an
article, lower it (MALUS). The weighted ratios are split in two clusters by the threshold that lies midway between the cluster
means; lines of the upper cluster are content. The content region is the outermost article or main element around
all content lines, or else the innermost container of them all. Its lines are returned in page order, so short paragraphs,
lists and headings between the content lines are kept whole, less the lowered lines that did not reach the threshold; so
is a title that stands before the region, and so are paragraphs right beside a region that is no article or main
element, unless they are mostly links.

A box inside a paragraph (a hidden or advert span, script fallback, drawing, label) is a line of its own and does not cut
the paragraph. An article's own header belongs to it, its footer and asides do not. Inside an article, and on paragraphs,
headings and list items anywhere, a class lowers only if all its words do (`related-work` says nothing, `related-posts`
does); ids of headings, paragraphs and sections there (often made from titles) say nothing, unless they name a section of
reader comments. A page of lowered lines alone has no text. If no line is marked, all lines that are not lowered are
returned. Unfinished markup at the end of a page is dropped. White space inside a block becomes one space; blocks are joined
by one. Null or empty pages give "". Repeated pages give the same text; a column named as the text is replaced, others are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import add_from_text

#: Width of the Gaussian in lines (lines are whole blocks already, so it is narrow), and items of a menu.
SIGMA, MENU_ITEMS = 0.5, 3
#: Weights of lines inside an article or main element, and of lines in boxes that look like none of an article.
BONUS, MALUS = 1.5, 1e-3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html iframe legend li main menu nav ol option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
#: Blocks that do not end an open paragraph.
INSIDE_P = frozenset("br button iframe legend option select template textarea title".split())
CONTAINERS = frozenset("article body center div main section table td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag closes these, if open inside the nearest of the scope.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "a": (("a",), tuple(CONTAINERS)),
}
SCOPE = CONTAINERS | frozenset("aside blockquote button dialog footer form header li nav th".split())
DROPPED_TAGS = frozenset(
    "aside audio button canvas dialog footer form head iframe input label legend menu nav noscript object option script select style svg template textarea title video".split()
)
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class or id names that mark what is not the article.
DROPPED_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising alert alerts banner banners breadcrumb breadcrumbs comment commentbox commenter commentform commentlist "
    "comments consent cookie cookies discussion disqus feedback footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification "
    "notifications overlay pager pagination popup popups promo promos promoted promotion recommendations recommended related replies reply respond responses share sharing sidebar "
    "sidebars sidenav signup skip social sponsor sponsored sponsors subscribe subscription teaser toast toolbar topbar widget widgets".split()
)
#: Ends of such names that are written as one word, and what marks a page header, which an article's own is not.
DROPPED_ENDS = ("banner", "footer", "menu", "navbar", "navigation", "sidebar")
HEADER_ENDS = ("header", "masthead", "topbar")
ARTICLE_WORDS = frozenset("article content entry post story".split())
#: Words that drop an article element too.
ARTICLES_DROPPED = frozenset("ad ads comment comments promo promoted related reply replies sponsored teaser widget".split())
#: Words that only say what kind of box it is, beside a word that marks it.
BOX_WORDS = frozenset(
    "area articles bar block body bottom box button buttons center column container content feed field form frame group icon icons inline inner item items label left link links list main message "
    "panel post posts right row section site slot space stories text title top unit wrap wrapper zone page header".split()
)
#: Tags of running text, whose classes are often compounds of other meaning.
PROSE = HEADINGS | frozenset("blockquote dd dt li p pre".split())
#: Tags whose ids inside an article are anchors, and the words of ids that mark a section as comments all the same.
ANCHORED = HEADINGS | frozenset("p section".split())
COMMENT_IDS = frozenset("commentform commentlist comments disqus replies respond".split())
KEPT_TAGS = frozenset("html body main".split())
#: Unclosed boxes of these tags end where an article or main element starts.
ENDS_AT_ARTICLE = frozenset("div header nav p section span ul".split())

_NAME = re.compile(r"[a-z]+")
_HIDING = re.compile(r"(?:has|with|no|without|is)[-_][a-z]+")
#: What is left of a page after parsing is unfinished markup if it looks so.
_UNFINISHED = re.compile(r"<[A-Za-z/!?]")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Element:
    """An open element, and what it inherits: the container, what lowers it, whether it is in an article, a link, a list item, a heading, a paragraph."""

    __slots__ = ("article", "dropped", "heading", "item", "link", "node", "prose", "tag")

    def __init__(self, tag: str, dropped: str, node: int, article: bool, link: bool, item: int, heading: int, prose: bool):
        self.tag, self.dropped, self.node, self.article, self.link, self.item, self.heading, self.prose = tag, dropped, node, article, link, item, heading, prose


class Line:
    __slots__ = ("article", "dropped", "heading", "item", "linked", "node", "prose", "tags", "text")

    def __init__(self, text: str, tags: int, linked: int, at: _Element):
        self.text, self.tags, self.linked, self.node, self.dropped, self.article = text, tags, linked, at.node, bool(at.dropped), at.article
        self.item, self.heading, self.prose = at.item, at.heading, at.prose and linked * 2 < len(text)


def marks(word: str) -> bool:
    return word in DROPPED_WORDS or word.endswith(DROPPED_ENDS)


def why_dropped(tag: str, attributes: list[tuple[str, str | None]], in_article: bool) -> str:
    """What marks an element as no part of an article, or an empty string."""
    if tag in KEPT_TAGS:
        return ""
    if tag in DROPPED_TAGS or tag == "header" and not in_article:
        return tag
    for name, value in attributes:
        value = (value or "").lower()
        if name in ("class", "id"):
            words = _NAME.findall(_HIDING.sub(" ", value))
            if name == "id" and in_article and tag in ANCHORED and not (tag == "section" and COMMENT_IDS.issuperset(words)):
                continue
            if in_article or tag in PROSE:
                words = [w for c in _HIDING.sub(" ", value).split() if all(x in BOX_WORDS or marks(x) for x in _NAME.findall(c)) for w in _NAME.findall(c)]
            found = {w for w in words if marks(w)}
            if not in_article and not ARTICLE_WORDS.intersection(words):
                found |= {w for w in words if w.endswith(HEADER_ENDS)}
            if found and not (tag == "article" and not found & ARTICLES_DROPPED):
                return min(found)
        elif name == "role" and value in DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _UNSEEN.search(value):
            return name
    return ""


class Lines(HTMLParser):
    """The lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_Element("", "", 0, False, False, 0, 0, False)]
        self.open: Counter[str] = Counter()
        self.parents, self.kinds = [0], [""]  # of nodes: container elements
        self.lines: list[Line] = []
        self.tags = self.items = 0
        self.renew()

    def parse_marked_section(self, i, report=1):  # <![...: ignored up to its end, whatever it names
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def unknown_decl(self, data):
        pass

    def renew(self) -> None:
        """No text yet, of the line and of the lowered boxes inside it: parts, linked characters, the element of the first."""
        self.kept, self.side = [[], 0, None], [[], 0, None]

    def flush(self) -> None:
        for parts, linked, at in (self.kept, self.side):
            if at is not None:
                self.lines.append(Line(" ".join("".join(parts).split()), self.tags, linked, at))
                self.tags = 0
        if self.kept[0] or self.side[0]:
            self.renew()

    def pop(self, to: int) -> None:
        for element in self.stack[to:]:
            self.open[element.tag] -= 1
        del self.stack[to:]

    def close_open(self, tags, scope) -> None:
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self.pop(i)
                return
            if self.stack[i].tag in scope:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if tag not in INSIDE_P:
                self.close_open(("p",), SCOPE)
        self.tags += 1
        if tag in CLOSES:
            self.close_open(*CLOSES[tag])
        if tag in ("article", "main"):
            self.end_open_boxes()
        if tag in VOID:
            return
        if tag in ("ul", "ol"):
            self.items += 1
        top = self.stack[-1]
        article = top.article or tag in ("article", "main")
        dropped = top.dropped or why_dropped(tag, attrs, top.article)
        node = top.node
        if tag in CONTAINERS:
            node = len(self.parents)
            self.parents.append(top.node)
            self.kinds.append(tag)
        item = self.items if tag == "li" else top.item
        heading = int(tag[1]) if tag in HEADINGS else top.heading
        self.stack.append(_Element(tag, dropped, node, article, top.link or tag == "a", item, heading, top.prose or tag == "p"))
        self.open[tag] += 1

    def end_open_boxes(self) -> None:
        """An article inside a menu, header or advert means that this one was never closed."""
        if self.stack[-1].dropped and not self.stack[-1].article:
            first = next(i for i, e in enumerate(self.stack) if e.dropped)
            if self.stack[first].tag in ENDS_AT_ARTICLE and not self.stack[first].dropped.startswith(("comment", "repl", "related", "recommend", "sidebar")):
                self.pop(first)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("script", "style", "iframe", "textarea", "title"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if not self.open[tag]:
            return
        stop = () if tag in BLOCKS else SCOPE
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self.pop(i)
                return
            if self.stack[i].tag in stop or tag == "p" and self.stack[i].tag in SCOPE:
                return

    def close(self):
        if _UNFINISHED.match(self.rawdata):
            self.rawdata = ""
        super().close()

    def handle_data(self, data):
        top = self.stack[-1]
        held = self.side if top.dropped else self.kept
        held[0].append(data)
        if text := data.strip():
            held[1] += len(text) if top.link else 0
            held[2] = held[2] or top


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian of width sigma, its weights renormalised at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    wide = lambda x: np.convolve(np.concatenate((np.zeros(reach), x, np.zeros(reach))), kernel, "valid")
    return wide(ratios) / wide(np.ones(len(ratios)))


def threshold(values: np.ndarray) -> float:
    """The value midway between the means of the two clusters it makes."""
    at = float(values.mean())
    for _ in range(50):
        low, high = values[values < at], values[values >= at]
        if not len(low) or not len(high):
            break
        new = float(low.mean() + high.mean()) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return at


def menu_lists(lines: list[Line]) -> set[int]:
    """Lists outside an article whose items are links alone."""
    counts: dict[int, list[int]] = {}
    for x in lines:
        if x.item and not x.article:
            c = counts.setdefault(x.item, [0, 0])
            c[0] += 1
            c[1] += x.linked >= 0.9 * len(x.text)
    return {k for k, (n, links) in counts.items() if n == links and n >= MENU_ITEMS}


def region(page: Lines, weights: dict[int, int]) -> int:
    """The outermost article or main element that holds all marked text, or else the innermost node that does (a table's parent for the table)."""
    held, total = dict(weights), sum(weights.values())
    for node in range(len(page.parents) - 1, 0, -1):
        if node in held:
            held[page.parents[node]] = held.get(page.parents[node], 0) + held[node]
    path = [node for node in sorted(held) if held[node] == total]  # parents come before their children
    for node in path:
        if page.kinds[node] in ("article", "main"):
            return node
    return next(node for node in reversed(path) if page.kinds[node] != "table")


def weight(x: Line, free: bool) -> float:
    """What a line's smoothed ratio counts."""
    return (1 - min(1.0, x.linked / len(x.text))) * (BONUS if x.article else 1.0) * (1.0 if free else MALUS)


def content(scores: np.ndarray) -> np.ndarray:
    """The lines of the upper cluster."""
    return scores >= threshold(scores)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    lines = page.lines
    menus = menu_lists(lines)
    free = np.array([not x.dropped and x.item not in menus for x in lines], bool)
    if not free.any():
        return ""
    scores = smoothed(np.array([len(x.text) / max(1, x.tags) for x in lines])) * [weight(x, f) for x, f in zip(lines, free, strict=True)]
    marked = content(scores)
    weights: dict[int, int] = {}
    for x, m in zip(lines, marked.tolist(), strict=True):
        if m:
            weights[x.node] = weights.get(x.node, 0) + len(x.text)
    if not weights:
        return " ".join(x.text for x, f in zip(lines, free, strict=True) if f)
    top = region(page, weights)
    inside = [top == 0]
    for node in range(1, len(page.parents)):
        inside.append(node == top or inside[page.parents[node]])
    beside = page.parents[top] if page.kinds[top] not in ("", "article", "main") else -1
    above = {0}
    while top:
        above.add(top)
        top = page.parents[top]

    def kept(x: Line) -> bool:
        return inside[x.node] or x.heading and x.node in above or x.heading == 1 and page.parents[x.node] in above or (x.prose or x.heading) and beside in (x.node, page.parents[x.node])

    return " ".join(x.text for x, f in zip(lines, free | marked, strict=True) if f and kept(x))


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """`df` with the main text of each page; a column named as `text` is replaced."""

    def start():
        return lambda column: [pa.array([main_text(x) for x in column.to_pylist()], pa.string())]

    return add_from_text(df, html, [T.StructField(text, T.StringType())], start)
