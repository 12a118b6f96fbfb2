"""Main-text extraction from web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines: runs of text
between block tags, each with the tags met since the last line and the
containers it stands in.  The ratios of characters to tags are smoothed with a
Gaussian kernel, and a threshold on them clusters the lines into content and
the rest.  The content lines select the content region: the article or main
elements side by side in one container if they hold nearly all of their
characters, or else the smallest container that does.  Every line of the region is returned, short
ones too, except those inside menus, headers and footers of the page,
sidebars, notices, adverts, forms, scripts, styles and reader comments.  Inside
an article (or a container named as the main one) marks in names never drop
inline elements or code, words that occur in running text (comment, related,
social, alert, ...) only count if the whole name is made of such words, and a
header is the article's own.  A line break is white space of its block.

Defined cases: a null or empty page gives the empty text; markup that ends in
the middle of a tag or a comment loses only that tag; a page without content
lines by ratio is judged by all its lines; a page of any length is parsed
whole, in time that grows with its length at any depth of nesting; repeated rows get equal results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costmart.llm.common import pieces

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end a line.
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir
div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr
html legend li main menu nav noscript ol option p pre section select summary table tbody td
template tfoot th thead title tr ul""".split())
#: Tags whose text is never content.
DROPPED = frozenset("""annotation applet aside audio button canvas datalist dialog embed fieldset
footer form frame head iframe input menu nav noframes noscript optgroup option progress script
search select style svg template textarea title video""".split())
#: Tags whose text is content inside an article only.
DROPPED_OUTSIDE = frozenset("label legend map object".split())
#: Block tags that hold loose lines; in other blocks a line break is white space.
LOOSE = frozenset("body center html td".split())
#: Tags that may stand in an unclosed head.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: An open element that a start tag closes: tag -> (closes, unless one of these is nearer).
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
#: Block tags close an open paragraph, unless one of these is nearer.
P_SCOPE = frozenset("button caption object table td th".split())
#: Words in a class, an id or a role that mark something other than the article.
MARKS = frozenset("""ad ads adsense advert adverts advertisement advertising advertorial alert
banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie
cookies copyright discussion disqus dialog foot footer form gdpr login masthead menu modal nav navbar
navigation newsletter notice notices notification notifications pager pagination paywall popup
promo promoted promotion recommended related replies reply respond search share sharing sidebar
signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar widget
widgets""".split())
#: Words that mark a container of the article, whatever else the class says.
HOLDS = frozenset("article body container content entry layout main page post story text with "
                  "without wrap wrapper".split())
#: Marks that are words of running text as well: inside an article they count only if the whole
#: name consists of marks and words for parts of a page.
AMBIGUOUS = frozenset("""alert banner comment comments consent copyright discussion foot form login
notice notices notification notifications pagination promoted promotion recommended related replies
reply respond search share sharing skip social subscription widget widgets""".split())
PARTS = frozenset("""area articles bar block body box button buttons container content form group
icons inner item items links list media more news pages panel post posts section stories thread
title top widget wrap wrapper""".split())
#: Tags that ambiguous marks can drop inside an article.
MARKABLE = frozenset("""article aside details dialog dir div dl figure footer form header menu nav
ol section table ul""".split())
#: Names of a container whose header is the article's own.
MAIN_WORDS = frozenset("article body content entry main post story text".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TAG_START = re.compile(r"<(?=[A-Za-z/!?])")


#: Share of the content characters that a region holds.
MOST = 0.9
#: Share that article and main elements hold to be the region.
ARTICLES = 0.85


class _Open(NamedTuple):
    """An open element and what holds inside it."""

    tag: str
    dropped: int          # 1: inside a block, 2: inside an inline element (no line of its own)
    own: bool             # is a container
    container: int        # innermost container, 0 for none
    article: bool         # inside an article or main element
    main: bool            # inside a container named as the main one
    code: bool            # inside pre or code
    block: str            # innermost block tag
    in_p: bool            # a paragraph is open and no nearer element keeps it open


_PAGE = _Open("", 0, False, 0, False, False, False, "", False)


class _Lines(HTMLParser):
    """Lines of a page: text, tags before it, innermost container, dropped or not."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.counts: Counter[str] = Counter()         # open elements by tag
        self.lines: list[tuple[str, int, int, bool]] = []
        self.articles: set[int] = set()               # container numbers of article and main
        self.parents = [0]                            # of each container, in page order
        self.bodies: set[int] = set()
        self._text: list[str] = []
        self._tags = 0

    @property
    def top(self) -> _Open:
        return self.open[-1] if self.open else _PAGE

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            self.lines.append((text, self._tags, self.top.container, bool(self.top.dropped)))
            self._tags = 0

    def _close(self, depth: int) -> None:
        closed = self.open[depth:]
        if any(e.own or e.tag in BLOCK for e in closed):
            self._flush()
        self.counts.subtract(e.tag for e in closed)
        del self.open[depth:]

    def _close_nearest(self, tags, unless) -> None:
        if not any(self.counts[t] for t in tags):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in tags:
                self._close(i)
                return
            if self.open[i].tag in unless:
                return

    def _dropped(self, tag: str, attrs) -> bool:
        top = self.top
        if tag in DROPPED:
            return True
        if tag in DROPPED_OUTSIDE and not (top.article or top.main):
            return True
        if tag == "header":
            return not (top.article or top.main)
        values = dict(attrs)
        if "hidden" in values or _HIDDEN.search(values.get("style") or "") \
                or (values.get("aria-hidden") or "").lower() == "true":
            return True
        inside = top.article or top.main
        if tag in ("html", "body", "main") or top.code or inside and tag not in BLOCK:
            return False
        for name in ("class", "id", "role"):
            for one in (values.get(name) or "").split():
                words = {w.lower() for w in _WORDS.findall(one)}
                marks = words & MARKS
                if inside and marks <= AMBIGUOUS and name != "role" and (
                        tag not in MARKABLE
                        or not all(w in MARKS or w in PARTS or w.isdigit() for w in words)):
                    continue
                if marks and not (name != "role" and words & HOLDS
                                  and not words & {"comment", "comments", "ad", "ads"}):
                    return True
        return (values.get("role") or "").lower() == "banner" and not top.article

    def handle_starttag(self, tag, attrs):
        self._tags += 1
        if tag not in IN_HEAD and tag != "head" and self.counts["head"]:
            self._close_nearest(("head",), ())
        if tag == "br" and self.top.block not in LOOSE and self.top.block:
            self.handle_data(" ")
            return
        if tag in BLOCK:
            if tag != "br" and self.top.in_p:
                self._close_nearest(("p",), ())
            self._flush()
        if tag in IMPLIED_END:
            self._close_nearest(*IMPLIED_END[tag])
        if tag in VOID:
            return
        top = self.top
        dropped = top.dropped
        if not dropped and self._dropped(tag, attrs):
            dropped = 1 if tag in BLOCK else 2
        article = tag in ("article", "main") or any(
            k == "role" and v in ("main", "article") for k, v in attrs)
        own = article or tag in ("section", "div", "td", "body", "table", "blockquote")
        container = top.container
        if own:
            self.parents.append(container)
            container = len(self.parents) - 1
            if tag == "body":
                self.bodies.add(container)
            if article and not dropped:
                self.articles.add(container)
        named = own and any(
            words and words <= MAIN_WORDS and words & {"article", "content", "main", "post", "story"}
            for k, v in attrs if k in ("class", "id") for one in (v or "").split()
            for words in [{w.lower() for w in _WORDS.findall(one)}])
        self.counts[tag] += 1
        self.open.append(_Open(
            tag, dropped, own, container, top.article or article and not dropped,
            top.main or named, top.code or tag in ("pre", "code"),
            tag if tag in BLOCK else top.block,
            tag == "p" or top.in_p and tag not in P_SCOPE))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._tags += 1
        if tag in BLOCK:
            self._flush()
        self._close_nearest((tag,), ())

    def handle_data(self, data):
        if self.top.dropped != 2:
            self._text.append(data)

    def finish(self) -> None:
        """End of the page; a tag, comment or script that has no end is left out."""
        if self.rawdata and (self.cdata_elem or _TAG_START.match(self.rawdata)):
            self.rawdata = ""
        self.close()
        self._flush()


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """The values under a normalised Gaussian kernel; the ends are repeated."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def content_lines(lines, sigma: float, level: float) -> np.ndarray:
    """True for lines whose smoothed text-to-tag ratio is above ``level`` standard deviations."""
    ratios = np.array([len(text) / max(1, tags) for text, tags, _, _ in lines])
    smooth = smoothed(ratios, sigma)
    return smooth > level * smooth.std()


def _articles(lines, parents: list[int], articles: set[int], held: list[int],
              total: int) -> set[int]:
    """The outermost article and main elements of one container that hold most of the content."""
    outermost = [0] * len(parents)
    for c in range(1, len(parents)):
        outermost[c] = outermost[parents[c]] or (c if c in articles else 0)
    beside: defaultdict[int, set[int]] = defaultdict(set)
    for _, _, c, dropped in lines:
        at = outermost[c]
        if at and not dropped:
            beside[parents[at]].add(at)
    best = max(beside.values(), key=lambda found: sum(held[c] for c in found), default=set())
    return best if sum(held[c] for c in best) >= ARTICLES * total else set()


def main_text(html: str | None, sigma: float = 1.0, level: float = 0.5) -> str:
    """The main text of a page, one line a block."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.finish()
    lines = parser.lines
    usable = [not dropped for _, _, _, dropped in lines]
    if not any(usable):
        return ""
    content = content_lines(lines, sigma, level) & np.array(usable)
    if not content.any():
        content = np.array(usable)
    # Characters of content in each container, and of any line that is not dropped.
    parents = parser.parents
    held, any_held = [0] * len(parents), [0] * len(parents)
    for (text, _, c, dropped), good in zip(lines, content.tolist()):
        held[c] += len(text) * good
        any_held[c] += len(text) * (not dropped)
    # Containers are numbered in page order, so a container comes after its parent.
    total = sum(held)
    for c in range(len(parents) - 1, 0, -1):
        if parents[c]:
            held[parents[c]] += held[c]
            any_held[parents[c]] += any_held[c]
    region = _articles(lines, parents, parser.articles, held, total)
    if not region:
        inner = max((c for c in range(1, len(parents)) if held[c] >= MOST * total), default=0)
        # Up to a container that adds little (headings, short lines), but not to the page.
        while inner and parents[inner]:
            outer = parents[inner]
            if outer in parser.bodies or any_held[outer] > 1.5 * any_held[inner]:
                break
            inner = outer
        region = {inner} if inner else set()
    inside = [not region] * len(parents)
    for c in range(1, len(parents)):
        inside[c] = not region or c in region or inside[parents[c]]
    return "\n".join(text for text, _, c, dropped in lines if not dropped and inside[c])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html", sigma: float = 1.0, level: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            texts = [main_text(h, sigma, level) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"),
                        F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
