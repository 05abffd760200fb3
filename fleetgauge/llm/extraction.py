"""Main text of web pages by text-to-tag ratios.

The events of the standard library's parser stream into lines: the text between two boundaries of block elements, with the
tags that stand in it and the elements around it. Each line's ratio of text to tags is smoothed with a Gaussian over its
neighbours, and a clustering of the ratios into two sets their threshold. Lines above it say which region of the page holds
the main text: the article element with most of them or, on pages without one, the element around them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, utf8

#: Width of the Gaussian, in lines, and how far it reaches.
SIGMA, REACH = 1.0, 3

# Fixed values of HTML: elements that begin a new line, that have no end tag, and that are no part of a page's text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
UNREAD = frozenset(
    "applet aside audio button canvas dialog footer form frameset head iframe input label map menu nav noframes noscript object "
    "option script select style svg template textarea title video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an article's text may be laid out in; what lies in a region is read down to these.
REGIONS = frozenset("article body center div main section table tbody td tr".split())
#: An end tag of these closes whatever is still open inside; a start tag of a key closes an open element of its values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
WALLS = frozenset("ul ol dl table select".split())

#: Words in an element's class, id or role that say it is no part of the article; fixed values.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion cookie cookies consent gdpr "
    "banner notice notices popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside complementary "
    "menu menus menubar nav navbar navigation navigations breadcrumb breadcrumbs header masthead footer contentinfo colophon "
    "comment comments commentlist reply replies discussion disqus respond responses share sharing social related recommended "
    "recommendations pagination pager toolbar widget widgets search dialog alert form skip".split())
_WORDS = re.compile(r"[a-z]+")
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TAG = re.compile(r"<[a-zA-Z/!?]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def marked(attributes: list[tuple[str, str | None]]) -> bool:
    """Whether an element's attributes say that it is a menu, an advert, a notice or the like, or that it is not shown."""
    for name, value in attributes:
        if name in ("class", "id", "role"):
            if not MARKS.isdisjoint(_WORDS.findall(_HUMPS.sub(" ", value or "").lower())):
                return True
        elif name == "hidden" or name == "aria-modal" or name == "style" and _HIDDEN.search(value or ""):
            return True
    return False


class Element:
    """A node of the page's tree, numbered in the order of start tags, so that parents come before children."""

    __slots__ = ("tag", "parent", "number", "unread", "hinted", "mute", "title", "article", "soft", "last")

    def __init__(self, tag: str, parent: Element | None, number: int, unread: bool = False, hinted: bool = False, inline: bool = False):
        self.tag, self.parent, self.number = tag, parent, number
        self.last = number                         # the greatest number of what lies in it
        self.unread, self.hinted = unread, hinted  # no article text by its name, by its attributes
        self.mute = parent is not None and (parent.mute or inline and (unread or hinted))
        self.title = self.article = False          # a main or h1, an article element lies in it
        self.soft = False                          # marked as a header, within an article


class Lines(HTMLParser):
    """Parser events to lines: text, number of tags, innermost element.

    Unread elements that are part of a line (a script in a paragraph) do not end it. Tables of open tags keep the cost
    of every event independent of how deep a page is nested.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = Element("", None, 0)
        self.elements = [self.open]
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.places: list[Element] = []
        self._said: list[str] = []
        self._count = 0
        self._depth: Counter[str] = Counter()

    def _cut(self) -> None:
        text = " ".join("".join(self._said).split())
        self._said.clear()
        if text:
            self.texts.append(text)
            self.tags.append(self._count)
            self.places.append(self.open)
            self._count = 0

    def _close(self, last: Element) -> None:
        """Closes all open elements up to `last`."""
        at = self.open
        while True:
            self._depth[at.tag] -= 1
            if at is last:
                break
            at = at.parent
        self.open = last.parent

    def _close_nearest(self, tags: frozenset[str] | set[str], walls: frozenset[str]) -> None:
        if any(self._depth[t] for t in tags):
            at = self.open
            while at.parent and at.tag not in walls:
                if at.tag in tags:
                    self._close(at)
                    return
                at = at.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in BLOCKS
        if block:
            self._cut()
        self._count += 1
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self._said.append(" ")
            return
        unread = tag in UNREAD
        hinted = bool(attrs) and tag not in ("html", "body") and marked(attrs)
        if not (block or unread or hinted):
            return  # plain inline elements are no part of the tree
        if block:
            self._close_nearest({"p"}, BLOCKS - {"p"})
            if tag in CLOSES:
                self._close_nearest(CLOSES[tag], WALLS)
        inside = self._depth["article"] or self._depth["main"]
        new = self.open = Element(tag, self.open, len(self.elements), unread and not (tag == "header" and inside), hinted, not block)
        new.soft = bool(hinted and inside and "header" in tag + "".join(v or "" for k, v in attrs if k in ("class", "id")).lower())
        self.elements.append(new)
        self._depth[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in UNREAD and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        block = tag in BLOCKS
        if block:
            self._cut()
        self._count += 1
        if self._depth[tag]:
            self._close_nearest({tag}, frozenset() if block else BLOCKS)

    def parse_comment(self, i: int, report: bool = True) -> int:
        # A comment without an end reaches to the end of the page; the parser would look for its end again and again.
        return super().parse_comment(i, report) if self.rawdata.find("-->", i) >= 0 else len(self.rawdata)

    def handle_data(self, data: str) -> None:
        if not self.open.mute:
            self._said.append(data)

    def finish(self) -> None:
        self.close()
        self._cut()
        for e in reversed(self.elements[1:]):
            e.parent.last = max(e.parent.last, e.last)
            e.parent.title |= e.title or e.tag == "h1" or e.tag == "main"
            e.parent.article |= e.article or e.tag == "article"

    def sums(self, values: dict[int, int] | list[int]) -> list[int]:
        """Values of lines (by line number) summed over each element and all that lies in it."""
        total = [0] * len(self.elements)
        for i, value in values.items() if isinstance(values, dict) else enumerate(values):
            total[self.places[i].number] += value
        for e in reversed(self.elements[1:]):
            total[e.parent.number] += total[e.number]
        return total

    def below(self, roots: set[Element]) -> list[bool]:
        """Per element, whether it is one of `roots` or lies in one."""
        found: list[bool] = []
        for e in self.elements:
            found.append(e in roots or e.parent is not None and found[e.parent.number])
        return found

    def left(self) -> list[int]:
        """Lines in no unread or marked element. One that was never closed, or wraps the page, is known by the page's
        title or article in it and by most of the page's text."""
        sizes = self.sums([len(t) for t in self.texts])
        wraps = lambda e: (e.title or e.article and not e.hinted) and 2 * sizes[e.number] > sizes[0]
        gone = self.below({e for e in self.elements if (e.unread or e.hinted) and not wraps(e) and not (e.soft and e.title)})
        return [i for i, place in enumerate(self.places) if not gone[place.number]]


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    """The ratios under a Gaussian; at the ends the weights that remain are scaled to one."""
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach:reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]


def threshold(ratios: np.ndarray) -> float:
    """Between the two clusters of the ratios: two means, started at the least and the greatest of them.

    Where all are equal there is one cluster, and everything is above the threshold.
    """
    low, high = float(ratios.min()), float(ratios.max())
    cut = (low + high) / 2
    while high > low:
        above = ratios >= cut
        low, high = float(ratios[~above].mean()), float(ratios[above].mean())
        if (low + high) / 2 == cut:
            break
        cut = (low + high) / 2
    return cut


def region(page: Lines, left: list[int], content: dict[int, int]) -> list[int]:
    """The lines of the main text, of those in `left`. `content` has the size of each line above the threshold.

    The article or main element that holds most of that content, with all its lines; on a page without such elements the
    stretch around the content, up to the ends of the elements that its first and last line lie in, and the headings above.
    """
    mass, size = page.sums(content), page.sums({i: len(page.texts[i]) for i in left})
    sections = [e for e in page.elements if e.tag in ("article", "main") and size[e.number]]
    if sections:
        best = max(sections, key=lambda e: (mass[e.number], size[e.number], -e.number))
        # An article in it that holds most of its content says more closely what the page is about.
        for e in sections:
            if e.tag == "article" and 2 * mass[e.number] > mass[best.number] and best.number < e.number <= best.last:
                best = e
        return [i for i in left if best.number <= page.places[i].number <= best.last]
    if not content:
        return []
    best = [e for e in page.elements if (e.tag in REGIONS or not e.parent) and 2 * mass[e.number] > mass[0]][-1]
    holders, headings = [page.elements[0]], page.below({e for e in page.elements if e.tag in HEADINGS})
    for e in page.elements[1:]:
        holders.append(e if e.tag in REGIONS else holders[e.parent.number])
    holder = lambda i: holders[page.places[i].number]
    lines = [i for i in left if best.number <= page.places[i].number <= best.last]
    core = [k for k, i in enumerate(lines) if i in content]
    first, last = core[0], core[-1]
    while first > 0 and (holder(lines[first - 1]) is holder(lines[core[0]]) or headings[page.places[lines[first - 1]].number]):
        first -= 1
    while last + 1 < len(lines) and holder(lines[last + 1]) is holder(lines[core[-1]]):
        last += 1
    before = left.index(lines[first])
    while first == 0 and before > 0 and headings[page.places[left[before - 1]].number]:
        before -= 1
    return left[before:left.index(lines[first])] + lines[first:last + 1]


def main_text(html: str) -> str:
    """The lines of a page's main text, joined by line feeds; without any, the empty text."""
    page = Lines()
    cut = _TAG.search(html, html.rfind(">") + 1)
    page.feed(html[:cut.start()] if cut else html)  # a tag without an end is no text
    page.finish()
    left = page.left()
    if not left:
        return ""
    ratios = smoothed(np.array([len(t) / max(n, 1) for t, n in zip(page.texts, page.tags)]))
    cut = threshold(ratios[left])
    lines = region(page, left, {i: len(page.texts[i]) for i in left if ratios[i] >= cut})
    return "\n".join(page.texts[i] for i in lines)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, from its whole HTML.

    Without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and reader comments; white
    space inside a line is one space, lines are joined by one line feed. A null or empty page, or one without text, gives
    the empty text and 0. Text outside any element is text of the page. Equal rows give equal results; null keys and urls
    stay null; an empty table gives no rows; other columns are not read. A page is one value and must fit a task.
    """
    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = [main_text(str(body, "utf-8", "replace")) for body in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), utf8(html).alias("html"))
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
