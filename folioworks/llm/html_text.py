"""Main text of web pages: parser events make lines, text-to-tag ratios of lines find the content regions.

The standard library's HTML parser is fed in pieces. Its events cut the page into lines at block elements, each with its
text, the characters of it that stand in links, the tags it took and the element it lies in. A line's text-to-tag ratio is
its unlinked text per tag; ratios are smoothed over neighbouring lines with a Gaussian and cut at ``spread`` standard
deviations of the page's smoothed ratios, which clusters lines in content and rest. Content lines name the regions: the
outermost articles that hold some, else the main element, else the element that holds nearly all of them. A region gives all its
lines, short ones too, but those of elements that HTML or their names mark as something else (``ASIDE``, ``NAMES``).

Defined results: null or empty html, and a page without such lines, give an empty text; null ids and urls are kept;
rows that repeat give their text each; a page is parsed whole, whatever its length, in memory in proportion to it; of regions
with equal text the first leads; further columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXTS = "page_id long, url string, text string, n_chars long"
FEED = 1 << 16
#: Lines to each side that the Gaussian reaches, its deviation in lines, and the threshold in deviations of the smoothed ratios.
REACH, SIGMA, SPREAD = 2, 1.0, 1.0
#: Share of an element's content text that its child must hold to stand for it, and of the largest region's that another region must hold to be one.
NEARLY_ALL, ALSO_LARGE = 0.9, 0.25
#: Link-only items of a list that make it a menu.
MENU_ITEMS = 3

# Elements of HTML by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("head title script style noscript template nav footer aside form button select textarea iframe svg canvas object dialog menu audio video map datalist math fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
ENDS_PARAGRAPH_ONLY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist")}
SIBLINGS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
#: Words in class or id that tell what is no article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promoted promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts banner popup modal overlay toast paywall disclaimer newsletter subscribe subscription signup login register search searchbox "
    "share sharing social related recommended recommendations trending popular comment comments commentlist disqus reply replies respond reactions discussion pagination pager toolbar copyright skip hidden".split()
)
#: The same outside an article only: inside, a header holds its title.
PAGE_NAMES = frozenset("header masthead topbar top".split())
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _verdict(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
    """Whether an element is aside anywhere, and whether it is outside an article."""
    if tag in ASIDE:
        return True, True
    page = tag == "header"
    for name, value in attrs:
        value = value or ""
        if name in ("class", "id") and tag not in ("html", "body"):
            words = {w.lower() for w in _NAME.findall(value)}
            if words & NAMES:
                return True, True
            page = page or bool(words & PAGE_NAMES)
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDES.search(value):
            return True, True
    return False, page


class Element:
    __slots__ = ("parent", "tag", "aside", "article", "main", "text", "number")

    def __init__(self, parent: Element | None, tag: str, number: int):
        self.parent, self.tag, self.number, self.text = parent, tag, number, 0
        self.aside = parent.aside if parent else False
        self.article = parent.article if parent else None
        self.main = parent.main if parent else None


class Lines(HTMLParser):
    """Collects (text, ratio, all text in links, element) of each line with text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, float, bool, Element]] = []
        self.open = [Element(None, "#page", 0)]
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0
        self.count = 1

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                plain = max(0, len(text) - self.linked)
                self.lines.append((text, plain / max(1, self.tags), self.linked >= len(text), self.open[-1]))
            self.parts.clear()
        self.tags = self.linked = self.links = 0

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            self.tags += 1
            self.links += tag == "a"
            if tag != "a" and attrs and _verdict(tag, attrs)[0]:
                self._push(tag, attrs)  # a marked span is an element of its own
            return
        if tag in VOID:
            if tag == "hr":
                self._end_line()
            elif tag == "br":
                self.parts.append(" ")
                self.tags += 1
            return
        self._end_line()
        self.tags = 1
        while self.open[-1].tag == "p" or self.open[-1].tag in HEADINGS and tag in HEADINGS:
            self.open.pop()
        if within := ENDS_PARAGRAPH_ONLY.get(tag):
            for at in range(len(self.open) - 1, 0, -1):
                other = self.open[at].tag
                if other in within:
                    break
                if other in SIBLINGS.get(tag, (tag,)):
                    del self.open[at:]
                    break
        self._push(tag, attrs)

    def _push(self, tag, attrs):
        if tag in INLINE:
            held, tags, linked, links = self.parts, self.tags, self.linked, self.links
            self.parts = held[:]
            self._end_line()
            self.parts, self.tags, self.linked, self.links = [], tags, linked, links
        up = self.open[-1]
        one = Element(up, tag, self.count)
        self.count += 1
        anywhere, outside = _verdict(tag, attrs)
        if tag in ("article", "main"):
            # An article within another is a reader's comment; one within an element that was left open is the page's.
            nested = up.article is not None and tag == "article"
            one.aside = anywhere or nested or up.aside and (up.article is not None or any(e.aside and e.tag == "section" for e in self.open))
            if not one.aside:
                one.article, one.main = (one, up.main) if tag == "article" else (up.article, up.main or one)
        elif anywhere or outside and up.article is None:
            one.aside = True
        self.open.append(one)

    def handle_endtag(self, tag):
        if tag in INLINE and not any(e.tag == tag for e in self.open):
            self.links -= tag == "a" and self.links > 0
            return
        if tag in ("body", "html") or tag in VOID:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._end_line()
                del self.open[at:]
                return

    def handle_data(self, data):
        if not self.open[-1].aside:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smoothed(ratios: np.ndarray, reach: int = REACH, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over the lines within ``reach``; at the ends over those that exist."""
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    span = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[span] / np.convolve(np.ones(len(ratios)), kernel)[span]


def _without_menus(lines):
    """Drops runs of list items that are links only."""
    out, run = [], []
    for line in [*lines, None]:
        if line is not None and line[2] and line[3].tag in ("li", "dd", "dt"):
            run.append(line)
            continue
        if len(run) < MENU_ITEMS:
            out += run
        run = []
        if line is not None:
            out.append(line)
    return out


def _within(element: Element, roots: set[int]) -> bool:
    while element is not None:
        if element.number in roots:
            return True
        element = element.parent
    return False


def _regions(lines, content) -> list:
    """The lines of the regions that the content lines name."""
    for kind in ("article", "main"):
        size: dict[int, int] = {}
        for line, chosen in zip(lines, content):
            root = getattr(line[3], kind)
            if root is not None and chosen:
                size[root.number] = size.get(root.number, 0) + len(line[0])
        if size:
            roots = {n for n, s in size.items() if s >= ALSO_LARGE * max(size.values())}
            return [x for x in lines if getattr(x[3], kind) is not None and getattr(x[3], kind).number in roots]
    # No such element: from the page inwards as long as one child holds nearly all content text.
    children: dict[int, dict[int, Element]] = {}
    total = 0
    for line, chosen in zip(lines, content):
        if chosen:
            total += len(line[0])
            one = line[3]
            while one is not None:
                one.text += len(line[0])
                if one.parent is not None:
                    children.setdefault(one.parent.number, {})[one.number] = one
                one = one.parent
    here = 0
    boxes = lambda n: [e for e in children.get(n, {}).values() if e.tag != "p" and e.tag not in HEADINGS]
    while inner := [e for e in boxes(here) if e.text >= NEARLY_ALL * total]:
        here = inner[0].number
    region = [x for x in lines if _within(x[3], {here})]
    large = boxes(here)
    if not large:
        return region
    most = max(e.text for e in large)
    loose = sum(len(x[0]) for x, c in zip(lines, content) if c and _within(x[3], {here}) and not _within(x[3], {e.number for e in large}))
    kept = {e.number for e in large if e.text >= ALSO_LARGE * max(most, loose)}
    places = [k for k, x in enumerate(region) if _within(x[3], kept)] or [0]
    own = {k for k, x in enumerate(region) if x[3].number == here or x[3].parent is not None and x[3].parent.number == here and (x[3].tag == "p" or x[3].tag in HEADINGS)}
    if loose >= ALSO_LARGE * most:
        chosen = own | set(places)
    else:  # loose lines between the regions, and a heading before them
        chosen = {k for k in own if places[0] < k < places[-1] or k < places[0] and region[k][3].tag in HEADINGS} | {k for k in places if kept}
    return [region[k] for k in sorted(chosen)]


def main_text(html: str | None, spread: float = SPREAD) -> str:
    """The blocks of the article, one per line."""
    parser = Lines()
    html = html or ""
    for at in range(0, len(html), FEED):
        parser.feed(html[at : at + FEED])
    parser.close()
    parser._end_line()
    lines = _without_menus([x for x in parser.lines if not x[3].aside])
    if not lines:
        return ""
    ratios = smoothed(np.array([x[1] for x in lines], dtype=float))
    content = ratios >= spread * ratios.std()
    return "\n".join(x[0] for x in _regions(lines, content.tolist()))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    names = [c.split()[0] for c in TEXTS.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, TEXTS)


#: The same for the template of the given pages alone: one article, whose blocks are headings and paragraphs and whose references are two.
ORACLE = r"""
WITH blocks AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS raw FROM pages
), texts AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(raw, lambda b: trim(regexp_replace(
    regexp_replace(replace(regexp_replace(b, '</?(?:b|br)>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)) AS text
  FROM blocks
)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM texts
"""
