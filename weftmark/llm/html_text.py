"""Main text of web pages from parser events and smoothed text-to-tag ratios (operator 5)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches, table

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never read.
_MUTE = frozenset("script style noscript template iframe object svg math canvas audio video select button textarea head title".split())
#: Elements that hold no article text, and the roles that say the same.
_BESIDE = frozenset("nav footer aside menu dialog form".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_REGIONS = frozenset("article main".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id that mark what is no article text.
_NOISE = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pagination pager popup promo promotion promoted recommendations recommended related respond search share sharing shares sidebar sidenav signup site-header skip social sponsor sponsored subscribe subscription taboola toc toolbar topbar widget widgets alert disclaimer complementary contentinfo".split()
)
_TOKEN = re.compile(r"[^a-z0-9]+")
#: Evidence against an element: none, a part of a word in its class, or its tag, role or class itself.
PLAIN, DOUBTED, BESIDE = 0, 1, 2
#: The ratio of a line counts so much for each element around it that is beside the article, and an article's fit so much more.
LESS, MORE = 0.1, 1.1


@dataclass
class Line:
    """A block of text: its characters, the tags met with it, characters in links, its element, and whether it is a heading."""

    text: str
    tags: int
    linked: int
    element: int
    heading: bool


@dataclass
class Page:
    """What the events leave: lines, and of each element its parent (an earlier one), tag and the evidence against it."""

    lines: list[Line]
    parent: list[int]
    tag: list[str]
    doubt: list[int]


class _Events(HTMLParser):
    """Turns a page into lines, as events come; keeps the open elements, the line in hand, and three numbers an element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page([], [0], ["page"], [PLAIN])
        self.open: list[tuple[str, bool, int]] = []  # tag, mute, element
        self.held: list[str] = []
        self.tags = self.linked = self.links = 0
        self.heading = False
        self.count: Counter[str] = Counter()

    def _cut(self, i: int) -> None:
        for t, _, _ in self.open[i:]:
            self.links -= t == "a"
            self.count[t] -= 1
        del self.open[i:]

    def _flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.page.lines.append(Line(text, self.tags, self.linked, self.open[-1][2] if self.open else 0, self.heading))
            self.tags = 0
        self.held, self.linked, self.heading = [], 0, False

    def _doubt(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in _BESIDE or tag == "header" and not any(self.count[t] for t in _REGIONS):  # an article's own header has its title
            return BESIDE
        found = PLAIN
        if tag in ("html", "body", "main"):
            return found
        for name, value in attrs:
            if name in ("hidden", "aria-hidden") and value != "false" or name == "role" and value in _ROLES:
                return BESIDE
            if name in ("class", "id") and value:
                words = value.lower().split()
                if any(w in _NOISE for w in words):
                    return BESIDE
                if any(t in _NOISE for w in words for t in _TOKEN.split(w)):
                    found = DOUBTED
        return found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.held.append("\n")
            return
        if tag not in _INLINE:
            self._flush()
            if tag in _REGIONS and self.count["nav"]:  # no menu holds an article: it was left open
                self._cut(next(i for i, (t, _, _) in enumerate(self.open) if t == "nav"))
            if tag in _CLOSES_P:
                self._close("p")
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self._close(tag, within=("ul", "ol", "dl", "table", "select"))
        if tag in _VOID:
            return
        mute, element = (self.open[-1][1], self.open[-1][2]) if self.open else (False, 0)
        mute = mute or tag in _MUTE
        doubt = self._doubt(tag, attrs)
        if tag not in _INLINE or doubt:
            self.page.parent.append(element)
            self.page.tag.append(tag)
            self.page.doubt.append(doubt)
            element = len(self.page.parent) - 1
            if tag in _INLINE:
                self._flush()
        self.open.append((tag, mute, element))
        self.count[tag] += 1
        self.links += tag == "a"
        if tag in _HEADINGS:
            self.heading = True

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no self-closing tags but the void ones

    def _close(self, tag: str, within: tuple[str, ...] = ()) -> None:
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._cut(i)
                return
            if self.open[i][0] in within or not within and tag == "p" and self.open[i][0] not in _INLINE:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in _INLINE:
            self._flush()
        if not self.count[tag]:
            return
        i = len(self.open) - 1
        while self.open[i][0] != tag:
            i -= 1
        if tag in _INLINE and self.page.doubt[self.open[i][2]] and self.page.tag[self.open[i][2]] == tag:
            self._flush()
        self._cut(i)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1]:
            return
        self.held.append(data)
        if self.links:
            self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._flush()


def read(html: str) -> Page:
    parser = _Events()
    parser.feed(html)
    parser.close()
    return parser.page


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing, weighted by what of the kernel lies on the page."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """The cut between two clusters of values, by the means of both until they stay."""
    cut = float(values.mean())
    for _ in range(30):
        low, high = values[values < cut], values[values >= cut]
        new = (low.mean() + high.mean()) / 2 if len(low) and len(high) else cut
        if abs(new - cut) < 1e-9:
            break
        cut = float(new)
    return cut


def ratios(page: Page) -> np.ndarray:
    """Of each line, its characters outside links to the tags met with it, less for each element around it that is beside the article."""
    around = [0] * len(page.parent)
    for e in range(1, len(page.parent)):
        around[e] = around[page.parent[e]] + (page.doubt[e] == BESIDE)
    return np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) * LESS ** min(around[x.element], 8) for x in page.lines], dtype=float)


def _pardon(page: Page) -> None:
    """Take the evidence off elements that wrap an article: those around an `article` or `main` element, unless they are of the tags
    beside it, and a form that holds most of the page's text."""
    own, wraps = [0] * len(page.parent), [t in _REGIONS for t in page.tag]
    for x in page.lines:
        own[x.element] += len(x.text) - x.linked
    everything = sum(own)
    for e in range(len(page.parent) - 1, 0, -1):
        if page.doubt[e] and (wraps[e] and (page.tag[e] not in _BESIDE or page.tag[e] == "form") or page.tag[e] == "form" and 2 * own[e] > everything):
            page.doubt[e] = PLAIN
        own[page.parent[e]] += own[e]
        wraps[page.parent[e]] = wraps[page.parent[e]] or wraps[e]


def main_text(html: str | None) -> str:
    """The page's article: blocks joined by an empty line, empty if there is none.

    Each line of text gets the ratio of its characters outside links to the tags met with it, less for each element around it that
    is beside the article by its tag, role or class. Ratios are smoothed; the lines in the upper of two clusters are
    selected. The element whose lines agree best with the selected ones (by the harmonic mean of the shares of characters, with some
    favour for `article` and `main`, the innermost of equals) is the article. An `article` or `main` element is
    taken with all of its lines, for a short paragraph or a title inside it is article text as well; of another element, what is
    taken runs from the first to the last selected line, with the headings before, and leaves out lines that are
    mostly links. Elements beside the article are left out, as are those that only a part of a class word speaks against
    unless most of their text is selected.
    """
    page = read(html or "")
    if not page.lines:
        return ""
    _pardon(page)
    smooth = smoothed(ratios(page))
    chosen = smooth >= threshold(smooth)
    count = len(page.parent)
    text, taken = [0] * count, [0] * count
    for x, c in zip(page.lines, chosen):
        text[x.element] += len(x.text) - x.linked
        taken[x.element] += c * (len(x.text) - x.linked)
    total = sum(taken)
    shut = [False] * count  # left out of what is around it
    for e in range(count - 1, 0, -1):
        shut[e] = page.doubt[e] == BESIDE or page.doubt[e] == DOUBTED and 2 * taken[e] <= text[e]
        if not shut[e]:
            text[page.parent[e]] += text[e]
            taken[page.parent[e]] += taken[e]
    best, fit, inside = -1, 0.0, [False] * count
    for e in range(count):
        inside[e] = bool(e) and (inside[page.parent[e]] or shut[e])  # of something left out
        if inside[e] or page.tag[e] in _INLINE or page.tag[e] in _HEADINGS or page.tag[e] in ("p", "li") or not taken[e]:
            continue
        agrees = 2 * taken[e] / (text[e] + total) * (MORE if page.tag[e] in _REGIONS else 1.0)
        if agrees >= fit - 1e-12:
            best, fit = e, agrees
    if best < 0:
        return ""
    within = [False] * count
    for e in range(best, count):
        within[e] = e == best or within[page.parent[e]] and not shut[e]
    kept = [i for i, x in enumerate(page.lines) if within[x.element]]
    if page.tag[best] not in _REGIONS:
        first = next(k for k, i in enumerate(kept) if chosen[i])
        last = max(k for k, i in enumerate(kept) if chosen[i])
        while first and page.lines[kept[first - 1]].heading:
            first -= 1
        kept = [i for i in kept[first : last + 1] if page.lines[i].heading or 2 * page.lines[i].linked <= len(page.lines[i].text)]
    return "\n\n".join(page.lines[i].text for i in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each row.

    Null html counts as empty and gives an empty text; markup that is broken is read as far as the parser's events go.
    Null ids and urls stay null, repeated rows give repeated rows. Other columns are not read.
    """
    small_batches(pages.sparkSession, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
