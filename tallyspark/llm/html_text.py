"""Main text of HTML pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one per block
element.  Each line has its text, the number of tags it took and the block
elements around it.  The text-to-tag ratios of the lines are smoothed with a
Gaussian kernel and clustered against a threshold (a share of their standard
deviation); runs of lines over it are content regions.  All content regions of the
page are returned, wherever they stand.  Lines under the threshold stay between
content lines and in an ``article`` or ``main`` that holds a content line, so that
short paragraphs stay; outside the innermost of these, lines that are mostly link
text do not.  An ``article`` whose class, id or role names boilerplate goes unless
it holds more of the page's content than all the rest.

Boilerplate: nav, header, footer, aside, form, script, style, template and similar
elements, and elements whose class, id or role names a menu, sidebar, advert,
notice, comment list and so on.  Within an ``article`` or ``main`` a name takes more:
headings stay, paragraphs, sections and other parts of a text (PROSE) named so go only
where their own text-to-tag ratio is under the threshold too, other elements go for a
whole class, id or role token, or for a word of one with a ratio under it.  Where such an
element has no end tag of its own, its end is unknown, and each line after its start goes or stays by
its own ratio.  Outside them, items of a list before the first or after the last line of a ratio over the
threshold go (menus of plain items).  Character references are decoded, white space in
a block becomes one space, blocks are joined by a line feed.

A null or empty page gives an empty text; unclosed and misnested elements are
closed as HTML does for paragraphs and list items; very long pages are parsed
whole; equal rows give equal results; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.0
THRESHOLD = 0.25

# fixed values: element names by their role in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SKIP = frozenset("head title nav header footer aside form script style noscript template iframe svg math canvas object button select textarea dialog menu audio video map".split())
#: an opening tag that ends an open element of these names
CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: words of a class, id or role that mark an element as not being the article
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside "
    "footer header masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended "
    "recommendations comment comments reply replies disqus discussion widget toolbar pagination pager skip legal copyright disclaimer contentinfo complementary".split()
)
ROOTS = ("article", "main", "body")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p section blockquote pre figure figcaption table tr td th caption li dd dt".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_WS = re.compile(r"[\s\x00]+")


def _hinted(attrs) -> bool:
    return _hidden(attrs) or any(name in ("class", "id", "role") and value and any(w.lower() in HINTS for w in _WORD.findall(value)) for name, value in attrs)


def _named(attrs) -> bool:
    """Whether a whole token of the class, id or role is a hint."""
    return any(name in ("class", "id", "role") and value and any(t.lower() in HINTS for t in value.split()) for name, value in attrs)


def _hidden(attrs) -> bool:
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
            return True
    return False


class Lines(HTMLParser):
    """Collects (text, tags, boilerplate, ids of the open ROOTS, whether mostly link text, ids of the open doubtful elements,
    ids of the open elements named as boilerplate within an article, whether in a list) of each line."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, tuple[int, ...], bool, tuple[int, ...], tuple[int, ...], bool]] = []
        self.open: list[tuple[str, bool, bool, bool]] = []
        self.named: list[int] = []
        self.n_named = self.items = 0
        self.unclosed: set[int] = set()
        self.doubts: list[int] = []
        self.n_doubts = 0
        self.roots: list[int] = []
        self.root_names: list[str] = []
        self.root_hinted: list[bool] = []
        self.links = self.linked = 0
        self.skipping = 0
        self.parts: list[str] = []
        self.tags = 0

    def end_line(self) -> None:
        text = _WS.sub(" ", "".join(self.parts)).strip() if self.parts else ""
        if text:
            self.lines.append((text, self.tags, self.skipping > 0, tuple(self.roots), 2 * self.linked > len(text), tuple(self.doubts), tuple(self.named), self.items > 0))
            self.tags = 0
        self.parts = []
        self.linked = 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in BLOCK:
            self.end_line()
            for closed in CLOSES.get(tag, ()):
                self.close_upto(closed, {"table", "ul", "ol", "dl", "article", "main", "body", "section", "div", "blockquote", "td"} - {closed})
        self.tags += 1
        if tag == "br":
            self.parts.append("\n")
        if tag in VOID:
            return
        skip = tag in SKIP or (tag not in ("html", "body", *ROOTS) and _hinted(attrs))
        doubt = named = False
        if skip and tag not in SKIP and not _hidden(attrs) and any(self.root_names[r] != "body" for r in self.roots):
            skip = tag not in HEADINGS and tag not in PROSE and _named(attrs)
            doubt = not skip and tag not in HEADINGS
            skip, named = False, skip
        if doubt or named or (skip and not self.skipping):
            self.end_line()
        self.skipping += skip
        if named:
            self.named.append(self.n_named)
            self.n_named += 1
        self.items += tag == "li"
        if doubt:
            self.doubts.append(self.n_doubts)
            self.n_doubts += 1
        self.open.append((tag, skip, doubt, named))
        self.links += tag == "a"
        if tag in ROOTS:
            self.root_names.append(tag)
            self.root_hinted.append(tag == "article" and _hinted(attrs))
            self.roots.append(len(self.root_names) - 1)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def pop(self, own: str) -> str:
        """Closes the innermost element; ``own`` is the name that the end tag has."""
        tag, skip, doubt, named = self.open.pop()
        if skip or doubt or named:
            self.end_line()
        if doubt:
            self.doubts.pop()
        if named:
            k = self.named.pop()
            if tag != own:
                self.unclosed.add(k)
        self.items -= tag == "li"
        self.skipping -= skip
        self.links -= tag == "a"
        if tag in ROOTS:
            self.roots.pop()
        return tag

    def close_upto(self, tag: str, barrier: set[str]) -> None:
        for name, *_ in reversed(self.open):
            if name == tag:
                while self.pop(tag) != tag:
                    pass
                return
            if name in barrier:
                return

    def handle_endtag(self, tag) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag in BLOCK:
            barrier = set() if tag in ("html", "body", "article", "main") else {"article", "main", "body", "td"} - {tag}
        else:
            barrier = BLOCK
        self.close_upto(tag, set(barrier))

    def handle_data(self, data) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(_WS.sub(" ", data).strip())

    def close(self) -> None:
        super().close()
        self.end_line()
        self.unclosed.update(self.named)


def smooth(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the kernel is normalised at the borders."""
    r = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    out = []
    for i in range(len(ratios)):
        lo, hi = max(0, i - r), min(len(ratios), i + r + 1)
        w = kernel[lo - i + r : hi - i + r]
        out.append(sum(a * b for a, b in zip(w, ratios[lo:hi])) / sum(w))
    return out


def clusters(lines: list[tuple], sigma: float, threshold: float) -> tuple[list[float], list[float], float]:
    """Text-to-tag ratios, their smoothed form and the limit for content."""
    raw = [0.0 if line[2] else len(line[0]) / max(1, line[1]) for line in lines]
    ratios = smooth(raw, sigma)
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((x - mean) ** 2 for x in ratios) / len(ratios))
    # a page of one even ratio is all content
    return raw, ratios, min(mean, threshold * spread)


def extract(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    if parser.n_named:
        lines = [(text, n, skip or not parser.unclosed.issuperset(named), *rest, named, item) for text, n, skip, *rest, named, item in lines]
    raw, ratios, limit = clusters(lines, sigma, threshold)
    if parser.unclosed:
        # after the start of an element without an end tag each line stands for itself
        lines = [(text, n, skip or (len(named) > 0 and x < limit), *rest, named, item) for x, (text, n, skip, *rest, named, item) in zip(raw, lines)]
        raw, ratios, limit = clusters(lines, sigma, threshold)
    if parser.n_doubts:
        # elements of a doubtful name go where all of their text has a low ratio
        size, tags = [0] * parser.n_doubts, [0] * parser.n_doubts
        for line in lines:
            for k in line[5]:
                size[k] += len(line[0])
                tags[k] += line[1]
        low = [n < limit * max(1, t) for n, t in zip(size, tags)]
        lines = [(text, n, skip or any(low[k] for k in doubts), roots, link, doubts, *rest) for text, n, skip, roots, link, doubts, *rest in lines]
        raw, ratios, limit = clusters(lines, sigma, threshold)
    # links beside a content region do not take its ratio
    content = [x >= limit and not skip and (not link or y >= limit) for x, y, (_, _, skip, _, link, *_) in zip(ratios, raw, lines)]
    # items of a list outside all lines of a high ratio of their own, and outside articles, are a menu's
    high = [k for k, y in enumerate(raw) if y >= limit]
    for k, line in enumerate(lines):
        if line[7] and raw[k] < limit and not (high and high[0] < k < high[-1]) and all(parser.root_names[r] == "body" for r in line[3]):
            lines[k], content[k] = (*line[:2], True, *line[3:]), False
    doubtful = [any(parser.root_hinted[k] for k in line[3]) for line in lines]
    weight = [0, 0]
    for inside, doubt, line in zip(content, doubtful, lines):
        weight[doubt] += inside * len(line[0])
    gone = [skip or (doubt and weight[1] <= weight[0]) for doubt, (_, _, skip, *_) in zip(doubtful, lines)]
    chosen = [k for k, inside in enumerate(content) if inside and not gone[k]]
    if not chosen:
        return ""
    held: set[int] = set()
    outer: set[int] = set()
    for k in chosen:
        own = [r for r in lines[k][3] if parser.root_names[r] != "body"]
        held.update(own)
        outer.update(own[:-1])

    def stays(k: int) -> bool:
        if content[k]:
            return True
        _, _, _, roots, link, *_ = lines[k]
        own = next((r for r in reversed(roots) if r in held), None)
        if own is not None and own not in outer:
            return True
        return not link and (own is not None or chosen[0] < k < chosen[-1])

    return "\n".join(line[0] for k, line in enumerate(lines) if not gone[k] and stays(k))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(task, "page_id long, url string, text string")
