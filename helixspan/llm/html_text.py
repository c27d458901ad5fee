"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events into lines, one for each block of text.
A line has its characters, its tags and the characters inside links; its text-to-tag ratio is
its characters outside links over its tags. The ratios are smoothed by a Gaussian along the
page, and two-means clustering of the smoothed ratios gives the threshold over which lines count
as content; a line of at least PROSE characters, most of them outside links, counts whatever its
ratio, and shorter lines only count where there are no long ones.

Where article or main elements hold at least MARKED of the content lines' characters outside links, or of all
lines', they are the region: of the outermost articles the one with most text and its siblings, and around them in main
the headings and paragraphs that stand in the elements which hold them; main alone if it has no such article.
What stands beside them doesn't count, whatever its names. Elsewhere the content region is the smallest element that holds
all content lines, and short paragraphs, headings, items and cells around it that aren't links belong to
the text as well. The region's lines are the text, short ones included, without
those that stand in navigation, adverts, comments and the like.

Such parts are known by their element, their ARIA role, or a name of their class or id all of whose
words say so (CLASS_WORDS, beside words of PLACE_WORDS): with-sidebar is none. Inside article and main only
INSIDE_WORDS count, and a header belongs to the article. Ids of headings and of
sections there only count if they name comments. A part known by role, class, id
or as a form stays if it holds most of the page's characters outside links, unless an article or
main with text stands outside it.

An element inside a line never ends the line: dropped ones (a button, a picture) leave the rest of
their line together, and so do inline elements with such names of class or id; formulas stay.

Defined cases: null html is the empty page with the empty text; repeated rows give repeated
results; an empty table has no rows; columns of other names, or names that differ only by case, fall away; markup that is never closed ends with the page; very long and
deeply nested pages take time in proportion to their length, since what is asked of the elements
around a line is summed along the tree once.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

from pyspark.sql import DataFrame

from .common import doc_columns, map_rows

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"
SIGMA = 1.5
PROSE = 40
#: Share of the content's characters outside links from which article and main elements are the region.
MARKED = 1 / 3

# Elements of the HTML standard by their role here.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea input dialog menu "
    "iframe object svg canvas audio video map datalist label fieldset annotation annotation-xml".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
CLASS_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar comment "
    "comments disqus replies reply discussion respond cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup login share sharing social related recommended recommendations pagination "
    "pager widget toolbar tags skip copyright legal disclaimer".split()
)
# Words that only say where such a part is or what it is made of.
PLACE_WORDS = frozenset(
    "a the site page global main primary secondary top bottom left right upper lower header footer post article entry blog "
    "block box bar area wrap wrapper container inner outer row col list item items link links button buttons text message "
    "section group panel form media unit slot js id content body title".split()
)
#: Words that name a part which isn't the article's own, though it stands inside of it.
INSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments disqus replies "
    "respond share sharing social related recommended recommendations newsletter subscribe signup cookie cookies consent gdpr nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar popup modal overlay".split()
)
COMMENT_NAMES = frozenset("comment comments disqus replies respond".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A paragraph, list item, cell or the like is ended by the next one of its kind, even if it isn't closed.
_ENDS = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}),
    "option": frozenset({"option"}),
}
_SCOPE = frozenset("ul ol dl table select article main section div body html".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption caption dt dd li td th".split())
_WORDS = re.compile(r"[A-Za-z]+")


def named_unwanted(names: str, telling: frozenset = CLASS_WORDS) -> bool:
    """Whether one of the names says that the element is an unwanted part."""
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]
        if not telling.isdisjoint(words) and all(w in CLASS_WORDS or w in PLACE_WORDS for w in words):
            return True
    return False


def unwanted(tag: str, attrs, inside: bool = False) -> int:
    """2: dropped in any case, 1: dropped unless it holds most of the page, 0: wanted. inside: in article or main."""
    if tag in DROPPED and tag != "form" and not (inside and tag == "header"):
        return 2
    found = int(tag == "form")
    for name, value in attrs:
        if name in ("class", "id"):
            if not value or tag in ("html", "body", "article", "main"):
                continue
            if name == "id" and inside and (tag in _HEADINGS or tag == "section"):
                found |= value.strip().lower() in COMMENT_NAMES
            elif named_unwanted(value, INSIDE_WORDS if inside else CLASS_WORDS):
                found = 1
        elif name == "role":
            if (value or "").lower() in ROLES:
                found = 1
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 2
        elif name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 2
    return found


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters inside links
    node: int  # the innermost element
    parts: tuple | None  # (text, linked, innermost element) of its parts, if some are in inline elements with unwanted names


class Lines(HTMLParser):
    """Collects lines and the tree of elements from the parser's events; what is dropped in any case isn't collected."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # By element: its tag, the element around it (-1: none), the innermost block from it on outwards.
        self.names: list[str] = []
        self.parent: list[int] = []
        self.block: list[int] = []
        self.doubtful: set[int] = set()  # elements that are dropped unless they hold most of the page
        self.inline: list[int] = []  # open inline ones among them
        self.open: list[tuple[int, bool, bool, int]] = []  # (element, not dropped, in article or main, place of the block around it in this list)
        self.count: Counter = Counter()  # open elements by tag
        self.text: list[tuple[str, int, int]] = []
        self.tags = 0

    def flush(self) -> None:
        node = self.open[-1][0] if self.open else -1
        text = " ".join("".join([x[0] for x in self.text]).split())
        if text:
            split = any(x[2] >= 0 for x in self.text)
            self.lines.append(Line(text, self.tags, sum(x[1] for x in self.text), node, tuple(self.text) if split else None))
            self.tags = 0
        self.text = []

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            n = self.open.pop()[0]
            self.count[self.names[n]] -= 1
            if self.inline and self.inline[-1] == n:
                self.inline.pop()

    def _blocks(self):
        """Places in `open` of the open blocks, innermost first."""
        i = len(self.open) - 1
        if i >= 0 and self.names[self.open[i][0]] not in BLOCK:
            i = self.open[i][3]
        while i >= 0:
            yield i
            i = self.open[i][3]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text.append((" ", 0, -1))
            return
        block = tag in BLOCK
        kept, marked = self.open[-1][1:3] if self.open else (True, False)
        drop = unwanted(tag, attrs, marked)
        if block:
            self.flush()
        self.tags += kept
        if block and tag in _ENDS:
            for i in self._blocks():
                name = self.names[self.open[i][0]]
                if name in _SCOPE:
                    break
                if name in _ENDS[tag]:
                    self._pop_to(i)
                    break
        elif block:
            i = next(self._blocks(), -1)
            if i >= 0 and self.names[self.open[i][0]] == "p":
                self._pop_to(i)
        if tag in VOID:
            return
        n = len(self.names)
        around = next(self._blocks(), -1)
        self.names.append(tag)
        self.parent.append(self.open[-1][0] if self.open else -1)
        self.block.append(n if block else self.open[around][0] if around >= 0 else -1)
        kept, marked = self.open[-1][1:3] if self.open else (True, False)
        self.open.append((n, kept and drop < 2, marked or tag in ("article", "main"), around))
        self.count[tag] += 1
        if drop == 1:
            self.doubtful.add(n)
            if not block:
                self.inline.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.names[self.open[-1][0]] == tag and tag in ("svg", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self.text.append((" ", 0, -1))
            return
        if self.count[tag]:
            for i in range(len(self.open) - 1, -1, -1):
                n, kept = self.open[i][:2]
                if self.names[n] == tag:
                    if tag in BLOCK:
                        self.flush()
                    self.tags += kept
                    self._pop_to(i)
                    return
                if self.names[n] in BLOCK and tag not in BLOCK:
                    return  # an inline end tag doesn't close the block it stands in
        if tag == "p":
            self.flush()

    def handle_data(self, data):
        if not self.open or self.open[-1][1]:
            self.text.append((data, len(data) if self.count["a"] else 0, self.inline[-1] if self.inline else -1))

    def sums(self, amounts) -> list[int]:
        """For each element the sum over (element, amount) in it and in all that it holds."""
        total = [0] * len(self.names)
        for n, k in amounts:
            if n >= 0:
                total[n] += k
        for n in range(len(total) - 1, 0, -1):  # what an element holds comes after it
            if self.parent[n] >= 0:
                total[self.parent[n]] += total[n]
        return total

    def inside(self, roots) -> list[bool]:
        """For each element whether it is one of the roots or inside of one."""
        out: list[bool] = []
        for n, up in enumerate(self.parent):
            out.append(n in roots or (up >= 0 and out[up]))
        return out


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        a, b = max(0, i - reach), min(len(values), i + reach + 1)
        part = kernel[a - i + reach : b - i + reach]
        out.append(sum(x * k for x, k in zip(values[a:b], part)) / sum(part))
    return out


def threshold(values: list[float]) -> float:
    """The border between the two means of one-dimensional clustering, from the extremes on."""
    low, high = min(values), max(values)
    for _ in range(20):
        mid = (low + high) / 2
        below, above = [v for v in values if v < mid], [v for v in values if v >= mid]
        new = (sum(below) / len(below) if below else low, sum(above) / len(above) if above else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def own_chars(line: Line) -> int:
    return len(line.text) - min(line.linked, len(line.text))


def without_unwanted(parser: Lines) -> list[Line]:
    """The lines outside of unwanted parts."""
    lines = parser.lines
    if not parser.doubtful:
        return lines
    amounts = []
    for x in lines:
        if x.parts is None:
            amounts.append((x.node, own_chars(x)))
        else:
            amounts += [(x.node if n < 0 else n, len(" ".join(t.split())) - min(k, len(t))) for t, k, n in x.parts]
    whole, held = sum(k for _, k in amounts), parser.sums(amounts)
    dropped = {n for n in parser.doubtful if 2 * held[n] <= whole}
    gone = parser.inside(dropped)
    marks = {n for n, name in enumerate(parser.names) if name in ("article", "main")}
    marked = parser.inside(marks)
    amounts = [(x.node, 1) for x in lines if x.node >= 0 and marked[x.node] and not gone[x.node]]
    held = parser.sums(amounts)
    # Those that hold most of the page stay, unless they stand beside the marked content.
    dropped |= {n for n in parser.doubtful - dropped if len(amounts) > held[n]}
    gone = parser.inside(dropped)
    out = []
    for x in lines:
        if x.node >= 0 and gone[x.node]:
            continue
        if x.parts is not None:
            kept = [p for p in x.parts if p[2] < 0 or not gone[p[2]]]
            text = " ".join("".join([p[0] for p in kept]).split())
            if not text:
                continue
            x = x._replace(text=text, linked=sum(p[1] for p in kept))
        out.append(x)
    return out


def marked_region(parser: Lines, lines: list[Line], weights: list[int]):
    """Whether a line belongs to the page's article and main elements, as a function; None if these don't hold enough of the weights."""
    names, parent = parser.names, parser.parent
    held = parser.sums([(x.node, w) for x, w in zip(lines, weights)])
    whole = sum(weights)
    up: list[tuple[int, int]] = []  # the outermost main and article around an element or at it
    for n, name in enumerate(names):
        m, a = up[parent[n]] if parent[n] >= 0 else (-1, -1)
        up.append((n if m < 0 and name == "main" else m, n if a < 0 and name == "article" else a))
    enough = lambda n: held[n] > 0 and held[n] >= MARKED * whole
    main = max((n for n, name in enumerate(names) if name == "main" and up[n][0] == n and enough(n)), key=held.__getitem__, default=-1)
    articles = [n for n, name in enumerate(names) if name == "article" and up[n][1] == n and (main < 0 or up[n][0] == main)]
    first = max(articles, key=held.__getitem__, default=-1)
    together = [n for n in articles if parent[n] == parent[first]]
    if first < 0 or sum(held[n] for n in together) < MARKED * (held[main] if main >= 0 else whole) or held[first] == 0:
        if main < 0:
            return None
        region = parser.inside({main})
        return lambda x: x.node >= 0 and region[x.node]
    region, around, n = parser.inside(set(together)), set(), parent[first]
    while main >= 0 and n >= 0 and up[n][0] == main:
        around.add(n)
        n = parent[n]

    def belongs(x: Line) -> bool:
        if x.node < 0 or region[x.node]:
            return x.node >= 0
        block = parser.block[x.node]
        return block >= 0 and parent[block] in around and (names[block] in _HEADINGS or names[block] == "p") and len(x.text) >= 2 * x.linked

    return belongs


def main_text(html: str | None) -> str:
    """The blocks of the page's content region, joined by line feeds."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = without_unwanted(parser)
    if not lines:
        return ""
    names = parser.names
    ratios = smoothed([own_chars(x) / max(1, x.tags) for x in lines])
    least = threshold(ratios)
    content = [len(x.text) >= PROSE and (r >= least or len(x.text) >= 2 * x.linked) for x, r in zip(lines, ratios)]
    content = content if any(content) else [r >= least for r in ratios]
    chars = [own_chars(x) for x in lines]
    for weights in ([k * c for k, c in zip(chars, content)], chars):
        if own := marked_region(parser, lines, weights):
            return "\n".join(x.text for x in lines if own(x))
    held = parser.sums([(x.node, 1) for x, c in zip(lines, content) if c])
    # The smallest element around all content lines, then the smallest fitting one from there outwards.
    every = sum(content)
    n = max((n for n, k in enumerate(held) if k == every), default=-1)
    best = -1
    while n >= 0:
        if names[n] in ("article", "main"):
            best = n
            break
        if best < 0 and names[n] in BLOCK and names[n] not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            best = n
        n = parser.parent[n]
    region = parser.inside({best})
    marked = best >= 0 and names[best] in ("article", "main")

    def belongs(x: Line) -> bool:
        if best < 0 or (x.node >= 0 and region[x.node]):
            return True
        block = parser.block[x.node] if x.node >= 0 else -1
        return not marked and block >= 0 and names[block] in _TEXT and len(x.text) >= 2 * x.linked

    return "\n".join(x.text for x in lines if belongs(x))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page; narrow, without a shuffle."""

    def run(c):
        texts = [main_text(h) for h in c["html"].to_pylist()]
        return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_rows(doc_columns(pages, "page_id", "url", "html"), run, SCHEMA, 128)
