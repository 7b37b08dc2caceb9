"""Main text of web pages from the events of the standard library's streaming parser.

The parser's events cut a page into lines: a line ends wherever a block element starts or ends. Each line has
a text-to-tag ratio, the characters of its text over the tags since the line before. The ratios are smoothed
with a Gaussian, and the lines at or above the page's threshold (a share of the standard deviation of the
smoothed ratios) form the dense cluster. The region of the page that holds most of the cluster is the content;
its short lines belong to it too, so nothing between two dense lines is lost.

Elements that HTML or their own names mark as something else (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, reader comments) have ratio zero and never give text.

Definitions. Null or empty html, and a page without content lines: the empty text. White space is what
``str.split`` takes for it, the no-break space included. Character references are decoded as ``html.unescape``
does. A tag that is cut off by the end of the page, and a comment that never ends, go. Pages do not depend on
each other: repeated rows give repeated results. A column of the table called ``text`` or ``n_chars`` is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, spare

#: fixed values: elements of HTML by what they do to the text around them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
HOLDERS = frozenset("article body div main section table td ul ol dl blockquote form aside figure details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: fixed values: elements and roles that never hold the main text
OUTSIDE = frozenset(
    "aside audio button canvas dialog datalist embed fieldset footer form head iframe input label map math menu nav "
    "noscript object script select style svg template textarea title video".split()
)
OUTSIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split()
)
#: fixed values: words in the class or id of a block that say what it is
NAMED = re.compile(
    r"(ads?|adv|advert\w*|adbox|adslot|adunit|adsbygoogle|banner|sponsor\w*|promo\w*|nav|navbar|navigation|sidenav|menus?|"
    r"breadcrumbs?|sidebar|footer|masthead|topbar|comments?|commentlist|repl(y|ies)|respond|disqus|cookies?|consent|gdpr|"
    r"notices?|notifications?|alert|popup|modal|newsletter|subscribe|subscription|signup|login|share|sharing|social|"
    r"related|recommend\w*|trending|popular|widget|pager|pagination|search|toolbar|copyright|disclaimer|paywall)"
)
#: fixed values: words before such a word, or around it, that make the block something larger
NEGATED = frozenset("has no with without hide is".split())
WRAPPED = re.compile(r"(?=.*\b(content|main|article|post|page)\b)(?=.*\b(wrap|wrapper|layout|container|grid|row)\b)")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: an open element of the left kind ends when one of the right kind starts inside it; the third kind holds it open
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}


def _outside(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether an element is marked as something other than main text."""
    if tag in OUTSIDE:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    named = dict(attrs)
    if "hidden" in named or named.get("aria-hidden") == "true" or (named.get("role") or "").lower() in OUTSIDE_ROLES:
        return True
    if re.search(r"display\s*:\s*none", named.get("style") or ""):
        return True
    if tag not in BLOCKS or tag == "main":
        return False
    for name in f"{named.get('class') or ''} {named.get('id') or ''}".split():
        words = [w.lower() for w in NAME_WORD.findall(name)]
        for i, word in enumerate(words):
            if NAMED.fullmatch(word) and not (i and words[i - 1] in NEGATED) and not WRAPPED.search(" ".join(words)):
                return True
    return False


class _Lines(HTMLParser):
    """Lines of a page, and the tree of the elements that hold them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, int]] = []  # tag, 1 if outside, header, holder before
        self.count: Counter[str] = Counter()
        self.outside = 0
        self.headers = 0
        self.marked = 0  # open articles and mains
        self.links = 0
        self.heading = 0
        self.parent, self.kind = [-1], ["page"]
        self.holder = 0
        self.parts: list[str] = []
        self.in_link = 0
        self.tags = 0
        # per line: text, tags, characters in links, holder, heading or not, outside or not
        self.lines: list[tuple[str, int, int, int, bool, bool]] = []

    def finish_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                off = self.outside > 0 or (self.headers > 0 and not (self.heading and self.marked))
                self.lines.append(("" if off else text, self.tags, self.in_link, self.holder, self.heading > 0, off))
                self.tags = 0
            self.parts.clear()
            self.in_link = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        block = tag in BLOCKS
        if block:
            self.finish_line()
            if self.count["p"] and tag not in ("option", "optgroup"):
                self.shut(("p",), ())
            if tag in ENDS:
                self.shut(*ENDS[tag])
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        off = _outside(tag, attrs)
        if off and not block:
            self.finish_line()
        header = tag == "header" or (block and any(k in ("class", "id") and v and "header" in v.lower().split() for k, v in attrs))
        self.open.append((tag, int(off), header, self.holder))
        self.count[tag] += 1
        self.outside += off
        self.headers += header
        self.marked += tag in ("article", "main")
        self.links += tag == "a"
        self.heading += tag in HEADINGS
        if tag in HOLDERS:
            marks = dict(attrs)
            kind = "article" if tag == "article" or marks.get("itemprop") == "articleBody" else "main" if tag == "main" or marks.get("role") == "main" else tag
            self.parent.append(self.holder)
            self.kind.append(kind)
            self.holder = len(self.kind) - 1

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "iframe", "script", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.finish_line()
        self.tags += 1
        if self.count[tag]:
            self.shut((tag,), () if tag in BLOCKS or tag in OUTSIDE else BLOCKS)

    def shut(self, tags: tuple[str, ...], held_by) -> None:
        """Close the innermost open element of one of the kinds, and all inside it, up to an element that holds it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i][0] in held_by:
                return

    def pop(self) -> None:
        tag, off, header, holder = self.open.pop()
        if off and tag not in BLOCKS:
            self.finish_line()
        self.count[tag] -= 1
        self.outside -= off
        self.headers -= header
        self.marked -= tag in ("article", "main")
        self.links -= tag == "a"
        self.heading -= tag in HEADINGS
        self.holder = holder

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.in_link += len(data)


def _whole(html: str) -> str:
    """The page up to a comment or tag that the end of the page cuts off."""
    comment = html.find("<!--", html.rfind("-->") + 1)
    if comment >= 0 and "</script" not in html[comment:].lower():
        html = html[:comment]
    last = html.rfind(">") + 1
    cut = re.search(r"<[A-Za-z/!?]", html[last:])
    return html[: last + cut.start()] if cut else html


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean of each value's neighbours within three deviations; beyond the ends there is nothing."""
    reach = math.ceil(3 * sigma)
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    pad = np.zeros(reach)
    return np.convolve(np.concatenate([pad, ratios, pad]), bell / bell.sum(), "valid")


def main_text(html: str | None, sigma: float = 1.0, share: float = 1.0, hold: float = 0.7, link_share: float = 0.5) -> str:
    """Main text of one page.

    ``sigma`` is the width of the smoothing in lines and ``share`` the threshold in standard deviations. Where no
    element is marked as the article, the region narrows while one holder has ``hold`` of the dense text.
    A holder without dense lines, more than ``link_share`` of whose text is links, is a menu.
    """
    if not html:
        return ""
    page = _Lines()
    page.feed(_whole(html))
    page.close()
    page.finish_line()
    lines = page.lines
    if not any(line[0] for line in lines):
        return ""
    ratios = smoothed(np.array([len(text) / max(tags, 1) for text, tags, *_ in lines]), sigma)
    dense = (ratios >= share * ratios.std()) & np.array([not line[5] for line in lines])
    n = len(page.kind)
    mass, size, linked, crowd = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for (text, _, links, holder, _, off), in_cluster in zip(lines, dense, strict=True):
        if not off:
            size[holder] += len(text)
            linked[holder] += min(links, len(text))
            mass[holder] += len(text) * in_cluster
            crowd[holder] += in_cluster
    for i in range(n - 1, 0, -1):  # a holder's number is above its parent's
        for total in (mass, size, linked, crowd):
            total[page.parent[i]] += total[i]
    region = _region(page, mass, size, hold)
    inside, menu = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(n):
        up = page.parent[i]
        inside[i] = i == region or (i > region and inside[up])
        bare = i != region and inside[i] and crowd[i] == 0 and linked[i] > link_share * size[i]
        menu[i] = bare or (inside[i] and i != region and menu[up])
    kept = [not line[5] and inside[line[3]] and not menu[line[3]] for line in lines]
    if True in kept and page.kind[region] != "article":
        # the page's title often stands just before its region
        first = kept.index(True) - 1
        while first >= 0 and lines[first][5]:
            first -= 1
        if first >= 0 and lines[first][4]:
            kept[first] = True
    return " ".join(line[0] for line, keep in zip(lines, kept, strict=True) if keep)


def _region(page: _Lines, mass: np.ndarray, size: np.ndarray, hold: float) -> int:
    """The holder of the main text: the marked one with most dense text, else the narrowest that has nearly all."""
    for kind in ("article", "main"):
        marked = [i for i, k in enumerate(page.kind) if k == kind and size[i] > 0]
        if marked:
            return max(marked, key=lambda i: (mass[i], size[i], -i))
    below: dict[int, list[int]] = {}
    for i in range(1, len(page.kind)):
        below.setdefault(page.parent[i], []).append(i)
    region = 0
    while below.get(region):
        best = max(below[region], key=lambda i: (mass[i], size[i], -i))
        if mass[best] == 0 or mass[best] < hold * mass[region] or page.kind[best] in ("ul", "ol", "dl", "blockquote", "figure"):
            break
        region = best
    return region


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but ``html`` by default), the main ``text`` and its number of code points ``n_chars``."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars") and (keep is not None or c != html)]
    source = spare(keep, "source")
    rows = pages.select(*keep, F.col(html).cast("string").alias(source))
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few hundred pages at a time, so that texts are not held for a whole batch
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h.as_py()) for h in column(part, source)]
                made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
