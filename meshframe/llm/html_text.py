"""Main text of web pages (operator 5).

The standard library's streaming parser turns a page into lines, one for each block element, with the
characters, the linked characters and the tags of each. The text-to-tag ratios of the lines are smoothed by
a Gaussian; lines at or above a threshold form clusters, and the heaviest cluster points out the region of
the page that holds the article: the closest element around the cluster's heavier lines, widened to an article or
main element around it, or else to an element that adds little but a heading. All lines of the region are the text,
but for those in parts that are no article by their element, role, class or id, and links outside paragraphs.

Class and id words count on elements that group others, never on a paragraph or heading, and not on a wrapper that
holds an article, a main element or the h1. Elements are numbered as they open, so that a region is a range of numbers and the
element around some lines is the one around the first and the last: time and memory are linear in the page.

Defined results: null, empty and text-free pages give an empty text; unclosed, stray and cut-off markup is
read as far as it goes; character references are decoded; a line break inside a block is white space; blocks
keep page order and repeat if the page repeats them; pages of any length are read whole; repeated rows repeat their
result; an empty table gives an empty table; clashing columns are replaced."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, read_table

SIGMA, WIDTH = 1.0, 2
#: A line belongs to a cluster if its smoothed ratio reaches this share of the mean over lines with text, and is one of
#: its heavier lines if its ratio reaches SHARE of the cluster's largest.
THRESHOLD, SHARE = 1.0, 0.5
#: What an element around the cluster's may add to the text for a heading's sake.
WIDEN = 0.25

# Elements of HTML by what they do to lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
ENDS_P = BLOCK - {"html", "body", "li", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt"}
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas audio video select option datalist textarea button title label".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
FOREIGN = frozenset("svg math".split())
#: Unseen elements that end with the line if they are not closed.
SHORT = frozenset("button label title".split())
SIDE = frozenset("nav aside footer form menu dialog".split())
WHOLE = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold a piece of text rather than parts of a page.
PIECES = HEADINGS | frozenset("p li pre blockquote b i a em strong span ul ol dl dd dt td th tr tbody table figcaption".split())
#: Elements whose class and id are not looked at.
TEXTUAL = HEADINGS | frozenset("p pre blockquote b i a em strong code abbr cite q mark small sub sup figcaption td th".split())
SPACED = frozenset("br td th img input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark parts which are no article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup"
    " login share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus widget widgets toolbar pagination pager search skip copyright".split()
)
CUT_TAG = re.compile(r"<[/!a-zA-Z][^<>]*\Z")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NEVER, NAMED, FREE = 2, 1, 0


def side(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    """NEVER: an element that is no article; NAMED: one whose class or id says so; else FREE."""
    if tag in WHOLE:
        return FREE
    if tag in SIDE or tag == "header" and not in_article:
        return NEVER
    named = FREE
    for key, value in attrs:
        value = value or ""
        if key == "role" and value.strip().lower() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return NEVER
        if key in ("class", "id") and tag not in TEXTUAL:
            words = [w.lower() for w in NAME.findall(value)]
            if any(w in MARKS for w in words) or "header" in words and not in_article:
                named = NAMED
    return named


class Lines(HTMLParser):
    """Parser events as elements, numbered as they open, and lines: (text, tags, linked characters, element, block)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, str]] = []
        self.names: list[str] = []
        self.parent: list[int] = []
        self.side: list[int] = []
        self.open: list[int] = []
        self.count: Counter[str] = Counter()  #: open elements by name
        self.unseen = 0
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.block = ""

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.open[-1] if self.open else -1, self.block))
            self.tags = 0
        self.parts, self.linked = [], 0
        while self.open and self.names[self.open[-1]] in SHORT:
            self.pop(len(self.open) - 1)

    def pop(self, at: int) -> None:
        for n in self.open[at:]:
            self.unseen -= self.names[n] in UNSEEN
            self.count[self.names[n]] -= 1
        del self.open[at:]

    def last(self, tag: str, stops: frozenset = frozenset()) -> int:
        if self.count[tag]:
            for at in range(len(self.open) - 1, -1, -1):
                name = self.names[self.open[at]]
                if name == tag:
                    return at
                if name in stops:
                    return -1
        return -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SPACED:
            self.parts.append(" ")
        if tag in BLOCK:
            self.end_line()
            self.block = tag
            if tag in ENDS_P and (at := self.last("p", BLOCK - {"p"})) >= 0:
                self.pop(at)
            elif tag in ("li", "dd", "dt", "tr") and (at := self.last(tag, frozenset(("ul", "ol", "dl", "table", "menu")))) >= 0:
                self.pop(at)
        self.tags += 1
        if self.count["head"] and tag not in IN_HEAD and (tag in BLOCK or tag == "body"):
            self.pop(self.last("head"))
        if tag in VOID:
            return
        self.parent.append(self.open[-1] if self.open else -1)
        self.side.append(side(tag, attrs, self.count["article"] + self.count["main"] > 0))
        self.open.append(len(self.names))
        self.names.append(tag)
        self.count[tag] += 1
        self.unseen += tag in UNSEEN

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in FOREIGN or any(self.count[x] for x in FOREIGN):
            self.tags += 1
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
            self.block = ""
        if (at := self.last(tag, frozenset() if tag in BLOCK else BLOCK)) >= 0:
            self.pop(at)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(data)
            if self.count["a"]:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self.end_line()

    def ends(self) -> list[int]:
        """By element, the last one inside it."""
        last = list(range(len(self.names)))
        for n in range(len(last) - 1, -1, -1):
            if (p := self.parent[n]) >= 0:
                last[p] = max(last[p], last[n])
        return last

    def beside(self) -> list[bool]:
        """By element, whether it is in a part of the page that is no article."""
        wrapper = [False] * len(self.names)
        for n in range(len(self.names) - 1, -1, -1):
            wrapper[n] = wrapper[n] or self.names[n] in ("article", "main", "h1")
            if wrapper[n] and (p := self.parent[n]) >= 0:
                wrapper[p] = True
        out: list[bool] = []
        for n, p in enumerate(self.parent):
            out.append(p >= 0 and out[p] or self.side[n] == NEVER or self.side[n] == NAMED and not wrapper[n])
        return out


KERNEL = np.exp(-0.5 * (np.arange(-WIDTH, WIDTH + 1) / SIGMA) ** 2)
KERNEL /= KERNEL.sum()


def smoothed(ratios: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(ratios, WIDTH, mode="edge"), KERNEL, "valid")


def clusters(ratios: np.ndarray) -> list[tuple[int, int]]:
    """Runs of lines whose smoothed ratio reaches the threshold."""
    high = smoothed(ratios) >= THRESHOLD * ratios.mean() * (1 - 1e-9)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], high.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def around(page: Lines, heavy: list[int], sizes: np.ndarray) -> int:
    """The element that holds the article, from the heavier lines of its cluster; -1 is the whole page. sizes: the
    characters of each line that is not beside the article."""
    at = [page.lines[i][3] for i in heavy]
    low, high, ends = min(at), max(at), page.ends()
    while low >= 0 and ends[low] < high:
        low = page.parent[low]
    while low >= 0 and page.names[low] in PIECES:
        low = page.parent[low]
    found = low
    place = np.array([x[3] for x in page.lines])
    order = np.argsort(place, kind="stable")
    place, before = place[order], np.concatenate([[0], np.cumsum(sizes[order])])
    held = lambda n: int(before[np.searchsorted(place, ends[n], "right")] - before[np.searchsorted(place, n)])
    up = low
    while up >= 0 and page.names[up] not in ("body", "html"):
        if page.names[up] in ("article", "main"):
            return up
        up = page.parent[up]
    headed = [n for n, name in enumerate(page.names) if name in ("h1", "h2")]
    up = page.parent[found] if found >= 0 else -1
    own = held(found) if found >= 0 else 0
    while up >= 0 and page.names[up] not in ("body", "html") and held(up) <= (1 + WIDEN) * own:
        if bisect_left(headed, found) > bisect_right(headed, up):
            return up
        up = page.parent[up]
    return found


def main_text(html: str) -> str:
    """The article of a page, its blocks separated by an empty line."""
    page = Lines()
    page.feed(CUT_TAG.sub("", html))
    page.close()
    lines, beside = page.lines, page.beside()
    free = [at < 0 or not beside[at] for _, _, _, at, _ in lines]
    if not any(free):
        return ""
    ratios = np.array([max(0, len(text) - linked) / (1 + tags) if ok else 0.0 for (text, tags, linked, _, _), ok in zip(lines, free, strict=True)])
    best = max(clusters(ratios) or [(0, len(lines))], key=lambda r: ratios[r[0] : r[1]].sum())
    inside = [i for i in range(*best) if free[i]] or [i for i, ok in enumerate(free) if ok]
    # the heavier lines of the cluster decide, so that a stray line at its edge doesn't widen the region
    floor = SHARE * max(ratios[i] for i in inside)
    region = around(page, [i for i in inside if ratios[i] >= floor], np.array([len(x[0]) * ok for x, ok in zip(lines, free, strict=True)]))
    last = page.ends()[region] if region >= 0 else len(page.names)
    named = region >= 0 and page.names[region] in ("article", "main")
    kept = [x for x, ok in zip(lines, free, strict=True) if ok and (region < 0 or region <= x[3] <= last)]
    return "\n\n".join(text for text, _, linked, _, block in kept if named or linked < 0.9 * len(text) or block in HEADINGS or block in ("p", "blockquote"))


def extract(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``df`` with ``out_col``, the main text, in place of the html."""
    make: Callable = lambda: lambda column: [pa.array([main_text(h) if h else "" for h in column.to_pylist()], pa.string())]
    return add_columns(df, html_col, T.StructType([T.StructField(out_col, T.StringType())]), make, drop_source=True)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
