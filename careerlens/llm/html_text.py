"""Main text of web pages by smoothed text-to-tag ratios.

The standard library's parser is fed the page in pieces, and its events are gathered into lines: one per block element,
with its text and the number of tags since the line before. Elements that hold no article text by their kind (menus,
headers and footers of a page, sidebars, forms, scripts, styles), or that a class, id or role names as such (adverts,
notices, comments), count towards tags and give no line. A name counts only as a whole: every word of it must be a mark
or a filler, with one mark at least, so ``comment-list`` is dropped and ``share-price`` is not. The ratio of a line is its
characters per tag. Ratios are smoothed by a Gaussian window, and lines are clustered by a threshold, the standard
deviation of the smoothed ratios: a container's lines are kept if their mean reaches it, or if they lie between kept
lines of the same parent. The best container is always kept.

Where a page has an ``article`` or ``main`` element with text, all lines inside such elements are kept and none
outside; ratios only find the content of pages without one. Character references are decoded; white space inside a
block becomes one space, ``br`` included; blocks are joined in page order by a line feed. Null and empty pages give an
empty text, as do pages without text outside such elements. Elements that are never closed end with the page or with
the element around them. Very long pages are read whole, in time proportional to their length. Repeated rows give a row
each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import collections
import functools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlens.llm.common import columns

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead title tr ul""".split())
#: Elements without article text.
SKIPPED = frozenset("""head nav footer aside form script style noscript template iframe object svg canvas button select
textarea input menu dialog title""".split())
#: Words of a class, id or role that mark such elements.
MARKS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies
consent notice notices alert popup modal newsletter subscribe subscription nav navigation navbar menu breadcrumb breadcrumbs
sidebar sidenav footer masthead comment comments reply replies respond responses discussion disqus share sharing social
related recommended recommendations login signup complementary contentinfo search widget""".split())
#: Words that mark them outside of an article only.
OUTER_MARKS = frozenset("header side".split())
#: Words that may stand beside a mark in one name.
FILLERS = frozenset("""area bar bars block body bottom box button buttons center col column container content footer form global
group header holder icons inner item items left link links list main modal of page panel policy popular post posts primary
right secondary section site slot small story stories sub thread title top unit widget widgets wrap wrapper article articles
""".split())
CONTENT = frozenset(["article", "main"])
#: Elements that a new block of the given kind closes when they are open.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
BOUNDS = frozenset("ul ol dl table div article main section body td th".split())
CLOSED = BOUNDS.union(*CLOSES.values())
CONTAINERS = frozenset("div article main section td".split())
CHUNK = 1 << 16
RADIUS = 2
SIGMA = 1.0
SPACE = re.compile(r"\s+")


@functools.lru_cache(4096)
def names_boilerplate(name: str, inside: bool) -> bool:
    """Whether one class, id or role, as a whole, is that of an element without article text."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
    marks = MARKS if inside else MARKS | OUTER_MARKS
    return not marks.isdisjoint(words) and all(w in marks or w in FILLERS for w in words)


def marked(tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> bool:
    """Whether an element holds no article text. A header inside an article may hold its title."""
    if tag in SKIPPED or tag == "header" and not inside:
        return True
    if tag in ("main", "body", "html"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id", "role") and value and any(names_boilerplate(x, inside) for x in value.split()):
            return True
    return False


class Lines(HTMLParser):
    """Parser events to lines (text, tags since the line before, container, inside article or main).

    ``closable`` has the places of those open elements that end others or are ended by them, so that neither start nor
    end tags search all open elements.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []
        self.counts: collections.Counter[str] = collections.Counter()
        self.closable: list[int] = []
        self.skipping = self.inside = self.tags = self.container = 0
        self.parents = [0]
        self.parts: list[str] = []
        self.lines: list[tuple[str, int, int, bool]] = []

    def end_line(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            self.parts = []
            if text:
                self.lines.append((text, max(1, self.tags), self.container, self.inside > 0))
                self.tags = 0

    def pop(self) -> str:
        tag, skipped, container = self.open.pop()
        if tag in BLOCKS or skipped:
            self.end_line()
        if self.closable and self.closable[-1] == len(self.open):
            self.closable.pop()
        self.counts[tag] -= 1
        self.skipping -= skipped
        self.inside -= tag in CONTENT
        self.container = container
        return tag

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self.end_line()
            if tag not in ("body", "html"):
                self.close_to(("p",))
        if tag in CLOSES:
            self.close_to(CLOSES[tag])
        if tag in VOID:
            return
        skipped = marked(tag, attrs, self.inside > 0)
        if skipped:
            self.end_line()
        self.open.append((tag, skipped, self.container))
        if tag in CLOSED:
            self.closable.append(len(self.open) - 1)
        self.counts[tag] += 1
        self.skipping += skipped
        self.inside += tag in CONTENT
        if tag in CONTAINERS:
            self.parents.append(self.container)
            self.container = len(self.parents) - 1

    def close_to(self, kinds: tuple[str, ...]) -> None:
        """Close the innermost open element of these kinds, unless a container lies between."""
        for at in reversed(self.closable):
            tag = self.open[at][0]
            if tag in kinds:
                while len(self.open) > at:
                    self.pop()
                return
            if tag in BOUNDS:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.counts[tag] > 0:
            while self.pop() != tag:
                pass
        elif tag in BLOCKS:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)


def page_lines(html: str) -> tuple[list[tuple[str, int, int, bool]], list[int]]:
    """Lines of a page and the parent of each container."""
    parser = Lines()
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at:at + CHUNK])
    parser.close()
    parser.end_line()
    return parser.lines, parser.parents


def smoothed(ratios: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    """Weighted means over a Gaussian window, cut at the ends."""
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma ** 2))
    full = lambda x: np.convolve(x, kernel)[radius:radius + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def kept_lines(ratios: np.ndarray, containers: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Which lines belong to the content, by their smoothed ratios."""
    count = np.bincount(containers, minlength=len(parents))
    mean = np.bincount(containers, weights=ratios, minlength=len(parents)) / np.maximum(count, 1)
    kept = mean[containers] >= min(ratios.std(), mean.max())
    # what lies between kept lines of one parent, in the parent itself or in a container of it
    first, last = np.full(len(parents), len(kept)), np.full(len(parents), -1)
    at = np.flatnonzero(kept)
    for of in (containers[at], parents[containers[at]]):
        np.minimum.at(first, of, at)
        np.maximum.at(last, of, at)
    every = np.arange(len(kept))
    for of in (containers, parents[containers]):
        kept |= (every > first[of]) & (every < last[of])
    return kept


def main_text(html: str | None) -> str:
    lines, parents = page_lines(html or "")
    if any(inside for *_, inside in lines):
        return "\n".join(text for text, _, _, inside in lines if inside)
    if not lines:
        return ""
    ratios = smoothed(np.array([len(text) / tags for text, tags, _, _ in lines]))
    kept = kept_lines(ratios, np.array([c for _, _, c, _ in lines]), np.array(parents))
    return "\n".join(line[0] for line, keep in zip(lines, kept) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    rows = columns(pages, page_id=id_col, url=url_col, html=html_col)
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
