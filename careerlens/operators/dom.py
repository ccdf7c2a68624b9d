"""Parser-backed extraction for what needs element structure.

Spark distributes pages; the Python side is one small tree builder on the
standard library parser and a few walks over it. Rows leave as Arrow batches.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlens.functions.text import BLANK_CLASS, BLANKS, strip
from careerlens.lexicon import CONTAINER_CLASS_TERMS, CONTAINER_TAGS

# Functions and classes below travel to the workers with the task, so the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))
BLOCK = frozenset(
    "address article aside blockquote br dd div dl dt footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table tr ul".split())


class Node:
    """An element: tag, attributes, parent and children (elements or text)."""

    __slots__ = ("tag", "attrs", "parent", "children", "order")

    def __init__(self, tag, attrs, parent, order):
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.children = []

    def walk(self):
        """Elements below this one in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, tag):
        return next((n for n in self.walk() if n.tag == tag), None)

    def strings(self):
        """Visible text nodes; block boundaries are given as None."""
        stack = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if item is None or isinstance(item, str):
                yield item
            elif item.tag not in HIDDEN:
                edge = [None] if item.tag in BLOCK else []
                stack.extend(edge + list(reversed(item.children)) + edge)

    def text(self, separator="", stripped=False):
        parts = (s for s in self.strings() if s is not None)
        if stripped:
            parts = (p for p in (s.strip(BLANKS) for s in parts) if p)
        return separator.join(parts)

    def lines(self):
        """Rendered form: one line per block, blanks squeezed inside it."""
        rows, current = [], []
        for s in [*self.strings(), None]:
            if s is None:
                line = " ".join("".join(current).split())
                if line:
                    rows.append(line)
                current = []
            else:
                current.append(s)
        return "\n".join(rows)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {}, None, 0)
        self.open = [self.root]
        self.depth = Counter()  # open elements per tag
        self.count = 0

    def handle_starttag(self, tag, attrs):
        self.count += 1
        parent = self.open[-1]
        node = Node(tag, {}, parent, self.count)
        for name, value in attrs:
            node.attrs[name] = value or ""
        parent.children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.depth[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()
            self.depth[tag] -= 1

    def handle_endtag(self, tag):
        if not self.depth[tag]:
            return  # closes nothing that is open
        closed = None
        while closed != tag:
            closed = self.open.pop().tag
            self.depth[closed] -= 1

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse_page(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


# ---------------------------------------------------------------- selectors

@dataclass(frozen=True)
class Pick:
    """One alternative of an element choice: all given conditions must hold."""

    tag: str | None = None
    classes: tuple[str, ...] = ()
    contains: tuple[tuple[str, str], ...] = ()
    equals: tuple[tuple[str, str], ...] = ()
    text: str | None = None
    within: "Pick | None" = None

    def accepts(self, node: Node, text_of=Node.text) -> bool:
        """``text_of`` gives a node's text."""
        if self.tag is not None and node.tag != self.tag:
            return False
        if self.classes:
            own = node.attrs.get("class", "").split()
            if any(c not in own for c in self.classes):
                return False
        if any(v not in node.attrs.get(k, "") for k, v in self.contains):
            return False
        if any(node.attrs.get(k) != v for k, v in self.equals):
            return False
        if self.text is not None and self.text not in text_of(node):
            return False
        if self.within is None:
            return True
        up = node.parent
        while up is not None:
            if self.within.accepts(up, text_of):
                return True
            up = up.parent
        return False

    def reads_text(self) -> bool:
        return self.text is not None or self.within is not None and self.within.reads_text()


# ------------------------------------------------------------------- links

_SPAN = "struct<at:int,size:int>"
_LINK = (f"struct<pos:int,href:string,text:{_SPAN},tight:{_SPAN},parent:{_SPAN},label:string,in_container:boolean>")
_PAGE_SCHEMA = f"has_container boolean, page_text binary, page_tight binary, links array<{_LINK}>"


def _tight(text: str) -> bytes:
    return text.strip(BLANKS).encode()


def _layout(root: Node, *forms, edge: str | bytes = "") -> list[tuple]:
    """For each form (from a text node to a string or bytes) the page text in that form and the span of every element.

    ``edge`` stands at both borders of every block, in the last form only.

    The text of an element is one slice of the page text, so elements that contain each other share it. What a hidden
    element holds comes behind all else: it is in the spans of what lies inside it and in no other.
    """
    pieces: list[list] = [[] for _ in forms]
    at = [0] * len(forms)
    starts: dict[int, list[int]] = {}
    spans: list[dict[int, tuple[int, int]]] = [{} for _ in forms]
    waiting = [root]
    while waiting:
        top = waiting.pop()
        stack: list = [(top, False)]
        while stack:
            item, closing = stack.pop()
            if isinstance(item, str):
                for i, form in enumerate(forms):
                    pieces[i].append(form(item))
                    at[i] += len(pieces[i][-1])
            elif closing:
                for i, start in enumerate(starts.pop(item.order)):
                    spans[i][item.order] = (start, at[i])
                if edge and item.tag in BLOCK:
                    pieces[-1].append(edge)
                    at[-1] += len(edge)
            elif item.tag in HIDDEN and item is not top:
                waiting.append(item)
            else:
                if edge and item.tag in BLOCK:
                    pieces[-1].append(edge)
                    at[-1] += len(edge)
                starts[item.order] = list(at)
                stack.append((item, True))
                stack.extend((c, False) for c in reversed(item.children))
    return [(form("").join(p), s) for form, p, s in zip(forms, pieces, spans)]


def _page_links(root: Node, holds_links) -> tuple[list[tuple[Node, bool]], bool]:
    """Links of one page in document order, with whether each lies in a container, and whether there is one."""
    found: list[tuple[Node, bool]] = []
    inside: set[int] = set()  # elements at or below a container
    scoped = False
    for node in root.walk():
        own = holds_links(node)
        scoped = scoped or own
        if own or node.parent.order in inside:
            inside.add(node.order)
        if node.tag == "a" and "href" in node.attrs:
            found.append((node, node.parent.order in inside))
    return found, scoped


def _label(node: Node) -> str:
    return node.attrs.get("aria-label", "").strip(BLANKS) or node.attrs.get("title", "").strip(BLANKS)


def _entry(pos: int, node: Node, own: bool, spans: dict, tight_spans: dict) -> dict:
    def span(of, element):
        start, end = of[element.order]
        return {"at": start, "size": end - start}

    return {"pos": pos, "href": node.attrs["href"], "text": span(spans, node), "tight": span(tight_spans, node),
            "parent": span(spans, node.parent), "label": _label(node), "in_container": own}


def _container(tags: tuple[str, ...], terms: tuple[str, ...]):
    def holds_links(node: Node) -> bool:
        names = node.attrs.get("class", "").lower()
        return node.tag in tags and any(t in names for t in terms)

    return holds_links


def page_links(
    pages: DataFrame,
    carry: tuple[str, ...] = (),
    container_terms: tuple[str, ...] = CONTAINER_CLASS_TERMS,
    container_tags: tuple[str, ...] = CONTAINER_TAGS,
    html: str = "html",
) -> DataFrame:
    """One row per page with links: its text, once, and its links as spans of it.

    A link's own text and that of its parent are spans (first byte from 0, number of bytes in UTF-8) of ``page_text``,
    its text without blanks at the borders of text nodes one of ``page_tight``. However deep elements nest, the output
    is the page's text twice and one entry per link.
    """
    holds_links = _container(container_tags, container_terms)
    kept = ["page_id", *carry]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*kept, "has_container", "page_text", "page_tight", "links"]
        for batch in batches:
            out = []
            for *values, source in zip(*(batch[c] for c in kept), batch[html]):
                root = parse_page(source)
                links, scoped = _page_links(root, holds_links)
                if not links:
                    continue
                (text, spans), (tight, tight_spans) = _layout(root, str.encode, _tight)

                out.append((*values, scoped, text, tight, [
                    _entry(pos, node, own, spans, tight_spans) for pos, (node, own) in enumerate(links, 1)]))
            yield pd.DataFrame(out, columns=names)

    source = pages.filter(F.col(html).rlike(r"(?i)<a\s")).select(*kept, html)
    own = ", ".join(f"`{n}` {t}" for n, t in source.dtypes if n != html)
    return source.mapInPandas(run, f"{own}, {_PAGE_SCHEMA}")


def _texts() -> tuple[Column, Column]:
    """Text and title of a link, cut out of its page's texts."""
    title = F.coalesce(F.nullif(_slice("page_tight", "tight"), F.lit("")), F.col("label"))
    return strip(_slice("page_text", "text")).alias("anchor_text"), title.alias("anchor_title")


def _slice(text: str, span: str) -> Column:
    # bytes, so that a slice does not count its way through the page's characters
    return F.substring(F.col(text), F.col(f"{span}.at") + 1, F.col(f"{span}.size")).cast("string")


def _places(text: str, term: str) -> list[int]:
    found, at = [], text.find(term)
    while at >= 0:
        found.append(at)
        at = text.find(term, at + 1)
    return found


def context_links(
    pages: DataFrame,
    keywords: str = "keywords",
    carry: tuple[str, ...] = (),
    container_terms: tuple[str, ...] = CONTAINER_CLASS_TERMS,
    container_tags: tuple[str, ...] = CONTAINER_TAGS,
    html: str = "html",
) -> DataFrame:
    """Links with the keywords found in their text or the text of their parent.

    Each keyword is located once per page; a parent holds it if a place lies in the parent's span, so the search stays
    proportional to the page even where unclosed elements nest the whole page into one chain of parents.
    """

    holds_links = _container(container_tags, container_terms)
    kept = ["page_id", *carry]

    def matches(root: Node, words: list[str]):
        (text, spans), (raw, raw_spans), (tight, tight_spans) = _layout(root, str.lower, str.encode, _tight)
        terms = [(w, w.lower()) for w in words]
        places = {low: _places(text, low) for _, low in terms if low}
        longest = max((len(low) for low in places), default=0)

        def inside(low: str, start: int, end: int) -> bool:
            at = bisect_left(places[low], start)
            return at < len(places[low]) and places[low][at] + len(low) <= end

        links, scoped = _page_links(root, holds_links)
        out = []
        around: dict[int, set] = {}
        for pos, (node, own) in enumerate(links, 1):
            start, end = spans[node.parent.order]
            if node.parent.order not in around:
                around[node.parent.order] = {low for low in places if inside(low, start, end)}
            # a keyword may lie across the link text's end, a blank and the start of its surroundings
            first, last = spans[node.order]
            edge = text[max(first, last - longest - len(BLANKS)):last].rstrip(BLANKS)[-longest:] if longest else ""
            if last - first <= longest + len(BLANKS):
                edge = edge.lstrip(BLANKS)
            near = f"{edge} {text[start:min(end, start + longest)]}"
            found = [w for w, low in terms if low in around[node.parent.order] or low in near]
            out.append({**_entry(pos, node, own, raw_spans, tight_spans), "matched_keywords": found})
        return scoped, raw, tight, out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*kept, "has_container", "page_text", "page_tight", "links"]
        for batch in batches:
            out = []
            for *values, words, source in zip(*(batch[c] for c in kept), batch[keywords], batch[html]):
                found = matches(parse_page(source), [] if words is None else list(words))
                if found[-1]:
                    out.append((*values, *found))
            yield pd.DataFrame(out, columns=names)

    source = pages.filter(F.col(html).rlike(r"(?i)<a\s")).select(*kept, keywords, html)
    own = ", ".join(f"`{n}` {t}" for n, t in source.dtypes if n not in (html, keywords))
    schema = _PAGE_SCHEMA.replace(_LINK, f"{_LINK[:-1]},matched_keywords:array<string>>")
    rows = source.mapInPandas(run, f"{own}, {schema}").select("*", F.inline_outer("links"))
    return rows.select(*kept, "pos", "href", *_texts(), "in_container", "has_container", "matched_keywords")


IN_SCOPE = "in_container or not has_container"


def dom_links(pages: DataFrame, with_context: bool = True, **kwargs) -> DataFrame:
    """One row per link with the text of its parent element as context; texts are cut out of the page's one."""
    found = page_links(pages, **kwargs).select("page_id", "has_container", "page_text", "page_tight", F.inline_outer("links"))
    return found.filter(F.col("href") != "").select(
        "page_id", "has_container", *([_slice("page_text", "parent").alias("parent_text")] if with_context else []),
        "pos", "href", *_texts(), "in_container")


def scoped_links(links: DataFrame) -> DataFrame:
    """Links inside the containers of their page; all of them if it has none."""
    return links.filter(IN_SCOPE)


# ----------------------------------------------------------------- records

@dataclass(frozen=True)
class RecordRule:
    """Where one site keeps its posting cards and their parts.

    ``title=()`` takes the card itself as the link. ``text`` names the column
    kept as body: the whole card or the title alone.
    """

    site: str
    card: tuple[Pick, ...]
    title: tuple[Pick, ...] = ()
    location: tuple[Pick, ...] = ()


_CARD = (f"struct<card_pos:int,card:{_SPAN},title:{_SPAN},href:string,place:{_SPAN}>")
_RECORD_SCHEMA = f"page_id bigint, site string, url string, page_text binary, cards array<{_CARD}>"


def _flat(text: str) -> bytes:
    """A text node in which no character ends a line."""
    return text.replace("\n", " ").encode()


def _page_cards(root: Node, rule: RecordRule) -> tuple[bytes, list[dict]]:
    """Text of a page, a line feed at every border of a block, and its cards as spans of it.

    Every element is tried once for each part of the rule; a card's title is the first one among the elements that lie
    between its start and its end.
    """
    # the page's text is laid out for the rule only if it asks for texts
    asked = any(p.reads_text() for p in (*rule.card, *rule.title, *rule.location))
    *first, (text, edges) = _layout(root, *((str,) if asked else ()), _flat, edge=b"\n")
    plain, spans = first[0] if asked else ("", {})
    nodes = list(root.walk())
    last = {}  # the last element inside each element
    for node in reversed(nodes):
        last.setdefault(node.order, node.order)
        up = node.parent.order
        last[up] = max(last.get(up, up), last[node.order])

    def text_of(node: Node) -> str:
        start, end = spans[node.order]
        return plain[start:end]

    def chosen(picks) -> list[Node]:
        tags = {p.tag for p in picks}
        return [n for n in nodes if (n.tag in tags or None in tags) and any(p.accepts(n, text_of) for p in picks)]

    def first_in(card: Node, found: list[Node], orders: list[int]) -> Node | None:
        at = bisect_right(orders, card.order)
        return found[at] if at < len(found) and orders[at] <= last[card.order] else None

    def span(node: Node | None):
        if node is None:
            return None
        start, end = edges[node.order]
        return {"at": start, "size": end - start}

    cards, titles, places = chosen(rule.card), chosen(rule.title), chosen(rule.location)
    title_orders, place_orders = [n.order for n in titles], [n.order for n in places]
    out = []
    for pos, card in enumerate(cards, 1):
        head = first_in(card, titles, title_orders) if rule.title else card
        out.append({"card_pos": pos, "card": span(card), "title": span(head), "href": head.attrs.get("href") if head else None,
                    "place": span(first_in(card, places, place_orders))})
    return text, out


def _lines(span: str) -> Column:
    """Rendered form of a part of ``page_text``: one line per block, blanks squeezed inside it."""
    rows = F.transform(F.split(_slice("page_text", span), "\n"),
                       lambda line: strip(F.regexp_replace(line, f"[{BLANK_CLASS}]+", " ")))
    return F.array_join(F.filter(rows, lambda line: line != ""), "\n")


def extract_records(pages: DataFrame, rules: Mapping[str, RecordRule]) -> DataFrame:
    """Cards of every page that has a rule for its ``site``, raw and in order.

    One pass over the pages for all sites. The parser gives a page's text once and cards as spans of it, so nested
    cards do not multiply text; card, title and location texts are cut out where they are used. Cards without a link
    give ``href`` NULL. Qualification, title and body shaping are left to DataFrame operators.
    """
    chosen = dict(rules)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, site, url, html in zip(batch["page_id"], batch["site"], batch["url"], batch["html"]):
                text, cards = _page_cards(parse_page(html), chosen[site])
                if cards:
                    out.append((page_id, site, url, text, cards))
            yield pd.DataFrame(out, columns=["page_id", "site", "url", "page_text", "cards"])

    known = pages.filter(F.col("site").isin(*chosen)).select("page_id", "site", "url", "html")
    rows = known.mapInPandas(run, _RECORD_SCHEMA).select("page_id", "site", "url", "page_text", F.inline("cards"))
    return rows.select(
        "page_id", "site", "url", "card_pos", _lines("card").alias("card_text"), _lines("title").alias("title_text"), "href",
        F.coalesce(_lines("place"), F.lit("")).alias("location"))
