"""Anchor extraction without a parser: one split and one explode per page.

Exact for markup whose ``<a>`` elements are closed and not nested; the DOM
variant in :mod:`careerlens.operators.dom` has the semantics for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlens.functions.markup import (
    attribute, decode_references, joined_text, marked_text, plain_text, visible)
from careerlens.functions.staging import settle
from careerlens.functions.text import first_nonblank

_START = r"(?i)<a(?=\s)"
_ATTRS = r"""(?s)^([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>"""
_INNER_END = r"(?is)</a\s*>.*$"


def extract_anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per ``<a href>`` in document order.

    Adds ``pos``, ``href``, ``anchor_text`` (nodes joined as they stand) and
    ``anchor_title`` (nodes stripped and joined without separator, else the
    ``aria-label`` or ``title`` attribute). The page source itself is dropped.
    """
    rest = [c for c in pages.columns if c != html]
    pieces = F.split(visible(F.col(html)), _START)
    # the outer form, since a plain posexplode would split twice (once as a filter)
    rows = pages.select(*rest, F.posexplode_outer(pieces).alias("pos", "__piece")).filter("pos > 0")
    rows = rows.select(
        *rest, "pos",
        F.regexp_extract("__piece", _ATTRS, 1).alias("__attrs"),
        F.regexp_replace(F.regexp_replace("__piece", _ATTRS, ""), _INNER_END, "").alias("__inner"),
    )
    rows = settle(rows, [*rest, "pos"], {
        "__href": attribute(F.col("__attrs"), "href"),
        "__label": first_nonblank(attribute(F.col("__attrs"), "aria-label"), attribute(F.col("__attrs"), "title")),
        "__marked": marked_text(F.col("__inner")),
    }).filter(F.col("__href") != "")
    decoded = rows.select(*rest, "pos", *[
        decode_references(c).alias(c) for c in ("__href", "__label", "__marked")])
    return settle(decoded, [*rest, "pos"], {
        "href": F.col("__href"),
        "anchor_text": plain_text(F.col("__marked")),
        "anchor_title": first_nonblank(joined_text(F.col("__marked"), ""), F.col("__label")),
    })


def text_anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """Keyword-scan anchors: those with visible text."""
    return extract_anchors(pages, html).filter(F.col("anchor_text") != "").drop("anchor_title")


def titled_anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """Scored-scan anchors: those with text or a label attribute."""
    return extract_anchors(pages, html).filter(F.col("anchor_title") != "").drop("anchor_text")
