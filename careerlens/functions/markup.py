"""Native (regular expression) views of HTML text.

Tags are replaced by a separator character first, character references are
decoded next, and only then blanks are trimmed, so text nodes come out as a
parser would give them: ``MARK`` stands between two neighbouring text nodes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from careerlens.functions.text import BLANK_CLASS, strip

# Functions below travel to the workers with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "\x01"

# Comments, declarations and the content of non-text elements.
INVISIBLE = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<(script|style|template)\b.*?(?:</\1\s*>|\z)"
    r"|<[!?][^>]*>"
)
_QUOTED = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+"""
_TAG = r"(?i)</?[a-z]" + _QUOTED + r">"
_LOOSE_TAG = r"(?i)</?[a-z][^>]*>"

# The named character references of the HTML standard; some 100 old ones also count without a semicolon.
NAMED_REFERENCES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
OPEN_REFERENCES = {name: text for name, text in html5.items() if not name.endswith(";")}


@F.pandas_udf(StringType())
def _unescaped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(unescape, na_action="ignore")


def decode_references(name: str) -> Column:
    """Decode the character references of a column, each once, by the standard library's ``unescape``.

    Only texts with a ``&`` leave the JVM: a search of the whole list of names costs many times more there.
    """
    text = F.col(f"`{name}`")
    marked = F.contains(text, F.lit("&"))
    return F.when(marked, _unescaped(F.when(marked, text))).otherwise(text)


def visible(html: Column) -> Column:
    """Markup without comments, declarations, scripts, styles and templates."""
    return F.regexp_replace(html, INVISIBLE, MARK)


def marked_text(markup: Column) -> Column:
    """Text nodes of visible markup, separated by ``MARK``, references not yet decoded."""
    return F.regexp_replace(F.regexp_replace(markup, _TAG, MARK), _LOOSE_TAG, MARK)


def joined_text(marked: Column, separator: str) -> Column:
    """Every node stripped, empty ones dropped, joined by ``separator``."""
    gap = f"[{BLANK_CLASS}]*{MARK}[{MARK}{BLANK_CLASS}]*"
    edge = F.btrim(strip(marked), F.lit(MARK))
    # edges may alternate blanks and marks: collapse first, trim what is left
    flat = F.regexp_replace(edge, gap, MARK)
    return F.replace(strip(F.btrim(flat, F.lit(MARK))), F.lit(MARK), F.lit(separator))


def plain_text(marked: Column) -> Column:
    """Nodes joined as they stand, stripped as a whole."""
    return strip(F.replace(marked, F.lit(MARK), F.lit("")))


def attribute(attrs: Column, name: str) -> Column:
    """Value of one attribute in the text of a start tag, '' when absent; references
    are not yet decoded."""
    rx = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(attrs, rx, g) for g in (1, 2, 3)])
