"""Text Column helpers. All of them are built-in JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blank characters removed at both ends, wider than SQL ``trim`` (U+0020 only).
BLANKS = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
BLANK_CLASS = (
    r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def strip(text: Column) -> Column:
    """Remove every Unicode blank at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def blank_to_null(text: Column) -> Column:
    """Stripped text, NULL when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def first_nonblank(*texts: Column) -> Column:
    """First of several sources that is not blank; '' when all are."""
    return F.coalesce(*[blank_to_null(t) for t in texts], F.lit(""))


def quoted(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _contains(text: str, term: str) -> str:
    return f"contains(`{text}`, {quoted(term)})"


def contains_any(text: Column | str, terms: Sequence[str]) -> Column:
    """True when ``text`` holds one of ``terms`` exactly as written.

    A column name gives the same expression as a Column, built in one call;
    prefer it for long lists.
    """
    if not terms:
        return F.lit(False)
    if isinstance(text, str):
        return F.expr(" or ".join(_contains(text, t) for t in terms))
    return reduce(or_, [text.contains(t) for t in terms])


def matches_keywords(text: Column, terms: Sequence[str]) -> Column:
    """Case-blind containment of any term; an empty list accepts everything."""
    if not terms:
        return F.lit(True)
    return contains_any(F.lower(text), [t.lower() for t in terms])


def hit_count(lowered: str, terms: Sequence[str]) -> Column:
    """How many of ``terms`` (case-blind) occur in an already lowered column."""
    if not terms:
        return F.lit(0)
    return F.expr(" + ".join(f"cast({_contains(lowered, t.lower())} as int)" for t in terms))


def hit_list(lowered: str, terms: Sequence[str]) -> Column:
    """The terms found in an already lowered column, in list order and case."""
    if not terms:
        return F.array().cast("array<string>")
    tests = ", ".join(f"if({_contains(lowered, t.lower())}, {quoted(t)}, null)" for t in terms)
    return F.expr(f"array_compact(array({tests}))")


def first_hit(lowered: str, terms: Sequence[str]) -> Column:
    """1-based place of the first of ``terms`` found, NULL when there is none."""
    if not terms:
        return F.lit(None).cast("int")
    tests = " ".join(f"when {_contains(lowered, t.lower())} then {i}" for i, t in enumerate(terms, 1))
    return F.expr(f"case {tests} end")


def hits_of_column(lowered: Column, terms: Column) -> Column:
    """As :func:`hit_list` for terms held in an array column."""
    return F.filter(terms, lambda t: F.contains(lowered, F.lower(t)))


def exists_in(lowered: Column, terms: Column) -> Column:
    """True when an array column holds a term that occurs as written."""
    return F.coalesce(F.exists(terms, lambda t: F.contains(lowered, t)), F.lit(False))


def bounded(text: Column, n: int) -> Column:
    """First ``n`` characters, then stripped (this order matters)."""
    return strip(F.substring(text, 1, n))


def first_line_title(text: Column, min_length: int = 10, fallback: int = 80) -> Column:
    """First line as title; a short one is replaced by the start of the text."""
    line = strip(F.split_part(text, F.lit("\n"), F.lit(1)))
    return F.when(F.length(line) < min_length, bounded(text, fallback)).otherwise(line)


def safe_key(text: Column) -> Column:
    """File-name safe form: word characters, blanks as underscores."""
    kept = F.regexp_replace(text, r"(?U)[^\w\s-]", "")
    return F.replace(strip(kept), F.lit(" "), F.lit("_"))


def document_key(company: Column, role: Column, at: Column) -> Column:
    """``company_role_yyyyMMdd_HHmmss`` with both names made safe."""
    return F.concat_ws("_", safe_key(company), safe_key(role), F.date_format(at, "yyyyMMdd_HHmmss"))
