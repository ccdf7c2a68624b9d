"""Site extractors as plug-ins around one shared finishing step.

The built-in extractors shape the cards of one parser pass over all their sites; an extractor of one's own is a
function of pages.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlens.functions.text import contains_any, first_line_title, strip
from careerlens.functions.urls import with_record_url
from careerlens.operators.dedup import first_per_key
from careerlens.operators.dom import Pick, RecordRule, extract_records
from careerlens.operators.records import section_records, with_fallback_rows
from careerlens.operators.rules import normalize_records, site_terms, tag_records
from careerlens.session import staged
from careerlens.sources.tables import SITES

Extractor = Callable[[DataFrame], DataFrame]
#: From the cards of one site, and all pages, to records.
CardShape = Callable[[DataFrame, DataFrame], DataFrame]
NAMES = {key: name for key, name, *_ in SITES}
RECORD_COLUMNS = ("company", "title", "url", "text", "location", "ord")

# ---------------------------------------------------------------------------
# Where each known site keeps its cards, and its skip/keep terms.
# ---------------------------------------------------------------------------
COURSE_CARDS = (
    Pick(classes=("course-item",)), Pick(classes=("position-item",)),
    Pick(tag="h3", within=Pick(tag="section")), Pick(classes=("recruit-course",)),
)
COURSE_SKIP = ("ABOUT", "FAQ", "LOGIN", "ENTRY")
SECTION_CARDS = (Pick(tag="div", contains=(("class", "job"),)),)
SECTION_LINKS = (Pick(tag="a", contains=(("href", "entry"),)), Pick(tag="a", text="エントリー"))
OPENING_CARDS = (Pick(tag="div", classes=("opening",)),)
OPENING_LOCATION = (Pick(tag="span", classes=("location",)),)
OPENING_KEEP = ("engineer", "developer", "new grad", "2026", "intern")
FEED_CARDS = (Pick(tag="li", contains=(("class", "css-"),)),)
FEED_TITLES = (
    Pick(tag="a", equals=(("data-automation-id", "jobTitle"),)),
    Pick(tag="a", within=Pick(tag="h3")),
    Pick(tag="a", contains=(("class", "jobTitle"),)),
)
CARD_CARDS = (Pick(tag="div", contains=(("class", "jobCard"),)),)
CARD_TITLES = (Pick(tag="a", contains=(("class", "jobTitle"),)),)
CARD_KEEP = ("Engineer", "Research")
LIST_LINKS = (Pick(tag="a", contains=(("href", "/jobs/"), ("href", "toshiba"))),)
LIST_SKIP_TEXT = "件の検索結果"
LIST_SKIP_HREF = "www.global.toshiba"
CAREER_LINKS = (
    Pick(tag="a", contains=(("href", "recruit"),)),
    Pick(tag="a", contains=(("href", "career"),)),
    Pick(tag="a", contains=(("href", "job"),)),
)
CAREER_SKIP = ("about", "contact", "privacy", "top page", "culture", "benefits",
               "faq", "frequently", "questions", "会社概要", "よくある")
CAREER_KEEP = ("engineer", "developer", "scientist", "researcher", "recruit",
               "採用", "エンジニア", "intern", "graduate", "position")
SECTION_DEFAULT_TITLE = "Rakuten Engineering New Grad (All Positions)"
SECTION_DEFAULT_TEXT = (
    "Open recruitment for Software Engineer positions across all companies and divisions. "
    "Visit page for specific position details and requirements.")
# ------------------------------- end of fixed values ------------------------

RULES = {
    "line": RecordRule("line", COURSE_CARDS, (Pick(tag="a"),)),
    "rakuten": RecordRule("rakuten", SECTION_CARDS, SECTION_LINKS),
    "mercari": RecordRule("mercari", OPENING_CARDS, (Pick(tag="a"),), OPENING_LOCATION),
    "woven": RecordRule("woven", OPENING_CARDS, (Pick(tag="a"),), OPENING_LOCATION),
    "sony": RecordRule("sony", FEED_CARDS, FEED_TITLES),
    "bytedance": RecordRule("bytedance", CARD_CARDS, CARD_TITLES),
    "toshiba": RecordRule("toshiba", LIST_LINKS),
    "preferred": RecordRule("preferred", CAREER_LINKS),
}


def _shape(cards: DataFrame, key: str, title, text, location=None, resolve: bool = True) -> DataFrame:
    linked = cards.withColumnRenamed("url", "page_url")
    linked = (with_record_url(linked, "href", "page_url", "url") if resolve
              else linked.withColumn("url", F.col("href")))
    return linked.select(
        F.lit(NAMES[key]).alias("company"), title.alias("title"), "url", text.alias("text"),
        (F.lit("") if location is None else location).alias("location"),
        F.struct("page_id", F.col("card_pos")).alias("ord"))


def _course(cards: DataFrame, pages: DataFrame) -> DataFrame:
    cards = cards.filter(F.col("href").isNotNull())
    cards = cards.filter(~contains_any(F.upper("card_text"), COURSE_SKIP))
    title = strip(F.split_part("card_text", F.lit("\n"), F.lit(1)))
    return _shape(cards, "line", title, F.col("card_text")).filter(F.length("title") > 5)


def _section(cards: DataFrame, pages: DataFrame) -> DataFrame:
    linked = with_record_url(
        cards.withColumn("href", F.coalesce("href", F.lit(""))), "href", "url", "entry_url")
    rows = section_records(linked, text="card_text", entry_url="entry_url").select(
        F.lit(NAMES["rakuten"]).alias("company"), "title", "url", "text",
        F.lit("").alias("location"), F.struct("page_id", "card_pos").alias("ord"))
    here = pages.filter(F.col("site") == "rakuten").select(
        F.lit(NAMES["rakuten"]).alias("company"), "url", "page_id")
    default = with_fallback_rows(
        here, rows, F.lit(SECTION_DEFAULT_TITLE), F.lit(SECTION_DEFAULT_TEXT)).filter("is_fallback")
    return rows.unionByName(default.select(
        "company", "title", "url", "text", F.lit("").alias("location"),
        F.struct(F.lit(0).cast("bigint").alias("page_id"), F.lit(0).alias("card_pos")).alias("ord")))


def _opening(key: str) -> CardShape:
    def run(cards: DataFrame, pages: DataFrame) -> DataFrame:
        cards = cards.filter(F.col("href").isNotNull())
        cards = cards.filter(site_terms(F.col("title_text"), keep_terms=OPENING_KEEP))
        body = F.concat_ws(" - ", "title_text", "location")
        return _shape(cards, key, F.col("title_text"), body, F.col("location"))

    return run


def _feed(cards: DataFrame, pages: DataFrame) -> DataFrame:
    cards = cards.filter((F.col("title_text") != "") & (F.col("href") != ""))
    return _shape(cards, "sony", strip(F.col("title_text")), F.substring("card_text", 1, 300))


def _card(cards: DataFrame, pages: DataFrame) -> DataFrame:
    cards = cards.filter(
        site_terms(F.col("title_text"), keep_terms=CARD_KEEP, fold="exact"))
    # links of this site are absolute; a relative one fails validation
    return _shape(cards, "bytedance", F.col("title_text"), F.col("card_text"), resolve=False)


def _list(cards: DataFrame, pages: DataFrame) -> DataFrame:
    cards = cards.filter(F.length("card_text") >= 20)
    cards = cards.filter(~F.contains("card_text", F.lit(LIST_SKIP_TEXT))
                         & ~F.contains("href", F.lit(LIST_SKIP_HREF)))
    return _shape(cards, "toshiba", first_line_title(F.col("card_text")), F.substring("card_text", 1, 300))


def _career(cards: DataFrame, pages: DataFrame) -> DataFrame:
    cards = cards.filter(F.col("href") != "")
    cards = cards.filter(site_terms(F.col("title_text"), CAREER_SKIP, CAREER_KEEP, longer_than=10))
    return _shape(cards, "preferred", strip(F.col("title_text")), F.col("title_text"))


SHAPES: dict[str, CardShape] = {
    "line": _course,
    "rakuten": _section,
    "bytedance": _card,
    "sony": _feed,
    "mercari": _opening("mercari"),
    "woven": _opening("woven"),
    "preferred": _career,
    "toshiba": _list,
}


def _alone(key: str, pages: DataFrame) -> DataFrame:
    return SHAPES[key](extract_records(pages, {key: RULES[key]}), pages)


REGISTRY: dict[str, Extractor] = {key: partial(_alone, key) for key in SHAPES}
BUILT_IN = dict(REGISTRY)
course_site, section_site, feed_site, card_site, list_site, career_site = (
    BUILT_IN[k] for k in ("line", "rakuten", "sony", "bytedance", "toshiba", "preferred"))


def opening_site(key: str) -> Extractor:
    return BUILT_IN[key]


def register(key: str, extractor: Extractor, name: str | None = None) -> None:
    """Add or replace a site extractor: pages(page_id, site, url, html) to
    ``RECORD_COLUMNS``; ``ord`` is any orderable position."""
    REGISTRY[key] = extractor
    NAMES[key] = name or key


def finish(raw: DataFrame, order=("ord",)) -> DataFrame:
    """What every extractor's output goes through: validate, trim, one per url."""
    valid = tag_records(raw).filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return first_per_key(normalize_records(valid), ["company", "url"], list(order))


def run_all(pages: DataFrame, extractors: Mapping[str, Extractor] | None = None) -> DataFrame:
    """Union of all finished site outputs, with the site key and its place.

    Built-in extractors share one scan of the pages and one parser stage, whose cards are written once.
    """
    chosen = REGISTRY if extractors is None else extractors
    shared = [key for key, extractor in chosen.items() if BUILT_IN.get(key) is extractor]
    cards = staged(extract_records(pages, {key: RULES[key] for key in shared}), "cards") if len(shared) > 1 else None
    out = None
    for number, (key, extractor) in enumerate(chosen.items()):
        raw = SHAPES[key](cards.filter(F.col("site") == key), pages) if cards is not None and key in shared else extractor(pages)
        rows = finish(raw).select(
            "company", "title", "url", "text", "location", "id", F.lit(key).alias("site"),
            F.lit(number).alias("site_no"), F.col("ord"))
        out = rows if out is None else out.unionByName(rows)
    return out
