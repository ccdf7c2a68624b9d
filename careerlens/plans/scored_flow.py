"""The scored scan through to the store: site records, listed links and boards in one order.

Phases run in the order they are given; within a phase sources come by ``source_no`` and rows by ``ord``. What is stored is
left out before anything is scored, and over all phases the first match of a url wins, whichever company it is of.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlens.lexicon import ENGINEERING_TITLE_TERMS, CandidatePolicy, Lexicon, SourcePolicy
from careerlens.operators import store
from careerlens.operators.dedup import dedup_by_url
from careerlens.operators.records import snippet
from careerlens.operators.rules import with_payload_text
from careerlens.operators.score import score_site_records
from careerlens.plans.scored_scan import all_phases, detail_matches, link_list

#: Drops the rows whose ``url`` is stored already.
Unseen = Callable[[DataFrame], DataFrame]
MATCH_COLUMNS = ("company", "title", "url", "match_score", "snippet", "source_no", "ord")


@dataclass(frozen=True)
class FlowPolicy:
    """How each phase is scored. ``listings`` has a policy per kind of listing page, in the order of the phases."""

    listings: Mapping[str, SourcePolicy] = field(default_factory=lambda: {"generic": SourcePolicy()})
    candidates: CandidatePolicy = CandidatePolicy()
    rules: tuple = ()
    site_lexicon: Lexicon = field(default_factory=Lexicon)
    site_title_terms: tuple[str, ...] = ENGINEERING_TITLE_TERMS


def site_matches(records: DataFrame, unseen: Unseen, profile: DataFrame, lexicon: Lexicon = Lexicon(),
                 title_terms: tuple[str, ...] = ENGINEERING_TITLE_TERMS) -> DataFrame:
    """Matches among the records of site extractors (company, title, url, text, source_no, ord[, embedding]).

    Rows without url, title or text go first, then what is stored; a role title has a fixed score, other records need
    the lower threshold of site texts.
    """
    if "embedding" not in records.columns:
        records = records.withColumn("embedding", F.lit(None).cast("array<float>"))
    rows = unseen(with_payload_text(records))
    scored = score_site_records(rows, profile, lexicon, title_terms)
    return scored.select(F.coalesce("company", F.lit("Unknown")).alias("company"), "title", "url",
                         F.col("score").alias("match_score"), snippet(F.col("text")).alias("snippet"), "source_no", "ord")


def listing_matches(listing: DataFrame, details: DataFrame, unseen: Unseen, profile: DataFrame, source: SourcePolicy,
                    policy: FlowPolicy) -> DataFrame:
    """Matches of listing pages (page_id, company, page_url, html, source_no) with their detail pages."""
    numbers = listing.groupBy("company").agg(F.min("source_no").alias("source_no"))
    links = unseen(link_list(listing, policy.candidates, policy.rules, source.link_cap))
    found = detail_matches(links, details, profile, source, carry=("page_id", "pos"))
    return found.join(numbers, "company").select(
        "company", "title", "url", "match_score", "snippet", "source_no", F.struct("page_id", "pos").alias("ord"))


def scan_matches(records: DataFrame | None, listings: Mapping[str, DataFrame], details: DataFrame, unseen: Unseen,
                 profile: DataFrame, policy: FlowPolicy = FlowPolicy()) -> DataFrame:
    """Matches of all phases with ``phase`` and ``phase_no``, before the first of each url is chosen."""
    phases = {}
    if records is not None:
        phases["sites"] = site_matches(records, unseen, profile, policy.site_lexicon, policy.site_title_terms)
    for kind, source in policy.listings.items():
        if kind in listings:
            phases[kind] = listing_matches(listings[kind], details, unseen, profile, source, policy)
    return all_phases(**phases)


def first_matches(matches: DataFrame) -> DataFrame:
    """The first match of every url over all phases."""
    return dedup_by_url(matches, ["phase_no", "source_no", "ord", "company"])


def match_postings(matches: DataFrame, found: Column) -> DataFrame:
    """Matches as postings: the score in place of keywords, score line and snippet as notes."""
    none = F.array().cast("array<string>")
    return store.as_postings(
        matches.withColumn("text", F.lit(None).cast("string")), found, matched=none, score=F.col("match_score"),
        notes=store.score_notes(F.col("match_score"), F.col("snippet")))


def save_scan(matches: DataFrame, root: str, run_id: str, found: Column) -> tuple[DataFrame, dict[str, int]]:
    """Store a run's matches; returns the inserted postings and their counts.

    ``matches``: urls with a match, ``added``: new ones, ``duplicates``: the rest.
    """
    spark = matches.sparkSession
    return store.insert_counted(spark, root, match_postings(first_matches(matches), found), run_id)
