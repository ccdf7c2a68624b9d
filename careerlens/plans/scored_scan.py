"""Scored scan: candidate links, detail pages, relevance score, store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlens.functions.urls import with_joined_url
from careerlens.lexicon import CandidatePolicy, SiteRule, SourcePolicy
from careerlens.operators.anchors import titled_anchors
from careerlens.operators.dedup import cap_per_key, drop_seen, first_per_key
from careerlens.operators.main_text import main_text
from careerlens.operators.records import snippet
from careerlens.operators.rules import (
    has_enough_text, with_candidate_reason, with_link_cap, with_site_rules)
from careerlens.operators.score import above_threshold, score
from careerlens.session import staged


def link_candidates(pages: DataFrame, policy: CandidatePolicy = CandidatePolicy(),
                    rules: Sequence[SiteRule] = ()) -> DataFrame:
    """First qualifying anchor per company and address.

    Input ``pages(page_id, company, page_url, html)``.
    """
    links = with_joined_url(titled_anchors(pages), "href", "page_url", "url")
    links = with_site_rules(links, rules)
    links = with_candidate_reason(links, policy, text="anchor_title").filter(F.col("reject_reason").isNull())
    kept = first_per_key(links, ["company", "url"], ["page_id", "pos"])
    return kept.select("company", "page_id", "pos", F.col("anchor_title").alias("title"), "url")


def capped_candidates(candidates: DataFrame, caps: Mapping[str, int] | None = None,
                      fallback: int = 30) -> DataFrame:
    """Per-company cap in document order, before anything seen is removed."""
    caps = dict(caps or {})
    df = with_link_cap(candidates, caps, fallback)
    highest = max([fallback, *caps.values()])
    return cap_per_key(df, ["company"], ["page_id", "pos"], "link_cap", highest).drop("link_cap")


def with_details(candidates: DataFrame, details: DataFrame, **text_args) -> DataFrame:
    """Join surviving links with their detail pages and keep those with enough text.

    ``details`` holds one page per url (the latest snapshot). The detail text is
    extracted after the join, only for pages that are needed.
    """
    found = candidates.join(details.select("url", F.col("html"), "embedding"), "url")
    found = main_text(found, "html", "text").drop("html")
    return found.filter(has_enough_text(F.col("text"), **text_args))


def score_details(details: DataFrame, profile: DataFrame, policy: SourcePolicy, carry: Sequence[str] = ()) -> DataFrame:
    """Matches: scored details at or above the threshold, with the ``carry`` columns."""
    scored = above_threshold(score(details, profile, policy.lexicon), policy.threshold)
    return scored.select(
        "company", "title", "url", F.col("score").alias("match_score"), snippet(F.col("text")).alias("snippet"), *carry)


def link_list(listing: DataFrame, policy: CandidatePolicy = CandidatePolicy(), rules: Sequence[SiteRule] = (),
              cap: int = 30) -> DataFrame:
    """The links of a scan: candidates of every company up to its cap."""
    caps = {r.company: r.max_links for r in rules if r.max_links is not None}
    return capped_candidates(link_candidates(listing, policy, rules), caps, cap)


def detail_matches(links: DataFrame, details: DataFrame, profile: DataFrame, source: SourcePolicy,
                   carry: Sequence[str] = ()) -> DataFrame:
    """Links with their detail pages, scored.

    The links, a bounded number per company, are written first: with their size known, they are sent to the details
    where that is small enough, and the pages of details stay where they are.
    """
    return score_details(with_details(staged(links, "links"), details), profile, source, carry)


def scan(listing: DataFrame, details: DataFrame, seen: DataFrame, profile: DataFrame,
         source: SourcePolicy = SourcePolicy(), policy: CandidatePolicy = CandidatePolicy(),
         rules: Sequence[SiteRule] = ()) -> DataFrame:
    """Whole flow for one kind of source."""
    links = link_list(listing, policy, rules, source.link_cap)
    return detail_matches(drop_seen(links, seen), details, profile, source)


def all_phases(**phases: DataFrame) -> DataFrame:
    """Union of phase outputs with the phase name and its place in the order."""
    out = None
    for number, (name, df) in enumerate(phases.items()):
        tagged = df.withColumns({"phase": F.lit(name), "phase_no": F.lit(number)})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
