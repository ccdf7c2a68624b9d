"""Keyword scan: listing pages to new postings, alerts and run log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlens.functions.staging import settle
from careerlens.functions.text import hits_of_column
from careerlens.functions.urls import with_clean_url
from careerlens.lexicon import LinkPolicy
from careerlens.operators.anchors import text_anchors
from careerlens.operators.dedup import first_per_key
from careerlens.operators.dom import context_links, scoped_links
from careerlens.operators.rules import posting_links


def pages_of_targets(pages: DataFrame, targets: DataFrame, on: str = "site") -> DataFrame:
    """Equi-join of landed pages with their target (side table without a hint:
    the optimizer broadcasts it when its size allows)."""
    return pages.join(targets, on)


def _first_matches(links: DataFrame) -> DataFrame:
    """First qualifying anchor per site and address, in page and link order."""
    kept = links.filter(F.size("matched_keywords") > 0)
    return first_per_key(kept, ["company", "url"], ["page_id", "pos"])


def native_matches(pages: DataFrame, policy: LinkPolicy = LinkPolicy()) -> DataFrame:
    """Matches of ``pages(page_id, company, page_url, keywords, html)``, link text only."""
    links = text_anchors(pages)
    links = with_clean_url(links, "href", "page_url", "url").filter(F.col("url").isNotNull())
    links = posting_links(links, policy)
    links = settle(links, links.columns, {
        "matched_keywords": hits_of_column(F.lower("anchor_text"), F.col("keywords"))})
    return _first_matches(links).select(
        "company", "page_id", "pos", F.col("anchor_text").alias("title"), "url", "matched_keywords")


def context_matches(pages: DataFrame, policy: LinkPolicy = LinkPolicy(), **container) -> DataFrame:
    """Matches with container scope and the text around each link."""
    links = context_links(pages, "keywords", ("company", "page_url"), **container)
    links = scoped_links(links).filter((F.col("anchor_text") != "") & (F.col("href") != ""))
    links = links.filter(F.size("matched_keywords") > 0)
    links = with_clean_url(links, "href", "page_url", "url").filter(F.col("url").isNotNull())
    return _first_matches(posting_links(links, policy)).select(
        "company", "page_id", "pos", F.col("anchor_text").alias("title"), "url", "matched_keywords")


def matches_per_site(matches: DataFrame) -> DataFrame:
    return matches.groupBy("company").agg(F.count("*").alias("n"))


def run_rows(targets: DataFrame, outcomes: DataFrame, inserted: DataFrame, at: Column,
             missing: str | None = None) -> DataFrame:
    """Run-log rows: one per company of ``targets(site, company)`` with its newly stored postings.

    ``outcomes(site, status, error_message)`` are those of :func:`fetch_outcomes`. A company is successful when one
    of its sites is. Targets without an outcome get an error row with the text ``missing``, or no row without it.
    """
    counts = inserted.groupBy(F.col("company").alias("__c")).agg(F.count("*").alias("__n"))
    mine = targets.select("site", "company").join(outcomes, "site", "inner" if missing is None else "left")
    mine = mine.groupBy("company").agg(
        F.coalesce(F.bool_or(F.col("status") == "Success"), F.lit(False)).alias("__ok"),
        F.min(F.coalesce("error_message", F.lit(missing))).alias("__message"))
    return mine.join(counts, F.col("company") == F.col("__c"), "left").select(
        at.cast("timestamp").alias("ts"), "company",
        F.when(F.col("__ok"), "Success").otherwise("Error").alias("status"),
        F.coalesce("__n", F.lit(0)).cast("int").alias("postings_found"),
        F.when(~F.col("__ok"), F.col("__message")).alias("error_message"))


def fetch_outcomes(pages: DataFrame) -> DataFrame:
    """Outcome per site of landed pages: a row with a ``fetch_error`` is a failed fetch, every other one a page."""
    error = F.col("fetch_error") if "fetch_error" in pages.columns else F.lit(None).cast("string")
    found = pages.groupBy("site").agg(
        F.bool_or(error.isNull()).alias("__ok"), F.min(error).alias("__message"))
    return found.select(
        "site", F.when(F.col("__ok"), "Success").otherwise("Error").alias("status"),
        F.when(~F.col("__ok"), F.col("__message")).alias("error_message"))
