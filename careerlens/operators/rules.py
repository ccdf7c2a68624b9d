"""Predicates, lookups and record checks (qualification of links and records)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careerlens.functions import urls
from careerlens.functions.staging import settle
from careerlens.functions.text import (
    contains_any, exists_in, hit_list, hits_of_column, matches_keywords, strip)
from careerlens.lexicon import (
    DEFAULT_LINK_CAP, MIN_DETAIL_TEXT, SNAPSHOT_TTL_SECONDS, TITLE_MAX, TITLE_MIN,
    CandidatePolicy, LinkPolicy, SiteRule)
from careerlens.operators.small_tables import array_literal, literal_table


# ------------------------------------------------------------ keyword tests

def with_matched_keywords(df: DataFrame, text: Column, keywords: str = "keywords",
                          out: str = "matched_keywords") -> DataFrame:
    """Keep rows whose text holds at least one keyword of their own array column."""
    hits = hits_of_column(F.lower(text), F.col(keywords))
    return settle(df, [c for c in df.columns if c != out], {out: hits}).filter(F.size(out) > 0)


def keyword_pairs(df: DataFrame, text: Column, keywords: Sequence[str]) -> DataFrame:
    """Containment join of rows with a keyword list: one row per actual hit.

    Only hits are generated; no product of rows and keywords is built.
    """
    lowered = df.withColumn("__low", F.lower(text))
    pairs = lowered.withColumn("keyword", F.explode_outer(hit_list("__low", keywords)))
    return pairs.filter(F.col("keyword").isNotNull()).drop("__low")


# -------------------------------------------------------------- link checks

def with_link_check(df: DataFrame, policy: LinkPolicy = LinkPolicy(), url: str = "url",
                    text: str = "anchor_text", out: str = "is_valid") -> DataFrame:
    """Keyword-scan test of a resolved address and its link text."""
    df = df.withColumn("__u", F.lower(url))
    test = ~contains_any("__u", policy.url_exclusions) & (F.length(text) >= policy.min_text)
    return settle(df, [c for c in df.columns if c not in ("__u", out)], {out: test})


def posting_links(df: DataFrame, policy: LinkPolicy = LinkPolicy(), **columns) -> DataFrame:
    return with_link_check(df, policy, out="__ok", **columns).filter("__ok").drop("__ok")


def rule_table(spark: SparkSession, rules: Sequence[SiteRule]) -> DataFrame:
    rows = [(r.company, list(r.allow_text_contains), list(r.extra_url_patterns),
             r.bypass_title_skip, r.max_links) for r in rules]
    return literal_table(
        spark, rows,
        "rule_company string, allow_text_contains array<string>, extra_url_patterns array<string>, "
        "bypass_title_skip boolean, max_links int")


def with_site_rules(df: DataFrame, rules: Sequence[SiteRule], company: str = "company") -> DataFrame:
    """Left lookup of the company's rule; companies without one get empty values."""
    if rules:
        table = rule_table(df.sparkSession, rules)
        df = df.join(table, F.col(company) == F.col("rule_company"), "left").drop("rule_company")
    else:
        df = df.withColumns({
            "allow_text_contains": array_literal(()), "extra_url_patterns": array_literal(()),
            "bypass_title_skip": F.lit(False), "max_links": F.lit(None).cast("int")})
    return df.withColumns({
        "allow_text_contains": F.coalesce("allow_text_contains", array_literal(())),
        "extra_url_patterns": F.coalesce("extra_url_patterns", array_literal(())),
        "bypass_title_skip": F.coalesce("bypass_title_skip", F.lit(False)),
    })


def with_link_cap(df: DataFrame, caps: Mapping[str, int], fallback: int | None = None,
                  company: str = "company", out: str = "link_cap") -> DataFrame:
    """Per-company cap, else the caller's, else the default."""
    base = DEFAULT_LINK_CAP if fallback is None else fallback
    if not caps:
        return df.withColumn(out, F.lit(base))
    table = literal_table(df.sparkSession, list(caps.items()), "__cc string, __cap int")
    joined = df.join(table, F.col(company) == F.col("__cc"), "left")
    return joined.withColumn(out, F.coalesce("__cap", F.lit(base))).drop("__cc", "__cap")


def _folded(df: DataFrame, url: str, text: str) -> DataFrame:
    return df.withColumns({"__u": F.lower(url), "__t": F.lower(text), "__label": F.lower(strip(F.col(text)))})


def _skips_title(policy: CandidatePolicy) -> Column:
    allowed = exists_in(F.col("__label"), F.col("allow_text_contains"))
    return (
        F.when(F.col("bypass_title_skip") | allowed, F.lit(False))
        .when(F.length("__label") < policy.min_title, F.lit(True))
        .otherwise(contains_any("__label", policy.skip_title_terms))
    )


def with_title_skip(df: DataFrame, policy: CandidatePolicy = CandidatePolicy(), text: str = "title",
                    out: str = "skip") -> DataFrame:
    """Whether a link text is clearly no title. Needs :func:`with_site_rules`."""
    keep = [c for c in df.columns if c != out]
    return settle(df.withColumn("__label", F.lower(strip(F.col(text)))), keep, {out: _skips_title(policy)})


def with_candidate_reason(df: DataFrame, policy: CandidatePolicy = CandidatePolicy(), url: str = "url",
                          text: str = "title", out: str = "reject_reason") -> DataFrame:
    """First failed test of the strict candidate check, NULL for a candidate.

    Needs the columns of :func:`with_site_rules`.
    """
    on_posting_path = (contains_any("__u", policy.posting_url_terms)
                       | exists_in(F.col("__u"), F.col("extra_url_patterns")))
    names_role = (contains_any("__t", [w.lower() for w in policy.role_terms])
                  | exists_in(F.col("__t"), F.col("allow_text_contains")))
    reason = (
        F.when(_skips_title(policy), "title")
        .when(contains_any("__u", policy.url_exclusions), "url_excluded")
        .when(contains_any("__t", policy.text_exclusions), "text_excluded")
        .when(F.col("__label").isin(*policy.button_labels), "button")
        .when(F.col("__label").isin(*policy.category_labels), "category")
        .when(~on_posting_path, "no_posting_path")
        .when(~names_role, "no_role_word")
    )
    return settle(_folded(df, url, text), [c for c in df.columns if c != out], {out: reason})


# ------------------------------------------------------------ record checks

def record_reject_reason(company: Column, title: Column, url: Column) -> Column:
    """Why a record is invalid, NULL if valid. Title length counts before trimming."""
    def missing(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    return (
        F.when(missing(company), "no_company")
        .when(missing(title), "no_title")
        .when(missing(url), "no_url")
        .when(~urls.is_absolute(url), "bad_url")
        .when(F.length(title) < TITLE_MIN, "short_title")
        .when(F.length(title) > TITLE_MAX, "long_title")
    )


def tag_records(df: DataFrame) -> DataFrame:
    """Add ``reject_reason`` to records with company, title and url."""
    return df.withColumn("reject_reason", record_reject_reason(F.col("company"), F.col("title"), F.col("url")))


def normalize_records(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Trim the three fields and add the content id (and the stamp, when given)."""
    df = df.withColumns({c: strip(F.col(c)) for c in ("title", "company", "url")})
    df = df.withColumn("id", urls.posting_id(F.col("company"), F.col("url")))
    return df if as_of is None else df.withColumn("scraped_at", as_of)


def with_payload_text(df: DataFrame) -> DataFrame:
    """Site payloads: stripped title, body falls back to it, all fields present."""
    title = strip(F.coalesce(F.col("title"), F.lit("")))
    df = df.withColumn("title", title)
    df = df.withColumn("text", F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("title")))
    return df.filter((F.coalesce(F.col("url"), F.lit("")) != "") & (F.col("title") != "") & (F.col("text") != ""))


def has_enough_text(text: Column, minimum: int = MIN_DETAIL_TEXT) -> Column:
    return F.coalesce(F.length(text) >= minimum, F.lit(False))


def site_terms(title: Column, skip_terms: Sequence[str] = (), keep_terms: Sequence[str] = (),
               fold: str = "lower", longer_than: int = 0) -> Column:
    """Skip/keep terms of one site.

    ``fold`` is 'lower', 'upper' (text is folded, terms taken as written) or
    'exact'. Titles must be longer than ``longer_than`` before trimming.
    """
    seen = {"lower": F.lower, "upper": F.upper, "exact": lambda c: c}[fold](title)
    keep = contains_any(seen, keep_terms) if keep_terms else F.lit(True)
    return ~contains_any(seen, skip_terms) & keep & (F.length(title) > longer_than)


# ---------------------------------------------------------------- selection

def select_in(df: DataFrame, **chosen: Sequence[str]) -> DataFrame:
    """Multi-select filter; an empty selection does not restrict its column."""
    for column, values in chosen.items():
        if values:
            df = df.filter(F.col(column).isin(*values))
    return df


def filter_keywords(df: DataFrame, text: str, keywords: Sequence[str]) -> DataFrame:
    return df.filter(matches_keywords(F.col(text), keywords))


def with_freshness(snapshots: DataFrame, as_of: Column, ttl: int = SNAPSHOT_TTL_SECONDS) -> DataFrame:
    """Latest snapshot per url with ``is_fresh``: age at most ``ttl`` seconds.

    The comparison keeps the sub-second part: an age of ttl plus one
    microsecond is stale.
    """
    latest = snapshots.groupBy("url").agg(F.max("fetched_at").alias("fetched_at"))
    age = F.unix_micros(as_of) - F.unix_micros(F.col("fetched_at").cast("timestamp"))
    return latest.withColumn("is_fresh", age <= F.lit(ttl * 1_000_000))


def fresh_snapshots(snapshots: DataFrame, as_of: Column, ttl: int = SNAPSHOT_TTL_SECONDS) -> DataFrame:
    return with_freshness(snapshots, as_of, ttl).filter("is_fresh").drop("is_fresh")


def expired_snapshots(snapshots: DataFrame, as_of: Column, ttl: int = SNAPSHOT_TTL_SECONDS) -> DataFrame:
    return with_freshness(snapshots, as_of, ttl).filter(~F.col("is_fresh")).drop("is_fresh")
