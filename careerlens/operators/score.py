"""Relevance scoring: similarity plus ordered adjustments, clamped to [0, 1]."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlens.functions.staging import settle
from careerlens.functions.text import contains_any, first_hit, hit_count, hit_list
from careerlens.functions.vectors import cosine, norm
from careerlens.lexicon import (
    ENGINEERING_TITLE_TERMS, SITE_TEXT_THRESHOLD, SITE_TITLE_SCORE, Lexicon)

REJECTED_REQUIRED = "no_required_keyword"
REJECTED_DEAL = "deal_breaker"


def _capped(count: Column, step: float, cap: float) -> Column:
    return F.least(F.lit(cap), count * F.lit(step))


def _penalty_order(lexicon: Lexicon) -> list[tuple[str, float]]:
    ordered = list(lexicon.penalties)
    if lexicon.penalty_mode == "strongest":
        ordered.sort(key=lambda p: p[1])  # stable: list order breaks ties
    return ordered


def reject_reason(lowered: Column | str, lexicon: Lexicon) -> Column:
    """Cheap text tests that make the vector step unnecessary."""
    required = F.lit(False)
    if lexicon.required:
        # taken as written: a term with capitals never meets the lowered text
        required = ~contains_any(lowered, lexicon.required)
    broken = contains_any(lowered, [t.lower() for t in lexicon.deal_breakers])
    return F.when(required, REJECTED_REQUIRED).when(broken, REJECTED_DEAL)


def profile_vector(profile: DataFrame, column: str = "embedding") -> Column:
    """The single profile row (vector and its norm) as a scalar subquery."""
    vector = F.col(column)
    return profile.select(F.struct(vector.alias("v"), norm(vector).alias("n"))).scalar()


def with_similarity(df: DataFrame, profile: DataFrame, vec: str = "embedding",
                    out: str = "similarity", when: Column | None = None) -> DataFrame:
    """Cosine of each row's vector with the single profile vector."""
    df = df.withColumn("__p", profile_vector(profile))
    value = cosine(F.col(vec), F.col("__p.v"), F.col("__p.n"))
    return df.withColumn(out, value if when is None else F.when(when, value)).drop("__p")


def with_stages(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Add every text stage as a column of its own (``reject_reason``, boosts, penalty).

    Rejected rows carry zeros; their stages are not evaluated.
    """
    df = df.withColumn("__low", F.lower(F.col(text)))
    low = "__low"
    df = df.withColumn("reject_reason", reject_reason(low, lexicon))
    live = F.col("reject_reason").isNull()
    degree = (
        F.when(contains_any(low, lexicon.doctorate_preferred), F.lit(lexicon.doctorate_weight))
        .when(contains_any(low, lexicon.masters_preferred), F.lit(lexicon.masters_weight))
        .otherwise(F.lit(0.0))
    )
    bachelor = F.when(contains_any(low, lexicon.bachelor), F.lit(lexicon.bachelor_weight)).otherwise(0.0)
    df = df.withColumns({
        "entry_hits": F.when(live, hit_count(low, lexicon.entry_level)).otherwise(0),
        "domain_hits": F.when(live, hit_count(low, lexicon.domain)).otherwise(0),
        "__pen": F.when(live, first_hit(low, [t for t, _ in _penalty_order(lexicon)])),
        "degree": F.when(live, degree).otherwise(0.0),
        "bachelor": F.when(live, bachelor).otherwise(0.0),
        "entry_terms": F.when(live, F.slice(hit_list(low, lexicon.entry_level), 1, 2)),
    })
    ordered = _penalty_order(lexicon)
    weights = F.array(*[F.lit(w) for _, w in ordered]).cast("array<double>")
    labels = F.array(*[F.lit(t) for t, _ in ordered]).cast("array<string>")
    return df.withColumns({
        "penalty": F.coalesce(F.try_element_at(weights, F.col("__pen")), F.lit(0.0)),
        "penalty_term": F.try_element_at(labels, F.col("__pen")),
        "entry_boost": _capped(F.col("entry_hits"), lexicon.step, lexicon.entry_cap),
        "domain_boost": _capped(F.col("domain_hits"), lexicon.step, lexicon.domain_cap),
    }).drop("__low", "__pen")


def total_score(similarity: Column) -> Column:
    """Sum of the stages in their order, clamped; rejected rows score 0."""
    raw = (similarity + F.col("entry_boost") + F.col("penalty") + F.col("degree")
           + F.col("bachelor") + F.col("domain_boost"))
    clamped = F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return F.when(F.col("reject_reason").isNotNull(), F.lit(0.0)).otherwise(clamped)


def adjustments(lexicon: Lexicon) -> Column:
    """Readable list of what was added or taken, in stage order."""
    def signed(c: Column) -> Column:
        return F.format_string("%+.2f", c)

    return F.array_compact(F.array(
        F.when(F.col("entry_hits") > 0, F.concat(
            signed(F.col("entry_boost")), F.lit(" entry-level ("),
            F.array_join("entry_terms", ", "), F.lit(")"))),
        F.when(F.col("penalty_term").isNotNull(), F.concat(
            signed(F.col("penalty")), F.lit(" seniority ("), F.col("penalty_term"), F.lit(")"))),
        F.when(F.col("degree") == lexicon.doctorate_weight,
               F.concat(signed(F.col("degree")), F.lit(" PhD preferred (not required)")))
        .when(F.col("degree") == lexicon.masters_weight,
              F.concat(signed(F.col("degree")), F.lit(" Masters preferred"))),
        F.when(F.col("bachelor") != 0, F.concat(signed(F.col("bachelor")), F.lit(" bachelor's level"))),
        F.when(F.col("domain_hits") > 0, F.concat(
            signed(F.col("domain_boost")), F.lit(" keywords ("),
            F.col("domain_hits").cast("string"), F.lit(" matches)"))),
    ))


STAGE_COLUMNS = ("entry_hits", "domain_hits", "penalty", "penalty_term", "degree", "bachelor",
                 "entry_terms", "entry_boost", "domain_boost")


def score(df: DataFrame, profile: DataFrame, lexicon: Lexicon = Lexicon(), text: str = "text",
          vec: str = "embedding", explain: bool = False) -> DataFrame:
    """Add similarity, score and reject_reason (and stages with ``explain``).

    ``vec`` holds a precomputed vector. Rows without one get a NULL score unless
    the text tests already rejected them.
    """
    df = with_stages(df, lexicon, text)
    df = with_similarity(df, profile, vec, when=F.col("reject_reason").isNull())
    added = {"score": total_score(F.col("similarity"))}
    if explain:
        return settle(df, df.columns, {**added, "adjustments": adjustments(lexicon)})
    keep = [c for c in df.columns if c not in (*STAGE_COLUMNS, "reject_reason", "similarity")]
    return settle(df, keep, {n: F.col(n) for n in ("reject_reason", "similarity")} | added)


def encode_survivors(df: DataFrame, encoder, lexicon: Lexicon = Lexicon(), text: str = "text",
                     out: str = "embedding") -> DataFrame:
    """Vectors by a caller's vectorised encoder, for rows that pass the text tests.

    ``encoder`` is a pandas UDF from text to ARRAY<FLOAT>. Rejected rows are sent
    as NULL, so the costly call never sees their text; every row is kept.
    """
    reason = reject_reason(F.lower(F.col(text)), lexicon)
    df = df.withColumn("__in", F.when(reason.isNull(), F.col(text)))
    return df.withColumn(out, F.when(F.col("__in").isNotNull(), encoder(F.col("__in")))).drop("__in")


def above_threshold(df: DataFrame, threshold: float) -> DataFrame:
    return df.filter(F.col("score") >= F.lit(threshold))


def score_site_records(df: DataFrame, profile: DataFrame, lexicon: Lexicon = Lexicon(),
                       title_terms: Sequence[str] = ENGINEERING_TITLE_TERMS,
                       title_score: float = SITE_TITLE_SCORE,
                       text_threshold: float = SITE_TEXT_THRESHOLD,
                       title: str = "title", text: str = "text", vec: str = "embedding") -> DataFrame:
    """Records of trusted sites: a role title has a fixed score, others must reach
    the lower text threshold with the required stage switched off."""
    from dataclasses import replace

    scored = score(df, profile, replace(lexicon, required=()), text, vec)
    named = contains_any(F.lower(F.col(title)), title_terms)
    scored = scored.withColumn("title_hit", named)
    scored = scored.withColumn(
        "score", F.when(F.col("title_hit"), F.lit(title_score)).otherwise(F.col("score")))
    return scored.filter(F.col("title_hit") | (F.col("score") >= text_threshold))
