"""Shaping of extracted cards and blocks into posting records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlens.functions.staging import settle
from careerlens.functions.text import bounded, contains_any, strip
from careerlens.functions.urls import section_url
from careerlens.lexicon import SectionPolicy
from careerlens.operators.dedup import first_per_key


def with_section_title(blocks: DataFrame, policy: SectionPolicy = SectionPolicy(),
                       text: str = "text", out: str = "section_title") -> DataFrame:
    """Title of a posting block from its first lines; blocks without one go.

    Lines are read until a role line and a division line have both been seen;
    among the lines read, the last of each kind counts.
    """
    body = F.col(text)
    df = blocks.filter(contains_any(body, policy.markers) & (F.length(body) >= policy.min_text))
    lines = F.transform(F.slice(F.split(body, "\n"), 1, policy.lines), strip)

    def is_role(line: Column) -> Column:
        return contains_any(line, policy.roles)

    def is_division(line: Column) -> Column:
        return (~is_role(line) & contains_any(line, policy.divisions)
                & (F.length(line) < policy.division_max))

    df = df.withColumn("__lines", lines)
    df = settle(df, df.columns, {
        "__role_at": F.array_position(F.transform("__lines", is_role), True),
        "__div_at": F.array_position(F.transform("__lines", is_division), True),
    })
    both = (F.col("__role_at") > 0) & (F.col("__div_at") > 0)
    upto = F.when(both, F.greatest("__role_at", "__div_at").cast("int")).otherwise(policy.lines)
    df = df.filter(F.col("__role_at") > 0).withColumn("__read", F.slice("__lines", F.lit(1), upto))
    title = F.element_at(F.filter("__read", is_role), -1)
    division = F.try_element_at(F.filter("__read", is_division), F.lit(-1))
    full = F.when(division.isNotNull(), F.concat(division, F.lit(" - "), title)).otherwise(title)
    return df.withColumn(out, full).drop("__lines", "__role_at", "__div_at", "__read")


def section_records(blocks: DataFrame, policy: SectionPolicy = SectionPolicy(), page: str = "page_id",
                    page_url: str = "url", order: str = "card_pos", text: str = "text",
                    entry_url: str | None = None) -> DataFrame:
    """Posting blocks of one-page boards: titled, one per title and page, with a
    link of their own or one made from the title."""
    df = with_section_title(blocks, policy, text)
    df = first_per_key(df, [page, "section_title"], [order])
    made = section_url(F.col(page_url), F.col("section_title"))
    address = made if entry_url is None else F.coalesce(F.nullif(F.col(entry_url), F.lit("")), made)
    return df.select(
        page, order,
        F.substring("section_title", 1, 100).alias("title"),
        address.alias("url"),
        strip(F.replace(F.substring(text, 1, 500), F.lit("\n"), F.lit(" "))).alias("text"),
    )


def snippet(text: Column) -> Column:
    """Opening characters kept beside a match."""
    return bounded(text, 250)


def with_fallback_rows(sites: DataFrame, records: DataFrame, title: Column, text: Column,
                       key: str = "company") -> DataFrame:
    """Records plus one default row for every site that gave none."""
    empty = sites.join(records.select(key).distinct(), key, "left_anti")
    default = empty.select(
        F.col(key), title.alias("title"), F.col("url"), text.alias("text"), F.lit(True).alias("is_fallback"))
    found = records.select(key, "title", "url", "text", F.lit(False).alias("is_fallback"))
    return found.unionByName(default)
