"""Ranking of a candidate's skills and projects against postings.

The candidate side is one person's list and is typed in by the caller, so it is
carried as constants in the plan; the postings side is never shuffled for it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerlens.functions.text import hit_list
from careerlens.operators.dedup import top_per_key
from careerlens.operators.small_tables import array_literal, skew_safe_lookup

TOKEN_SPLIT = r"[^\p{L}\p{N}+#]+"
PLACEHOLDERS = ("SUMMARY", "PROJECTS", "SKILLS")


@dataclass(frozen=True)
class Project:
    title: str
    tech: tuple[str, ...] = ()
    bullets: tuple[str, ...] = ()
    url: str = ""

    def terms(self) -> list[str]:
        import re

        words = re.split(r"[^\w+#]+", " ".join((self.title, *self.tech, *self.bullets)).lower())
        return sorted({w for w in words if w})


def tokens(text: Column) -> Column:
    """Lower-case word tokens of the whole text; '' may stand at either end."""
    return F.split(F.lower(text), TOKEN_SPLIT)


def taxonomy_terms(df: DataFrame, skills: Sequence[str], text: str = "text") -> DataFrame:
    """Skills mentioned by each posting, in list order."""
    rows = df.withColumn("__low", F.lower(text))
    return rows.withColumn("skill_terms", hit_list("__low", skills)).drop("__low")


def term_frequencies(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Occurrences of every term in every document.

    Texts meet by document before they are taken apart: a text is smaller than the rows of its terms, and what follows
    finds a document's terms in one task. No term is a shuffle key.
    """
    df = df.select(key, text).repartition(key)
    # the outer form, since a plain explode would tokenise twice (once as a filter)
    words = df.select(key, F.explode_outer(tokens(F.col(text))).alias("term")).filter("term != ''")
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"))


def top_terms(df: DataFrame, key: str, k: int = 5, text: str = "text") -> DataFrame:
    """The ``k`` terms of each document with the highest tf * ln(N / df).

    Frequent terms are joined by a bounded broadcast, see
    :func:`careerlens.operators.small_tables.skew_safe_lookup`. The texts are shuffled once and taken apart three times,
    and the best of a document's frequent terms are chosen before anything else is shuffled.
    """
    tf = term_frequencies(df, key, text)
    doc_freq = tf.groupBy("term").agg(F.count("*").alias("df"))
    size = df.agg(F.count("*").alias("n")).select("n").scalar()
    doc_freq = doc_freq.select("term", "df", F.ln(size / F.col("df")).alias("idf"))
    rated = skew_safe_lookup(tf, doc_freq, "term", "df", "idf")
    # ranked by the values themselves, rounded only for show
    rated = rated.select(key, "term", "tf", (F.col("tf") * F.col("idf")).alias("tfidf"))
    best = top_per_key(rated, [key], [F.desc("tfidf"), "term"], k, rank="rank")
    return best.withColumn("tfidf", F.round("tfidf", 6))


def rank_projects(df: DataFrame, projects: Sequence[Project], key: str, text: str = "text",
                  keep: int = 3) -> DataFrame:
    """The ``keep`` projects that share most terms with each posting.

    Ties go to the project listed first. Shared terms are found once per row
    against all project terms, then split by project.
    """
    every = array_literal(sorted({t for p in projects for t in p.terms()}))
    shared = df.select(key, F.array_intersect(F.array_distinct(tokens(F.col(text))), every).alias("__hit"))
    # one constant, so the size of the expression does not depend on the number of projects
    known = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(p.title).alias("project"), array_literal(p.terms()).alias("terms"))
        for i, p in enumerate(projects)
    ])
    rated = F.transform(known, lambda p: F.struct(
        (-F.size(F.array_intersect(F.col("__hit"), p["terms"]))).alias("neg"),
        p["ord"].alias("ord"), p["project"].alias("project")))
    best = F.slice(F.array_sort(rated), 1, keep)
    rows = shared.select(key, F.posexplode_outer(best).alias("__p", "__b"))
    return rows.select(
        key, (F.col("__p") + 1).alias("rank"), F.col("__b.project").alias("project"),
        (-F.col("__b.neg")).alias("shared_terms"))


def reorder_skills(df: DataFrame, skills: Mapping[str, Sequence[str]], key: str,
                   text: str = "text") -> DataFrame:
    """Skills per posting and category, mentioned ones first, otherwise stable."""
    rows = []
    for i, (category, names) in enumerate(skills.items()):
        first, every = hit_list("__low", names), array_literal(names)
        rows.append(F.struct(
            F.lit(i).alias("category_no"), F.lit(category).alias("category"),
            F.concat(first, F.array_except(every, first)).alias("skills")))
    return df.withColumn("__low", F.lower(text)).select(key, F.inline_outer(F.array(*rows)))


def fill_template(template: str, summary: Column, projects: Column, skills: Column) -> Column:
    """Replace the three placeholders in their order (mail merge)."""
    out = F.lit(template)
    for name, value in zip(PLACEHOLDERS, (summary, projects, skills)):
        out = F.replace(out, F.lit("{{" + name + "_PLACEHOLDER}}"), F.coalesce(value, F.lit("")))
    return out
