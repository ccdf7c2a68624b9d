"""Main text of a detail page: first of main, article, body."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from careerlens.functions.markup import decode_references, joined_text, marked_text, visible
from careerlens.functions.staging import settle
from careerlens.operators.dom import parse_page

# Functions and classes below travel to the workers with the task, so the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REGIONS = ("main", "article", "body")


def _content(tag: str) -> str:
    return rf"(?is)<{tag}(?=[\s>/])[^>]*>(.*?)(?:</{tag}\s*>|\z)"


@F.pandas_udf(StringType())
def _parsed_main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(html):
        if html is None:
            return None
        root = parse_page(html)
        for tag in REGIONS:
            node = root.find(tag)
            if node is not None:
                return node.text(" ", stripped=True)
        return ""

    for batch in batches:
        yield batch.map(one, na_action="ignore")


def main_text(pages: DataFrame, html: str = "html", out: str = "main_text") -> DataFrame:
    """Add the stripped text nodes of the main region, joined by one blank.

    Regular pages stay in the JVM. Where the first region holds a second start
    tag of its own kind, a regular expression cannot tell which end tag closes
    it, so only these sources go through the parser (others are sent as NULL).
    """
    df = pages.withColumn("__vis", visible(F.col(html)))
    region = F.coalesce(*[
        F.when(F.col("__vis").rlike(rf"(?i)<{t}[\s>/]"), F.lit(t)) for t in REGIONS
    ], F.lit(""))
    df = df.withColumn("__region", region)
    body = F.lit("")
    for t in reversed(REGIONS):
        body = F.when(F.col("__region") == t, F.regexp_extract("__vis", _content(t), 1)).otherwise(body)
    df = df.withColumn("__body", body)
    nested = F.lit(False)
    for t in REGIONS:
        nested = nested | ((F.col("__region") == t) & F.col("__body").rlike(rf"(?i)<{t}[\s>/]"))
    df = df.withColumn("__hard", F.when(nested, F.col(html)))
    df = df.withColumn("__marked", marked_text(F.col("__body")))
    df = df.withColumn("__marked", decode_references("__marked"))
    native = joined_text(F.col("__marked"), " ")
    text = F.when(F.col("__hard").isNull(), native).otherwise(_parsed_main_text(F.col("__hard")))
    return settle(df.withColumn("__text", text), [c for c in pages.columns if c != out], {out: F.col("__text")})
