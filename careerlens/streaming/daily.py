"""Tumbling daily counts, the same code for a table and a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(df: DataFrame, by: Sequence[str], ts: str = "ts", delay: str | None = None) -> DataFrame:
    """Rows per UTC day and ``by`` columns. ``delay`` sets the watermark of a
    stream: rows later than it are dropped."""
    if df.isStreaming and delay is not None:
        df = df.withWatermark(ts, delay)
    return df.groupBy(F.window(ts, "1 day"), *by).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("day"), *by, "n")
