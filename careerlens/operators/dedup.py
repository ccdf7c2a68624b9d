"""First-wins deduplication, top-N per group, and the seen filter.

All of them are ``row_number() <= n`` with a literal bound. Spark then keeps at
most n rows per key and task before the shuffle, so a key that holds a third of
all rows reaches its reducer as n rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTS = 256


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every key by an explicit order."""
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int,
                rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every key by an explicit order."""
    # Spark limits groups before the shuffle up to a bound of its own; beyond it in two rounds, with the same rows: the
    # top n of a key are among the top n of its parts
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        part = F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))
        inner = W.partitionBy(*keys, "__part").orderBy(*order)
        df = (df.withColumn("__part", part)
              .withColumn("__pr", F.row_number().over(inner))
              .filter(F.col("__pr") <= n).drop("__part", "__pr"))
    window = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n)
    return out.drop("__rn") if rank is None else out.withColumnRenamed("__rn", rank)


def cap_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                cap: str, highest: int) -> DataFrame:
    """As :func:`top_per_key` with a cap column whose largest value is ``highest``."""
    ranked = top_per_key(df, keys, order, highest, rank="__rank")
    return ranked.filter(F.col("__rank") <= F.col(cap)).drop("__rank")


def dedup_by_url(df: DataFrame, order: Sequence[Column | str], url: str = "url") -> DataFrame:
    """One row per url, the earliest by ``order``."""
    return first_per_key(df, [url], order)


def drop_seen(df: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose url key is not among ``seen(seen_key)``.

    Deduplicate ``df`` by url first: then no key is hot on either side.
    """
    key = F.sha2(F.col(url), 256)
    return df.join(seen.select("seen_key"), key == F.col("seen_key"), "left_anti")


def drop_known_urls(df: DataFrame, history: DataFrame, url: str = "url") -> DataFrame:
    """As :func:`drop_seen` on the url itself, which reuses a partitioning by url.

    Both sides meet by url here; ``store.known_urls`` is the form whose history stays where it lies.
    """
    known = history.select(F.col(url).alias("__known"))
    return df.join(known, F.col(url) == F.col("__known"), "left_anti")
