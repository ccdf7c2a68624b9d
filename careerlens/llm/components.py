"""Connected components of an edge table by rounds of joins, written between rounds; nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careerlens.llm.common import written


def components(edges: DataFrame, source: str = "a", target: str = "b") -> DataFrame:
    """``edges`` (two long columns) to (node, component): the least node reachable. Only nodes of edges appear.

    Alternates large-star (each node links its larger neighbours to its least neighbour) and small-star (each node
    links its smaller neighbours and itself to the least of them) until the edges stop changing; then every edge
    leads to the least node. A node's neighbours are aggregated to their least one first and joined back, so a hub is
    no single task.
    """
    a, b = F.col("a"), F.col("b")
    now = edges.select(F.greatest(source, target).cast("long").alias("a"), F.least(source, target).cast("long").alias("b"))
    now = written(now.where("a <> b").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())

    before = state(now)
    while True:
        both = now.union(now.select(b, a)).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # here each edge leads from the larger to the smaller node
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b"))
        now = written(small.where("a <> b").distinct(), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    members = now.select(a.alias("node"), b.alias("component"))
    return members.union(now.select(b, b).distinct())
