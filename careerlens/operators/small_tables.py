"""Joining with side tables.

Only the bounded list of heavy keys below is ever broadcast by hint. All other
joins carry no hint: the optimizer and adaptive execution broadcast by known or
measured size and otherwise shuffle, splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Typed-in rows as a local relation, so the optimizer knows their exact size."""
    struct = T.StructType.fromDDL(schema)
    fields = to_arrow_schema(struct)
    columns = [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), struct)


def skew_safe_lookup(
    facts: DataFrame, dim: DataFrame, key: str, weight: str, value: str, hot: int = 2_000,
) -> DataFrame:
    """Inner-join ``facts`` with ``dim(key, weight, value)`` without a hot shuffle key.

    ``weight`` is the number of fact rows per key. At most ``hot`` keys can hold
    more than ``1/hot`` of all rows each, so that list is bounded whatever the
    data: it is broadcast, and the rows it answers stay where they are. Only rows
    of the other keys, all of them light, are shuffled. ``facts`` is used twice.
    """
    total = dim.agg(F.sum(weight).alias("__t"))
    dims = dim.select(key, weight, value)
    # a scalar subquery: evaluated once, one number
    limit = total.select((F.col("__t") / F.lit(float(hot))).alias("__l")).scalar()
    heavy = dims.filter(F.col(weight) > limit).select(F.col(key).alias("__hk"), F.col(value).alias(value))
    light = dims.filter(F.col(weight) <= limit).select(F.col(key).alias("__lk"), F.col(value).alias(value))
    common = F.broadcast(heavy)
    at_once = facts.join(common, F.col(key) == F.col("__hk")).drop("__hk")
    rest = facts.join(common.drop(value), F.col(key) == F.col("__hk"), "left_anti")
    return at_once.unionByName(rest.join(light, F.col(key) == F.col("__lk")).drop("__lk"))


def array_literal(terms: Sequence[str]) -> Column:
    """ARRAY<STRING> constant; folded once by the optimizer."""
    return F.array(*[F.lit(t) for t in terms]).cast("array<string>")
