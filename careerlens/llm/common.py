"""Shared helpers: reading, written intermediate tables, per-worker caches, row numbers within keys."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careerlens.session import tune  # noqa: F401

ROWS_PER_BUCKET = 1_000_000
LEAST_BUCKETS = 256
_local_root: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only on a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="careerlens-"))
    return _local_root[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/careerlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_cache(name: str) -> dict:
    """A dictionary that tasks of one Python worker share. A worker serves many stages and jobs, so it keeps one only: that of
    another name is dropped."""
    holder = sys.modules.setdefault("_careerlens_worker", types.ModuleType("_careerlens_worker"))
    if getattr(holder, "name", None) != name:
        holder.name, holder.kept = name, {}
    return holder.kept


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under fixed names: extra or clashing columns of the input play no part."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in wanted.items()])


def crc_of(column: str) -> Column:
    """crc32 of a column as text; 0 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0))


def buckets_for(rows: int) -> int:
    """Number of buckets in which this many rows are numbered."""
    return max(LEAST_BUCKETS, rows // ROWS_PER_BUCKET)


def bucket_of(spread: Column, rows: int) -> Column:
    """The bucket of a row in :func:`numbered`. Within a key, numbers follow the bucket, then the order."""
    return F.pmod(spread, F.lit(buckets_for(rows))).cast("int")


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], spread: Column, out: str = "rank",
             rows: int | None = None) -> DataFrame:
    """Add ``out``: 0, 1, 2 … within each key, without bringing a key's rows into one task.

    ``spread`` is a number that is equal on every evaluation of a row; its remainder deals a key's rows to buckets,
    whose counts give each bucket its first number. Rows are numbered by bucket, then by ``order``.
    """
    rows = df.count() if rows is None else rows
    df = df.withColumn("_bucket", bucket_of(spread, rows))
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(key)]
    first = df.groupBy(*key, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    first = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_bucket").alias("_b"), "_first")
    inside = Window.partitionBy(*key, "_bucket").orderBy(*order)
    df = df.withColumn("_row", F.row_number().over(inside))
    on = F.col("_b") == F.col("_bucket")
    for s in same:
        on = on & s
    df = df.join(first, on)
    return df.withColumn(out, F.col("_first") + F.col("_row") - 1).drop("_b", "_bucket", "_first", "_row",
                                                                       *[f"_k{i}" for i in range(len(key))])
