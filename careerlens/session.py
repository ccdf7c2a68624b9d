"""Session defaults. Only settings that are not fixed by the cluster are touched."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # page sources are large: bound Arrow batches by rows and by bytes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings this package relies on."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", name: str = "careerlens", partitions: int = 8) -> SparkSession:
    """A local session for tests and measurements."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder the cluster names, else the given one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if fallback is None:
        raise ValueError("spark.checkpoint.dir is not set and no folder was given")
    return fallback


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run: in the shared checkpoint folder, or a temporary one on a local master without it."""
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not local:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='careerlens-')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: its size is known to the plans that use it."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
