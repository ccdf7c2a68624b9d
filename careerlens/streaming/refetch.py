"""Refetch suppression: an address fetched less than a life time ago is ignored."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from careerlens.lexicon import SNAPSHOT_TTL_SECONDS

# Functions and classes below travel to the workers with the task, so the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_within_watermark(fetches: DataFrame, ttl: int = SNAPSHOT_TTL_SECONDS) -> DataFrame:
    """Simple form: one row per address within the watermark delay."""
    return fetches.withWatermark("fetched_at", f"{ttl} seconds").dropDuplicatesWithinWatermark(["url"])


class _Gate(StatefulProcessor):
    """Keeps one number per address: when it was last let through."""

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        before = last
        # a key may come in several chunks that are not ordered among each other: 8 bytes are kept of each row
        times = np.sort(np.concatenate([np.empty(0, np.int64), *[batch["us"].to_numpy(np.int64) for batch in rows]]))
        passed, at = [], 0 if last is None else int(np.searchsorted(times, last + self.ttl_us, side="right"))
        while at < len(times):
            last = int(times[at])
            passed.append(last)
            at = int(np.searchsorted(times, last + self.ttl_us, side="right"))
        if passed:
            yield pd.DataFrame({"url": key[0], "us": passed})
        if last != before:
            self.last.update((int(last),))
            self.handle.registerTimer((int(last) + self.ttl_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the watermark has passed the life time: the address may be forgotten
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None and (last + self.ttl_us) // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def gate_refetches(fetches: DataFrame, ttl: int = SNAPSHOT_TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Exact form for fetches(url, fetched_at): a row passes when its address was
    let through more than ``ttl`` seconds before. State is one number per
    address and is dropped once the watermark has passed its life time.

    Needs the RocksDB state store (``ROCKSDB``) in the session.
    """
    rows = fetches.withWatermark("fetched_at", delay).select(
        "url", "fetched_at", F.unix_micros("fetched_at").alias("us"))
    gated = rows.groupBy("url").transformWithStateInPandas(
        statefulProcessor=_Gate(ttl * 1_000_000), outputStructType="url string, us bigint",
        outputMode="append", timeMode="EventTime")
    return gated.select("url", F.timestamp_micros("us").alias("fetched_at"))
