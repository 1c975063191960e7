"""Keyed state over the ledger as a stream: sessions of work, and the times at which old rows of a project are due to be deleted."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewright.operators.stores import GC_SECONDS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", by: str = "project") -> DataFrame:
    """``by``, ``started``, ``ended``, ``n``, ``original``, ``filtered``: runs of a key's rows that are at most ``gap`` apart.

    On a stream a session is given once, when no row that is at most ``late``
    behind the latest can still lengthen it; its state goes then. Rows that come
    later still are left out. Rows of one session are summed before the shuffle
    and again in each batch, so a busy key sends few rows. Rows without a time
    are in no session; those without a key are a key of their own.
    """
    rows = events.where(F.col("ts").isNotNull()).withWatermark("ts", late).groupBy(by, F.session_window("ts", gap).alias("w"))
    sums = rows.agg(F.count("*").alias("n"), F.sum("original_tokens").alias("original"), F.sum("filtered_tokens").alias("filtered"))
    return sums.select(by, F.col("w.start").alias("started"), (F.col("w.end") - F.expr(f"interval {gap}")).alias("ended"), "n", "original", "filtered")


class _Throttle(StatefulProcessor):
    """Remembers when a key was last due, for as long as that keeps the next time away."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "micros long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        times = np.sort(np.concatenate([r["micros"].to_numpy(np.int64) for r in rows]))
        last = self._last.get()[0] if self._last.exists() else None
        due = []
        at = 0 if last is None else int(np.searchsorted(times, last + GC_SECONDS * 1_000_000))
        while at < len(times):
            last = int(times[at])
            due.append(last)
            at = int(np.searchsorted(times, last + GC_SECONDS * 1_000_000))
        if due:
            self._last.update((last,))
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(last // 1000 + GC_SECONDS * 1000)
        yield pd.DataFrame({"key": [key[0]] * len(due), "micros": np.array(due, np.int64)})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        # A day after the last time: whatever row comes next is due with or without it.
        self._last.clear()
        return iter(())


def due_times(events: DataFrame, late: str = "2 hours", by: str = "project") -> DataFrame:
    """``by``, ``due``: the times of a key's rows at which old rows are to be deleted: its first row, then the first at least a day after that, and so on.

    On a stream a timer drops a key's state once a day of event time has passed
    without need of it, so idle keys hold none. Rows more than ``late`` behind
    the latest are left out; rows of one batch count in the order of their
    times, those of batches in the order they come. A task holds eight bytes for
    each different second that a key has in a batch. Rows without key or time
    are left out.
    """
    rows = events.where(F.col(by).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = rows.select(F.col(by).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("micros"))
    out = rows.groupBy("key").transformWithStateInPandas(_Throttle(), "key string, micros long", outputMode="append", timeMode="eventTime")
    return out.select(F.col("key").alias(by), F.timestamp_micros("micros").alias("due"))


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State on the executors' disks for queries that start meanwhile: timers need it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_appended(out: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Reads all that a stream holds now, adds its new rows to those below ``path``, and gives them all.

    Checkpoint and result lie below ``path``, a folder that all executors share.
    The sink writes each row once, also where a batch runs again after a
    failure; a further call goes on where the last one ended.
    """
    with _rocks(spark):
        writer = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint")
        query = writer.trigger(availableNow=True).start(f"{path}/result")
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/result")
