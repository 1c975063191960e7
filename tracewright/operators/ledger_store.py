"""The ledger as a table partitioned by day: scans read the days that they ask for, and expired days go without being read."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import ledger
from tracewright.sources.tables import SCHEMAS


def save(rows: DataFrame, path: str) -> None:
    """Appends rows, each to its day; a large day spreads over files, small ones don't make many."""
    rows.withColumn("day", F.to_date("ts")).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def _at(x: datetime) -> Column:
    return F.lit(x.isoformat(sep=" ")).cast("timestamp")  # by the session's time zone, as the days are


def load(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Rows from ``since`` on and before ``until``, by the session's time zone; days outside are not read."""
    rows = spark.read.schema(f"{SCHEMAS['ledger']}, day date").parquet(path)
    if since is not None:
        rows = rows.where((F.col("day") >= F.lit(since.date())) & (F.col("ts") >= _at(since)))
    if until is not None:
        rows = rows.where((F.col("day") <= F.lit(until.date())) & (F.col("ts") < _at(until)))
    return rows.drop("day")


def _folders(spark: SparkSession, path: str) -> tuple:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, [x.getPath() for x in files.listStatus(root) if x.isDirectory() and x.getPath().getName().startswith("day=2")]


def days(spark: SparkSession, path: str) -> list[date]:
    return sorted(date.fromisoformat(x.getName().removeprefix("day=")) for x in _folders(spark, path)[1])


def expire(spark: SparkSession, path: str, now: datetime, days: int = 30) -> list[date]:
    """Removes the folders of days that ended before the time to live; returns these. Rows of the day it falls into stay in the table.

    ``current`` leaves those rows out. Rows without a time are never removed here.
    """
    files, found = _folders(spark, path)
    limit, gone = (now - timedelta(days=days)).date(), []
    for folder in found:
        day = date.fromisoformat(folder.getName().removeprefix("day="))
        if day < limit:
            files.delete(folder, True)
            gone.append(day)
    return sorted(gone)


def current(spark: SparkSession, path: str, now: datetime, days: int = 30) -> DataFrame:
    """Rows within the time to live; only their days are read."""
    return ledger.kept(load(spark, path, since=now - timedelta(days=days)), _at(now), days)
