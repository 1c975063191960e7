"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: Settings that size tasks by bytes, whatever the session's number of partitions: sorts and hash tables hold some ten times what a compressed shuffle counts, several at once in a task.
#: Shuffles have so many partitions at least, and small ones are put together up to the advised size.
SMALL_TASKS = {
    "spark.sql.shuffle.partitions": 1000,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
}

#: Settings that bound what a Python worker gets at once, and what its task holds for it outside the heap: rows, and bytes where rows are long.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, one sub-folder an application.

    It is the one that ``spark.checkpoint.dir`` names. Where that is unset a
    temporary folder serves, but only for a local master: executors of a
    cluster don't see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own.setdefault(app, tempfile.mkdtemp(prefix="tracewright-"))
    return f"{base.rstrip('/')}/{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the tasks that were
    running on it, and values such as row keys can't change when a stage is
    computed again. The tables stay until the application's folder is deleted.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: it is never sent whole through the driver, however small it is estimated."""
    return df.hint("merge")


@contextmanager
def _held(spark: SparkSession, settings: dict[str, object]) -> Iterator[None]:
    """The session under ``settings``; its own hold again afterwards."""
    was = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def in_small_tasks(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of DataFrames whose stored tables are computed under ``SMALL_TASKS``; the session's settings hold again when it ends.

    What it leaves to be computed later runs under the session's own settings.
    """

    @wraps(f)
    def run(first: DataFrame, *args, **kwargs) -> DataFrame:
        spark, parts = first.sparkSession, "spark.sql.shuffle.partitions"
        with _held(spark, SMALL_TASKS | {parts: max(int(spark.conf.get(parts)), SMALL_TASKS[parts])}):
            return f(first, *args, **kwargs)

    return run


def in_small_batches(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The same under ``SMALL_BATCHES``: Python gets its rows in small batches."""

    @wraps(f)
    def run(first: DataFrame, *args, **kwargs) -> DataFrame:
        with _held(first.sparkSession, SMALL_BATCHES):
            return f(first, *args, **kwargs)

    return run


def put_buckets(rows: DataFrame, path: str, buckets: DataFrame, column: str = "bucket") -> None:
    """Makes ``rows`` the content of the named ``buckets`` of a table that is partitioned by one column; no other bucket's files change.

    ``rows`` may be read from the same table: they are stored apart first. A
    bucket without rows gets one row of nulls, for else its old rows would stay;
    ``get_buckets`` leaves it out. A large bucket spreads over tasks and files.
    """
    rows = stored(rows, "buckets")
    empty = buckets.select(column).distinct().join(rows.select(column).distinct(), column, "left_anti")
    rows = rows.unionByName(empty, allowMissingColumns=True).hint("rebalance", column)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def get_buckets(spark: SparkSession, path: str, schema: str, key: str, column: str = "bucket") -> DataFrame:
    """A table that is kept by buckets: a filter on the column reads only these; ``key`` is null in no row."""
    return spark.read.schema(f"{schema}, {column} int").parquet(path).where(F.col(key).isNotNull())
