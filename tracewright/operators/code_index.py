"""The code index as a store: symbols, calls and file hashes by buckets of files, brought up to date file by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.storage import get_buckets, put_buckets, stored
from tracewright.operators import graph

#: Buckets of files: a change of one file writes one of them again.
BUCKETS = 64
_SYMBOLS = "id string, name string, kind string, file_path string, line_start int, line_end int"
_CALLS = "caller_id string, callee_name string, file_path string"
_HASHES = "file_path string, hash string, last_indexed long"


def bucket(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


class CodeIndex:
    """A code index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _get(self, table: str, schema: str, key: str) -> DataFrame:
        try:
            return get_buckets(self.spark, f"{self.path}/{table}", schema, key)
        except Exception as e:  # a first refresh finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{schema}, bucket int")

    @property
    def symbols(self) -> DataFrame:
        return self._get("symbols", _SYMBOLS, "id")

    @property
    def calls(self) -> DataFrame:
        return self._get("calls", _CALLS, "caller_id")

    @property
    def hashes(self) -> DataFrame:
        return self._get("hashes", _HASHES, "file_path")

    def refresh(self, files: DataFrame, now_s: int) -> DataFrame:
        """Brings the index to the state of ``files`` (path, ext, content; paths are unique); gives each file's ``state``.

        Only added and changed files are parsed, and only buckets that hold an
        added, changed or vanished file are written. Hashes come last: a refresh
        that ends early leaves the old ones, so that the next one does the same
        files again. Rows of one id (kind, file, name) are one, the last.
        Unchanged files keep the time at which they were indexed.
        """
        code = files.where(F.col("content").isNotNull())
        now = code.select(F.col("path").alias("file_path"), F.md5("content").alias("hash"))
        states = stored(graph.index_delta(self.hashes.select("file_path", "hash"), now), "states")
        work = states.where("state <> 'same'").withColumn("bucket", bucket(F.col("file_path")))
        at = work.select("bucket").distinct()  # at most BUCKETS rows
        gone = work.select("file_path")
        fresh = work.where("state <> 'gone'").select(F.col("file_path").alias("path"))
        parsed = stored(graph.outlined(code.join(fresh, "path", "left_semi")), "parsed")

        def put(table: str, old: DataFrame, new: DataFrame) -> None:
            kept = old.join(F.broadcast(at), "bucket", "left_semi").join(gone, "file_path", "left_anti")
            new = new.withColumn("bucket", bucket(F.col("file_path")))
            put_buckets(kept.select(new.columns).unionByName(new), f"{self.path}/{table}", at)

        put("symbols", self.symbols, graph.symbols_of(parsed))
        put("calls", self.calls, graph.calls_of(parsed).select("caller_id", "callee_name", "file_path"))
        done = now.join(fresh, F.col("file_path") == F.col("path"), "left_semi")
        put("hashes", self.hashes, done.withColumn("last_indexed", F.lit(now_s).cast("long")))
        return states
