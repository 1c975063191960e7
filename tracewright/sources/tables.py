"""The stored tables' columns; rows written before a column existed hold null in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Tables and their columns.
SCHEMAS = {
    "ledger": "id long, cmd string, original_tokens long, filtered_tokens long, ts timestamp, raw_output string, model string, project string, branch string, duration_ms long",
    "meta": "key string, value string",
    "memory": "key string, val string, project_path string, created_at timestamp, last_accessed_at timestamp",
    "session": "project_path string, key string, val string, updated_at timestamp",
    "artifacts": "id string, type string, content string, metadata_json string, created_at timestamp",
    "symbols": "id string, name string, kind string, file_path string, line_start int, line_end int",
    "dependencies": "caller_id string, callee_name string, callee_file_path string, dependency_kind string",
    "file_hashes": "file_path string, hash string, last_indexed long",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table with all its columns, whichever of them its files have."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def add(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables' rows; columns that one lacks are null in its rows."""
    return old.unionByName(new, allowMissingColumns=True)
