"""The ledger as a stream: rows that come late or twice, and daily sums that are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.storage import new_path


def once_each(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Rows without those whose id came before, remembered for as long as rows may be late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def daily(events: DataFrame) -> DataFrame:
    """``day``, ``n``, ``original``, ``filtered`` by day of a (streaming) ledger."""
    rows = events.groupBy(F.window("ts", "1 day").alias("w"))
    sums = rows.agg(F.count("*").alias("n"), F.sum("original_tokens").alias("original"), F.sum("filtered_tokens").alias("filtered"))
    return sums.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "original", "filtered")


def run_available(out: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Reads all that a stream holds now and gives the last state of its result, kept in the shared folder with its checkpoint.

    Each batch replaces the result as a whole, so a batch that runs again after
    a failure changes nothing.
    """
    path = new_path(spark, name)

    def put(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/result")

    query = out.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/result")
