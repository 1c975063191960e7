"""Prices: the registry, overrides, and what tokens cost."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.sources.corpus import PRICES

#: Prices a million tokens of a model that no entry matches.
DEFAULT_INPUT, DEFAULT_OUTPUT = 3.0, 15.0
#: A registry of more entries isn't sent to all executors.
SENT_PRICES = 100_000
_SCHEMA = "source_rank int, ord int, model_id string, provider string, display_name string, input_price double, output_price double"


def price_table(spark: SparkSession, overrides: Iterable[Iterable[Mapping]] = ()) -> DataFrame:
    """The registry and overrides (nearest first); fields an override lacks come from the registry, prices else from the defaults."""
    rows = []
    for rank, models in enumerate(overrides):
        for i, m in enumerate(models):
            low = m["model_id"].lower()
            base = next((p for p in PRICES if low in p[0] or p[0] in low), None)
            rows.append(
                (
                    rank,
                    i,
                    m["model_id"],
                    m.get("provider", base[1] if base else ""),
                    m.get("display_name", base[2] if base else ""),
                    float(m.get("input_price_per_mtok", base[3] if base else DEFAULT_INPUT)),
                    float(m.get("output_price_per_mtok", base[4] if base else DEFAULT_OUTPUT)),
                )
            )
    rows += [(1000, i, *p) for i, p in enumerate(PRICES)]
    return spark.createDataFrame(rows, _SCHEMA)


def resolve(models: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Each different model's price: the first entry, by source and order, of which one name holds the other.

    Names are compared without case. The models are made distinct first, so
    that the comparison of names is between two small tables.
    """
    rows = models.select(F.col(model).alias("model")).where("model is not null").distinct()
    low, entry = F.lower("model"), F.lower("model_id")
    sent = F.broadcast(prices) if prices.count() <= SENT_PRICES else prices
    found = rows.join(sent, low.contains(entry) | entry.contains(low), "left")
    place = F.when(F.col("model_id").isNotNull(), F.struct("source_rank", "ord"))
    best = found.groupBy("model").agg(F.min_by(F.struct("model_id", "input_price", "output_price"), place).alias("p"))
    return best.select(
        "model",
        F.col("p.model_id").alias("price_id"),
        F.coalesce("p.input_price", F.lit(DEFAULT_INPUT)).alias("input_price"),
        F.coalesce("p.output_price", F.lit(DEFAULT_OUTPUT)).alias("output_price"),
    )


def cost(tokens: Column, price: Column) -> Column:
    return tokens * price / F.lit(1_000_000.0)


def with_price(ledger: DataFrame, prices: DataFrame, if_null: str) -> DataFrame:
    """The ledger with each row's input price; a null model is looked up as ``if_null``."""
    named = ledger.withColumn("model", F.coalesce("model", F.lit(if_null)))
    return named.join(resolve(named, prices).select("model", "input_price"), "model")


def suggested_model(task: Column) -> Column:
    low = F.lower(task)
    return (
        F.when(low.isin("simple", "single-file-edit", "documentation"), "gemini-3.5-flash")
        .when(low.isin("audit", "security", "review"), "gemini-3.1-pro-preview")
        .otherwise("claude-4.6-sonnet")
    )


def latest_days(daily: DataFrame, days: int) -> DataFrame:
    """The last days that have rows; one row a day comes in."""
    return daily.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("day")))).where(F.col("nth") <= days).drop("nth")
