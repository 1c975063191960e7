"""What commands cost and saved: aggregates over the usage ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.lines import tokens
from tracewright.functions.storage import stored
from tracewright.operators import dlp
from tracewright.operators.pricing import cost, latest_days, with_price
from tracewright.sources.corpus import PRICES

#: Waiting time a command, the chart's days and width, the model of rows without one when spending is counted.
SECONDS_A_COMMAND, CHART_DAYS, CHART_WIDTH, BUDGET_MODEL, NO_MODEL = 22.8, 10, 30, "claude-3.5-sonnet", "Unknown Model"


def _saved() -> Column:
    return F.col("original_tokens") - F.col("filtered_tokens")


def _summed_cost(tokens: Column) -> Column:
    """Products are summed before the division, so that the order of rows doesn't change the sum of prices in halves."""
    return cost(F.coalesce(F.sum(tokens * F.col("input_price")), F.lit(0.0)), F.lit(1.0))


def percent(saved: Column, original: Column) -> Column:
    return F.when(original > 0, saved / original * 100).otherwise(0.0)


def totals(ledger: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    sums = ledger.agg(F.count("*").alias("commands"), F.coalesce(F.sum("original_tokens"), zero).alias("original"), F.coalesce(F.sum("filtered_tokens"), zero).alias("filtered"))
    saved = F.col("original") - F.col("filtered")
    return sums.withColumn("saved", saved).withColumn("pct", F.round(percent(saved, F.col("original")), 6))


def savings(ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """Totals with money; a null model is looked up as the empty name, which the first entry holds."""
    money = with_price(ledger, prices, "").agg(_summed_cost(_saved()).alias("cost_saved"))
    return totals(ledger).join(money)


def by_command(ledger: DataFrame) -> DataFrame:
    sums = ledger.groupBy("cmd").agg(
        F.count("*").alias("n"), F.sum("original_tokens").alias("original"), F.sum("filtered_tokens").alias("filtered"), F.sum(_saved()).alias("saved")
    )
    return sums.withColumn("pct", F.round(percent(F.col("saved"), F.col("original")), 6)).orderBy(F.desc("n"), "cmd")


def by_day(ledger: DataFrame) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return ledger.groupBy(day).agg(F.sum("original_tokens").alias("original"), F.sum("filtered_tokens").alias("filtered")).orderBy("day")


def by_model(ledger: DataFrame) -> DataFrame:
    model = F.coalesce("model", F.lit("Unknown Model")).alias("model")
    return ledger.groupBy(model).agg(F.count("*").alias("invocations"), F.sum(_saved()).alias("saved")).orderBy(F.desc("invocations"), "model")


def cost_chart(ledger: DataFrame, prices: DataFrame) -> DataFrame:
    """The last active days' cost of filtered tokens, with a bar in proportion to the dearest."""
    priced = with_price(ledger, prices, "")
    daily = priced.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(_summed_cost(F.col("filtered_tokens")).alias("cost"))
    days = latest_days(daily, CHART_DAYS)
    most = days.agg(F.max("cost").alias("most"))
    width = F.when(F.col("most") > 0, F.round(F.col("cost") / F.col("most") * CHART_WIDTH)).otherwise(0.0).cast("int")
    return days.join(most).select("day", "cost", width.alias("width"), F.repeat(F.lit("█"), width).alias("bar")).orderBy("day")


def budget(ledger: DataFrame, prices: DataFrame, limit: float = 50.0) -> DataFrame:
    priced = with_price(ledger, prices, BUDGET_MODEL)
    spent = _summed_cost(F.col("filtered_tokens"))
    out = priced.agg(spent.alias("spent")).withColumn("limit_usd", F.lit(float(limit)))
    pct = F.col("spent") / F.col("limit_usd") * 100 if limit > 0 else F.lit(0.0)
    return out.select("limit_usd", "spent", (F.col("spent") >= F.col("limit_usd")).alias("exceeded"), pct.alias("pct"))


def hours_saved(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count("*").alias("commands"), F.round(F.count("*") * SECONDS_A_COMMAND / 3600, 6).alias("hours"))


def top_saver(ledger: DataFrame) -> DataFrame:
    """The command that saved most (of equals the last by name) and the most frequent one; N/A without rows."""
    rows = ledger.groupBy("cmd").agg(F.count("*").alias("n"), F.sum(_saved()).alias("saved"))
    none = F.lit("N/A")
    return rows.agg(
        F.coalesce(F.max_by("cmd", F.struct("saved", "cmd")), none).alias("top_saver"),
        F.coalesce(F.min_by("cmd", F.struct(-F.col("n"), F.col("cmd"))), none).alias("most_frequent"),
    )


def model_projection(ledger: DataFrame) -> DataFrame:
    """The saved tokens' worth with each model of the registry."""
    models = F.array(*[F.struct(F.lit(p[0]).alias("model_id"), F.lit(p[3]).alias("price")) for p in PRICES])
    rows = totals(ledger).select("saved", F.inline(models))
    return rows.select("model_id", "saved", cost(F.col("saved"), F.col("price")).alias("worth"))


def telemetry(ledger: DataFrame) -> DataFrame:
    """All rows without the raw output, newest first."""
    return ledger.drop("raw_output").orderBy(F.desc("ts"), F.desc("id"))


def telemetry_json(ledger: DataFrame) -> DataFrame:
    """``id``, ``line``: each row without the raw output as a JSON object, fields in the table's order."""
    rows = ledger.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return rows.select("id", F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != "raw_output"]), {"ignoreNullFields": "false"}).alias("line"))


def recent(ledger: DataFrame, n: int = 50) -> DataFrame:
    return ledger.orderBy(F.desc("id")).limit(n)


def raw_output(ledger: DataFrame, log_id: int) -> DataFrame:
    return ledger.where((F.col("id") == log_id) & F.col("raw_output").isNotNull()).select("raw_output")


def counters(ledger: DataFrame) -> DataFrame:
    """Row count and token sums, and the same as exposition text."""
    out = totals(ledger).drop("pct")
    names = ("commands", "original", "filtered", "saved")
    lines = [F.concat(F.lit(f"ledger_{n}_total "), F.col(n).cast("string")) for n in names]
    return out.withColumn("exposition", F.concat_ws("\n", *lines))


def export(ledger: DataFrame, most: int = 50_000) -> DataFrame:
    """The newest rows with their savings; a null model is told as unknown."""
    saved_pct = percent(_saved(), F.col("original_tokens"))
    return recent(ledger, most).select(
        "id", F.coalesce("model", F.lit("unknown")).alias("model"), "cmd", "original_tokens", "filtered_tokens", _saved().alias("saved"), F.round(saved_pct, 6).alias("pct")
    )


def kept(ledger: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Rows that aren't older than the time to live."""
    return ledger.where(F.col("ts") >= now - F.expr(f"interval {days} days"))


def phases(runs: DataFrame, phase: str, before: str, after: str) -> DataFrame:
    """Token sums by phase and in all, with token-weighted savings."""
    out = runs.rollup(phase).agg(F.count("*").alias("n"), F.sum(before).alias("before"), F.sum(after).alias("after"))
    pct = percent(F.col("before") - F.col("after"), F.col("before"))
    return out.select(F.coalesce(phase, F.lit("all")).alias(phase), "n", "before", "after", F.round(pct, 6).alias("pct"))


def run_statistics(runs: DataFrame, group: str, value: str) -> DataFrame:
    return runs.groupBy(group).agg(
        F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.stddev_pop(value), 6).alias("spread")
    )


def append(ledger: DataFrame, new: DataFrame, custom: tuple[str, ...] = ()) -> DataFrame:
    """The ledger with new rows (cmd, raw_output, filtered and what else it has), in their order.

    Both texts are redacted before they are counted; a row without a model gets
    the name for none. Ids go on from the ledger's last: a row's number is its
    place in its partition after the counts of earlier partitions, so only
    these counts meet in one task.
    """
    rows = new if "model" in new.columns else new.withColumn("model", F.lit(None).cast("string"))
    raw, short = dlp.redact(F.col("raw_output"), custom), dlp.redact(F.col("filtered"), custom)
    rows = rows.withColumn("raw_output", raw).withColumn("filtered", short).withColumn("model", F.coalesce("model", F.lit(NO_MODEL)))
    rows = rows.withColumn("original_tokens", tokens(F.col("raw_output"))).withColumn("filtered_tokens", tokens(F.col("filtered")))
    rows = stored(rows.drop("id").withColumn("_at", F.monotonically_increasing_id()), "new")
    part, nth = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    last = ledger.agg(F.coalesce(F.max("id"), F.lit(0).cast("long")).alias("_last"))
    rows = rows.withColumn("_part", part).join(starts, "_part").join(last).withColumn("id", F.col("_last") + F.col("_before") + nth + 1)
    return ledger.unionByName(rows.select(*[c for c in ledger.columns if c in rows.columns]), allowMissingColumns=True)
