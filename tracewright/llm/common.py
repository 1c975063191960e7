"""What the training-data operators share: stored tables, row keys, gapless numbers and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.storage import stored

__all__ = ["bounded", "components", "numbered", "row_key", "stored"]


def bounded(df: DataFrame, name: str, most: int, weight: Column | None = None) -> DataFrame:
    """``df`` stored, with a hint to send it to all executors only if it has at most ``most`` rows, or bytes by each row's ``weight``."""
    df = stored(df, name)
    size = df.count() if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


def row_key() -> Column:
    """A long that is different for each row; take it right after a scan."""
    return F.monotonically_increasing_id()


def numbered(df: DataFrame, keys: list[str], part: str, nth: str, out: str) -> DataFrame:
    """Numbers from 0 without gaps in each group of ``keys``, as column ``out``.

    ``nth`` already counts without gaps in each (keys, part); parts follow each
    other in order. Only the counts of parts meet in one group, never the rows.
    ``df`` should be stored: it is read twice.
    """
    counts = df.groupBy(*keys, part).agg((F.max(nth) + 1).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return df.join(starts, [*keys, part]).withColumn(out, F.col("_before") + F.col(nth)).drop("_before")


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for each node of the undirected ``links`` (``a``, ``b``): root is its component's least node.

    Least labels spread along the links; after each round a label also jumps to
    its own label's label, so that long chains take a logarithmic number of
    rounds. It goes on until nothing changes. Each round is stored.
    """
    links = links.where("a <> b")
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root"))
    roots = stored(roots, "roots")
    while True:
        near = (
            both.join(roots, both.b == roots.node)
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        moved = roots.join(near, "node").select(
            "node", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("_moved")
        )
        jump = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        moved = moved.join(jump, moved.root == F.col("_n"), "left").select(
            "node", F.least("root", F.coalesce("_r", "root")).alias("root"), "_moved"
        )
        moved = stored(moved, "roots")
        roots = moved.select("node", "root")
        if moved.where("_moved").isEmpty():
            return roots
