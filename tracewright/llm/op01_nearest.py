"""Nearest neighbours by a block matrix join: int8 product tiles bound distances, survivors are computed in double."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import row_key, stored

#: Bytes of a block of vectors and rows of a small one; a tile is a block of queries by a block of candidates.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 8192
#: Queries and candidates of a tile that are worked through at a time: some six arrays of so many doubles are held, whatever the number of components.
STRIP_ROWS, STRIP_COLUMNS = 256, 8192
#: int8 products summed over this many components stay exact in float32.
EXACT_TERMS = 1024


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, each row's scale, and the exact length of what rounding left."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT_TERMS):
        out += a[:, k : k + EXACT_TERMS].astype(np.float32) @ b[:, k : k + EXACT_TERMS].astype(np.float32).T
    return out


class _Side:
    """A block's vectors and what their quantisation tells, or some rows of it."""

    def __init__(self, frame: pd.DataFrame) -> None:
        self.row, self.id = frame["row"].to_numpy(), frame["vec_id"].to_numpy()
        self.exact = np.stack(frame["v"].to_numpy()).astype(float)
        self.codes, self.scale, self.error = _quantised(self.exact)
        self.square = (self.codes.astype(np.int32) ** 2).sum(axis=1, dtype=np.int64) * self.scale**2

    def part(self, at: slice) -> _Side:
        out = _Side.__new__(_Side)
        for name, values in vars(self).items():
            setattr(out, name, values[at])
        return out


def _strip(q: _Side, c: _Side, best: list[list[tuple[float, int, int]]], k: int) -> None:
    """Adds to each query's k nearest so far, (distance, vec_id, row) in order, those among some candidates."""
    squares = q.square[:, None] + c.square
    about = np.sqrt(np.maximum(squares - 2 * _products(q.codes, c.codes) * q.scale[:, None] * c.scale, 0))
    about = np.where(np.isfinite(about), about, 0.0)  # too large for squares: nothing is known of these
    error = (q.error[:, None] + c.error) + 1e-9 * (np.sqrt(q.square)[:, None] + np.sqrt(c.square)) + 1e-7 * np.sqrt(squares)
    high = np.where(np.isfinite(squares), about + error, np.inf)
    high[q.row[:, None] == c.row] = np.inf
    for i in range(len(best)):
        # The k-th smallest upper bound is at least the k-th smallest distance.
        limit = np.partition(high[i], k - 1)[k - 1] if len(c.row) > k else np.inf
        if len(best[i]) == k:
            limit = min(limit, best[i][-1][0])
        at = np.flatnonzero((about[i] - error[i] <= limit) & (c.row != q.row[i]))
        d = np.zeros(len(at))
        with np.errstate(over="ignore"):
            for j in range(q.exact.shape[1]):  # in order, as a plain sum would go
                d += (c.exact[at, j] - q.exact[i, j]) ** 2
        best[i] = heapq.nsmallest(k, best[i] + list(zip(np.sqrt(d).tolist(), c.id[at].tolist(), c.row[at].tolist(), strict=True)))


def _tile(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of the tile's candidates for each of its queries, some rows of both at a time."""
    parts = []
    if len(q) and len(c):
        x, y = _Side(q), _Side(c)
        for a in range(0, len(q), STRIP_ROWS):
            some = x.part(slice(a, a + STRIP_ROWS))
            best: list[list[tuple[float, int, int]]] = [[] for _ in some.row]
            for b in range(0, len(c), STRIP_COLUMNS):
                _strip(some, y.part(slice(b, b + STRIP_COLUMNS)), best, k)
            scores, ids, rows = (np.array([t[n] for found in best for t in found], kind) for n, kind in enumerate((float, np.int64, np.int64)))
            parts.append((np.repeat(some.row, [len(found) for found in best]), rows, ids, scores))
    names = ("query_row", "row", "vec_id", "score")
    return pd.DataFrame({n: np.concatenate([p[i] for p in parts]) if parts else [] for i, n in enumerate(names)})


def nearest(
    vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """For each row whose id is divisible by ``every``, its k nearest other rows by Euclidean distance.

    Exact: every candidate meets every query in a tile; the bounds only spare
    work. Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do null ids. Vectors of another length than the query's are no
    candidates of it. Each row is its own: with repeated rows only the query's
    own row is left out, its copies are candidates at distance 0, and every
    repeated query gets its own k rows. Ties go to the smaller id, then to the
    earlier row. An empty table, or no query, gives no rows.

    Candidates and queries are dealt evenly into blocks of at most
    ``BLOCK_BYTES`` by row number, and each pair of blocks is a task's tile.
    Distances too large for a double are infinite, as ties. Only the two named
    columns are read, so others may have any name. A tile gives at most k rows for a query; the
    best of these over all tiles are taken by a top-k window, partly before the
    shuffle.
    """
    v = F.col(vector)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(key).isNotNull() & whole).select(row_key().alias("row"), F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    rows = stored(rows.withColumn("dim", F.size("v")).withColumn("asks", F.col("vec_id") % every == 0), "vectors")
    n = rows.agg(F.count("*").alias("all"), F.count_if("asks").alias("asks"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    # Wide blocks make few copies: a candidate travels once a block of queries, a query once a block of candidates.
    most = max(STRIP_ROWS, BLOCK_BYTES // (8 * n["dim"]))
    wide = min(most, max(BLOCK_ROWS, n["all"] // vectors.sparkSession.sparkContext.defaultParallelism))
    bc, bq = max(1, -(-n["all"] // wide)), max(1, -(-n["asks"] // most))

    # A row's block is its number's hash: numbers differ, so blocks are even whatever the ids and values.
    def dealt(blocks: int) -> F.Column:
        return F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")

    def copied(blocks: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    fields = ["dim", "c", "q", "row", "vec_id", "v"]
    candidates = rows.withColumn("c", dealt(bc)).withColumn("q", copied(bq)).select(*fields)
    queries = rows.where("asks").withColumn("q", dealt(bq)).withColumn("c", copied(bc)).select(*fields)

    def tile(_: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return _tile(q, c, k)

    found = (
        queries.groupBy("dim", "c", "q")
        .cogroup(candidates.groupBy("dim", "c", "q"))
        .applyInPandas(tile, "query_row long, row long, vec_id long, score double")
    )
    best = Window.partitionBy("query_row").orderBy("score", "vec_id", "row")
    ids = rows.where("asks").select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(ids, "query_row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_block_matrix_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v, len(embedding) AS n FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr, sqrt(list_reduce([0.0::DOUBLE] || list_transform(range(1, q.n + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.n = c.n AND q.r <> c.r WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score, vec_id, cr) AS k, vec_id, score FROM d
)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM ranked WHERE k <= 10
"""
