"""Near-duplicate vectors: int8 tile products bound every cosine, pairs that may reach the threshold are computed in double."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import components, row_key, stored

#: Bytes of a block of vectors and rows of a small one; strips of a tile: rows by columns worked on at a time.
BLOCK_BYTES, BLOCK_ROWS, STRIP_ROWS, STRIP_COLUMNS = 16 << 20, 2048, 256, 4096
#: int8 products summed over this many components stay exact in float32.
EXACT_TERMS = 1024
#: What float32 and double arithmetic may add to a bound on a cosine.
SLACK = 1e-5


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, each one's scale, the length of its codes' vector, and the length of what rounding left."""
    scale = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scale[:, None])
    near = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.sqrt((near**2).sum(axis=1)), np.sqrt(((units - near) ** 2).sum(axis=1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """int8 dot products: exact in float32 by parts of ``EXACT_TERMS``, summed in double only where there are more."""
    parts = [a[:, k : k + EXACT_TERMS].astype(np.float32) @ b[:, k : k + EXACT_TERMS].astype(np.float32).T for k in range(0, a.shape[1], EXACT_TERMS)]
    return parts[0] if len(parts) == 1 else np.sum(parts, axis=0, dtype=np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # so that squares of large and small numbers stay in range
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def _linked(x: tuple, y: tuple, similarity: float) -> np.ndarray:
    """A boolean matrix of the pairs whose cosine reaches the threshold."""
    (ux, qx, sx, lx, ex), (uy, qy, sy, ly, ey) = x, y
    # |u.w - sx sy (qx.qy)| <= lx ey + ex ly + ex ey, first with the strip's largest ly and ey.
    rough = similarity - SLACK - lx * ey.max() - ex * (ly.max() + ey.max())
    about = _products(qx, qy)
    may = about * sy.astype(about.dtype) >= (rough / sx).astype(about.dtype)[:, None]
    i, j = np.nonzero(may)
    bound = about[i, j] * sx[i] * sy[j] + lx[i] * ey[j] + ex[i] * (ly[j] + ey[j]) + SLACK
    far = bound < similarity
    may[i[far], j[far]] = False
    i, j = i[~far], j[~far]
    rows, columns = np.unique(i), np.unique(j)
    if len(i) * 4 > len(rows) * len(columns):  # dense: one product of the rows and columns concerned
        may[np.ix_(rows, columns)] &= ux[rows] @ uy[columns].T >= similarity
    else:
        for a in range(0, len(i), 1 << 16):
            p, r = i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            may[p, r] = (ux[p] * uy[r]).sum(axis=1) >= similarity
    return may


class _Forest:
    """Which rows of a tile hang together, by the least of each tree."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def tops(self, at: np.ndarray) -> np.ndarray:
        top = self.up[at]
        while (self.up[top] != top).any():
            top = self.up[top]
        self.up[at] = top
        return top

    def join(self, i: int, others: np.ndarray) -> None:
        tops = np.unique(self.tops(np.append(others, i)))
        self.up[tops] = tops[0]


def _tile(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """For each linked vector of a tile: the vectors linked to it there, copies counted, and the least that it hangs together with there."""
    rows = rows.sort_values("rep", ignore_index=True)
    one = rows["a"].iloc[0] == rows["b"].iloc[0]
    first = rows.index[rows["block"] == rows["a"]].to_numpy()
    second = first if one else rows.index[rows["block"] != rows["a"]].to_numpy()
    copies = rows["copies"].to_numpy(np.int64)
    units = _units(np.stack(rows["v"].to_numpy()).astype(float))
    codes = quantised(units)
    links, forest = np.zeros(len(rows), np.int64), _Forest(len(rows))

    def part(at: np.ndarray) -> tuple:
        return units[at], *(c[at] for c in codes)

    for a in range(0, len(first), STRIP_ROWS):
        i = first[a : a + STRIP_ROWS]
        for b in range(0, len(second), STRIP_COLUMNS):
            j = second[b : b + STRIP_COLUMNS]
            met = _linked(part(i), part(j), similarity)
            if one:
                met &= i[:, None] != j
            if not met.any():
                continue
            links[i] += met @ copies[j]
            if not one:
                links[j] += copies[i] @ met
            for k in np.flatnonzero(met.any(axis=1)):
                forest.join(int(i[k]), j[met[k]])
    at = np.flatnonzero(links)
    rep = rows["rep"].to_numpy()
    return pd.DataFrame({"rep": rep[at], "root": rep[forest.tops(at)], "links": links[at]})


def near_duplicate_vectors(vectors: DataFrame, similarity: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each vector's number of links and component.

    Two vectors are linked if they have the same number of components and their
    cosine, in double precision, is at least ``similarity`` (above 0).
    ``n_links`` counts the other rows linked directly, ``component_id`` is the
    smallest id reachable by links, its own included; ``kept`` marks the rows
    that have that id. Vectors that are null, empty, zero, or hold null or
    non-finite components, and rows with a null id, link with nothing: no links,
    their own id (null stays null), kept. Repeated rows are vectors of their
    own, linked with each other. An empty table gives no rows. Only the two
    named columns are read, so others may have any name.

    Equal vectors are first reduced to one by a partial aggregate. Those left
    are dealt evenly into blocks of at most ``BLOCK_BYTES``; every pair of
    blocks is a tile of one task, worked through in strips. int8 products give
    each cosine but for a bound from what rounding left of the two vectors;
    only pairs that may reach the threshold are computed in double. A tile
    returns counts and a spanning forest, never pairs, so that a group of any
    size gives at most one row a vector and tile.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0, and 1 at most")
    v = F.col(vector)
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), (whole & F.col(key).isNotNull()).alias("part"))
    rows = stored(rows.select("vec_id", F.when(F.col("part"), F.col("v")).alias("v"), row_key().alias("row")), "vectors")
    sets = rows.where("v is not null").groupBy("v").agg(F.min("row").alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    sets = stored(sets.withColumn("dim", F.size("v")), "sets")

    n = sets.agg(F.count("*").alias("all"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    spark = vectors.sparkSession
    wide = min(max(STRIP_ROWS, BLOCK_BYTES // (8 * n["dim"])), max(BLOCK_ROWS, n["all"] // spark.sparkContext.defaultParallelism))
    blocks = max(1, -(-n["all"] // wide))
    dealt = sets.select("dim", "rep", "copies", "v", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"))
    dealt = dealt.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = dealt.select("dim", F.least("block", "c").alias("a"), F.greatest("block", "c").alias("b"), "block", "rep", "copies", "v")
    found = stored(tiles.groupBy("dim", "a", "b").applyInPandas(lambda rows: _tile(rows, similarity), "rep long, root long, links long"), "tiles")

    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    told = sets.select("v", "rep", "least", "copies").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").join(counts, "rep", "left")
    told = stored(told.withColumn("root", F.coalesce("root", "rep")), "told")
    named = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = told.join(named, "root").select("v", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    told = told.withColumn("n_links", F.col("n_links").cast("long"))
    # Rows that take no part never meet the others: in a join they would all share the null key.
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    met = rows.where("v is not null").join(told, "v").select("vec_id", "n_links", "component_id")
    return met.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v,
         coalesce(len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok
  FROM embeddings
), n AS MATERIALIZED (
  SELECT r, vec_id, v, len(v) AS dim, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM v WHERE ok AND vec_id IS NOT NULL
), linked AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM n a JOIN n b ON a.dim = b.dim AND a.r <> b.r
  WHERE list_sum(list_transform(range(1, a.dim + 1), lambda i: a.v[i] * b.v[i])) / (a.size * b.size) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM linked UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a
), least AS (
  SELECT reach.a AS r, min(v.vec_id) AS id FROM reach JOIN v ON reach.b = v.r GROUP BY reach.a
), links AS (
  SELECT a AS r, count(*) AS n FROM linked GROUP BY a
)
SELECT vec_id, coalesce(links.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least.id, vec_id)) AS component_id,
       vec_id IS NOT DISTINCT FROM least(vec_id, coalesce(least.id, vec_id)) AS kept
FROM v LEFT JOIN links USING (r) LEFT JOIN least USING (r)
"""
