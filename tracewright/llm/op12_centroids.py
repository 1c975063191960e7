"""Centroid clustering: plain Lloyd rounds on integer vectors, exact and the same on any number of executors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import stored

#: Integer components end at +-LIMIT (inputs of 131,072 with 1024 steps a unit), so that the squared distance of 64 of them fits in a long.
LIMIT = 1 << 27
#: Vectors whose differences are held at a time, for one centroid.
STRIP_ROWS = 4096


def integer_vectors(vectors: DataFrame, dim: int = 64, steps: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id``, ``v`` (integers ``floor(steps * x)``, within +-LIMIT) of the vectors with ``dim`` finite components."""
    v = F.col(vector)
    whole = v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * steps))).cast("int"))
    return vectors.where(whole).select(F.col(key).cast("long").alias("vec_id"), scaled.alias("v"))


def _assigned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid, the lowest of equals, and its squared distance, in integers."""
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in range(0, len(x), STRIP_ROWS):
        part = x[a : a + STRIP_ROWS]
        d = np.stack([((part - c) ** 2).sum(axis=1) for c in centroids])
        at[a : a + STRIP_ROWS] = d.argmin(axis=0)
        far[a : a + STRIP_ROWS] = d.min(axis=0)
    return at, far


def _rows(batch: pd.DataFrame) -> np.ndarray:
    return np.stack(batch["v"].to_numpy()).astype(np.int64)


def _summed(centroids: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of a partition, by cluster: its vectors' sum in each place, and their number at place -1."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if len(batch):
                x = _rows(batch)
                at, _ = _assigned(x, centroids)
                n += np.bincount(at, minlength=len(n))
                for c in np.unique(at):
                    sums[c] += x[at == c].sum(axis=0)
        c = np.flatnonzero(n)
        place = np.tile(np.arange(-1, sums.shape[1]), len(c))
        total = np.concatenate([n[c, None], sums[c]], axis=1)
        yield pd.DataFrame({"cluster": np.repeat(c, sums.shape[1] + 1), "place": place, "total": total.ravel()})

    return scan


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floored means of their vectors; a centroid without vectors stays."""
    parts = rows.select("v").mapInPandas(_summed(centroids), "cluster int, place int, total long")
    merged = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    told = {(r.cluster, r.place): int(r.total) for r in merged.collect()}  # clusters * (components + 1) numbers
    out = centroids.copy()
    for c in range(len(out)):
        if n := told.get((c, -1)):
            out[c] = [told[c, i] // n for i in range(out.shape[1])]
    return out


def _hash_order(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def cluster(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, steps: int = 1024, key: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """Each kept vector's ``cluster`` and squared ``distance`` to its centroid, and the centroids.

    Vectors of exactly ``dim`` finite components take part, as integers
    ``floor(steps * x)``; null vectors and all others give no rows. Components
    beyond +-``LIMIT`` count as that, so that distances fit in a long. The
    centroids start as the vectors whose ids have the least hashes (equal ids
    in the order of their components; a null id counts as an empty one). Each
    round assigns every vector to its nearest centroid, ties to the lower
    number, and moves each centroid to the floored mean of its vectors; one
    without vectors stays. Then vectors are assigned once more. Repeated rows
    count each. With fewer vectors than ``clusters`` there are as many
    centroids as vectors; an empty table gives no rows and no centroids. Only
    the two named columns are read, so others may have any name.

    Integer sums don't depend on how rows are dealt, so that a lost executor or
    another number of partitions changes nothing. Only ``clusters * (dim + 1)``
    sums a partition are shuffled, whatever the size of a cluster. Rounds end
    early where the centroids no longer move: all later ones would be the same.
    """
    rows = stored(integer_vectors(vectors, dim, steps, key, vector), "integers")
    first = rows.orderBy(_hash_order(seed), "v").limit(clusters).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dim)
    for _ in range(rounds if len(first) else 0):
        before, centroids = centroids, _moved(rows, centroids)
        if (before == centroids).all():
            break

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, far = _assigned(_rows(batch), centroids)
                yield pd.DataFrame({"vec_id": batch["vec_id"].to_numpy(), "cluster": at, "distance": far})

    return stored(rows.mapInPandas(last, "vec_id long, cluster int, distance long"), "clusters"), centroids


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    sums = told.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = told.agg(F.sum("distance").alias("inertia"))
    by_cluster = sums.join(F.broadcast(named), "cluster").crossJoin(F.broadcast(total))  # one row a cluster
    return told.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(clusters: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, steps: int = 1024) -> str:
    far = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"

    def assigned(n: int) -> str:
        return f"a{n} AS MATERIALIZED (SELECT r, vec_id, any_value(v) AS v, arg_min(k, d * {clusters} + k) AS k, min(d) AS d FROM (SELECT r, vec_id, v, k, {far} AS d FROM x, c{n}) GROUP BY r, vec_id)"

    def moved(n: int) -> str:
        mean = "(s - ((s % n) + n) % n) // n"
        return (
            f"c{n} AS MATERIALIZED (SELECT c{n - 1}.k, coalesce(m.c, c{n - 1}.c) AS c FROM c{n - 1} LEFT JOIN ("
            f"SELECT k, list(({mean})::BIGINT ORDER BY i) AS c FROM (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{n - 1}, range(1, {dim + 1}) AS t(i) GROUP BY k, i) GROUP BY k) m USING (k))"
        )

    steps_sql = [f"{moved(n)}, {assigned(n)}" for n in range(1, rounds + 1)]
    return f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({steps} * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM x ORDER BY h, v LIMIT {clusters})
), {assigned(0)}, {", ".join(steps_sql)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)
"""


ORACLE = _oracle()
