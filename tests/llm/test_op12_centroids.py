import hashlib
import math
import random

import numpy as np
import pytest

from tracewright.llm import op12_centroids as op

SCHEMA = "vec_id long, embedding array<double>, label int, row string, v int"


def brute(rows, clusters, rounds, dim, steps=1024, seed=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(max(-op.LIMIT, min(op.LIMIT, x * steps))) for x in v]))
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    return sorted(((-1 if i is None else i), *nearest(v)[::-1]) for i, v in kept), centroids


def awkward(dim):
    rng = random.Random(12)
    rows = [(i, [rng.gauss(i % 3, 0.4) for _ in range(dim)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0] * (dim + 1)), (203, [None] + [0.0] * (dim - 1)), (204, [math.nan] * dim), (205, [-math.inf] * dim)]
    rows += [(206, [0.0] * dim), (207, [-0.0001] * dim), (None, [0.3] * dim), (5, rows[5][1]), (5, rows[6][1])] + [(300 + i, [1.0] * dim) for i in range(60)]
    return rows + [(400, [1e300] * dim), (401, [-1e300] + [0.0] * (dim - 1))]


@pytest.mark.parametrize(("clusters", "strip"), [(8, 4096), (3, 7), (500, 50)])
def test_equals_brute_force(spark, monkeypatch, clusters, strip):
    monkeypatch.setattr(op, "STRIP_ROWS", strip)
    rows = awkward(5)
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA).repartition(5)
    told, centroids = op.cluster(df, clusters=clusters, rounds=4, dim=5)
    want, means = brute(rows, clusters, 4, 5)
    assert centroids.tolist() == means
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in told.collect()) == want


def test_the_number_of_partitions_changes_nothing(spark):
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in awkward(4)], SCHEMA)
    one, many = (op.cluster(df.repartition(n), dim=4)[1] for n in (1, 9))
    assert (one == many).all()


def test_ties_go_to_the_lower_number_and_an_empty_centroid_stays():
    x = np.array([[0, 0], [2, 0], [4, 0]])
    at, far = op._assigned(x, np.array([[0, 0], [4, 0], [4, 0]]))
    assert at.tolist() == [0, 0, 1] and far.tolist() == [0, 4, 0]


def test_largest_distance_fits_in_a_long():
    x = np.full((1, 64), op.LIMIT)
    assert op._assigned(x, -x)[1].tolist() == [64 * 4 * op.LIMIT**2]


def test_floors_go_down(spark):
    df = spark.createDataFrame([(1, [-1.0 / 1024, 0.0]), (2, [-2.0 / 1024, 3.0 / 1024])], "vec_id long, embedding array<float>")
    assert op.cluster(df, clusters=1, dim=2)[1].tolist() == [[-2, 1]]


def test_empty_and_few(spark):
    told, centroids = op.cluster(spark.createDataFrame([], SCHEMA))
    assert told.collect() == [] and len(centroids) == 0
    told, centroids = op.cluster(spark.createDataFrame([(7, [1.0] * 64, 0, "x", 1)], SCHEMA))
    assert [tuple(r) for r in told.collect()] == [(7, 0, 0)] and centroids.tolist() == [[1024] * 64]
