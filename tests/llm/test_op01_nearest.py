import math
import random
import tracemalloc

import numpy as np
import pandas as pd

from tracewright.llm import op01_nearest as op

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v int"


def brute(rows, k, every):
    good = [(i, r[0], np.array(r[1], np.float32).astype(float)) for i, r in enumerate(rows) if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    out = []
    for i, q, x in good:
        if q % every == 0:
            found = []
            for j, c, y in good:
                if i != j and len(x) == len(y):
                    d = 0.0
                    for a, b in zip(y, x, strict=True):
                        d += (a - b) ** 2
                    found.append((math.sqrt(d), c, j))
            out += [(q, n, c, d) for n, (d, c, _) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_equals_brute_force_with_awkward_rows(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (400, [0.0] * 6), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (600, [math.nan] * 6), (700, [math.inf] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(100, rows[100][1])] * 3 + [(800, [1.0, 2.0]), (801, [1.0, 2.5])] + [(200, rows[7][1])]
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)
    monkeypatch.setattr(op, "BLOCK_ROWS", 16)  # many tiles
    monkeypatch.setattr(op, "BLOCK_BYTES", 8 * 6 * 32)
    monkeypatch.setattr(op, "STRIP_ROWS", 2)
    monkeypatch.setattr(op, "STRIP_COLUMNS", 11)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op.nearest(df, k=10).collect())
    assert got == brute(rows, 10, 100)


def test_distances_too_large_for_a_double_are_ties(spark):
    rows = [(0, [1e200, 0.0]), (1, [-1e200, 1.0]), (2, [3e200, 0.0]), (3, [1.0, 1.0]), (4, [1e200, 5.0]), (100, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in op.nearest(df, k=3).collect())
    inf = math.inf
    assert got == [(0, 1, 4, 5.0), (0, 2, 1, inf), (0, 3, 2, inf), (100, 1, 3, 1.0), (100, 2, 0, inf), (100, 3, 1, inf)]


def test_ties_go_to_the_smaller_id_and_few_candidates_all_come(spark):
    rows = [(0, [1.0, 0.0]), (5, [2.0, 0.0]), (3, [0.0, 0.0001]), (4, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)
    got = [(r["rank"], r.vec_id) for r in op.nearest(df).orderBy("rank").collect()]
    assert got == [(1, 4), (2, 5), (3, 3)]


def test_empty(spark):
    assert op.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert op.nearest(spark.createDataFrame([(100, [1.0], 0, "x", 1)], SCHEMA)).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 33)) * 10.0 ** rng.integers(-3, 3, (50, 1))
    codes, scale, left = op._quantised(x)
    assert np.allclose(left, np.linalg.norm(x - codes * scale[:, None], axis=1))


def test_a_tile_of_short_vectors_stays_small():
    rng = np.random.default_rng(4)
    n = op.BLOCK_BYTES // (8 * 8)  # a block's rows at eight components
    c = pd.DataFrame({"row": np.arange(n), "vec_id": np.arange(n), "v": list(rng.normal(size=(n, 8)).astype(np.float32))})
    tracemalloc.start()
    try:
        got = op._tile(c[: op.STRIP_ROWS], c, 10)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 200 << 20 and len(got) == 10 * op.STRIP_ROWS
    x = np.stack(c["v"].to_numpy()).astype(float)
    for i in (0, 100):
        want = np.argsort(np.linalg.norm(x - x[i], axis=1), kind="stable")[1:11]
        assert got.loc[got["query_row"] == i, "row"].tolist() == want.tolist()
