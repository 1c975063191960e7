import itertools
import math
import random

import numpy as np
import pytest

from tracewright.llm import op13_embedding_dedup as op

SCHEMA = "vec_id long, embedding array<double>, label int, row string, v int"


def brute(rows, similarity):
    good = {}
    for at, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = [x / max(map(abs, v)) for x in v]
            good[at] = [x / math.sqrt(math.fsum(y * y for y in u)) for x in u]
    links, root = [0] * len(rows), list(range(len(rows)))
    for a, b in itertools.combinations(good, 2):
        if len(good[a]) == len(good[b]) and math.fsum(x * y for x, y in zip(good[a], good[b], strict=True)) >= similarity:
            links[a] += 1
            links[b] += 1
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    least = {}
    for at, r in enumerate(root):
        i = rows[at][0]
        least[r] = i if least.get(r) is None else min(i, least[r])
    return sorted(str((rows[at][0], links[at], least[root[at]], rows[at][0] == least[root[at]])) for at in range(len(rows)))


def awkward(dim):
    rng = random.Random(13)
    rows = []
    for group in range(12):
        centre = [rng.gauss(0, 1) for _ in range(dim)]
        wide = rng.choice([0.05, 0.2, 0.3])
        rows += [[c + rng.gauss(0, wide) for c in centre] for _ in range(rng.randint(1, 15))]
    hot = [rng.gauss(0, 1) for _ in range(dim)]
    rows += [hot] * 40 + [[x + rng.gauss(0, 0.02) for x in hot] for _ in range(60)] + [[x * 1e200 for x in hot], [x * 1e-200 for x in hot], [-x for x in hot]]
    chain = [[math.cos(k * 0.2), math.sin(k * 0.2)] + [0.0] * (dim - 2) for k in range(30)]  # neighbours at 11 degrees
    rows += chain
    ids = rng.sample(range(1000), len(rows))
    out = list(zip(ids, rows, strict=True)) + [(2000, None), (2001, []), (2002, [0.0] * dim), (2003, [None] + hot[1:]), (2004, [math.nan] * dim), (2005, [math.inf] + hot[1:])]
    return out + [(None, hot), (2006, hot + [0.0]), (2007, hot + [0.0]), (ids[3], [1.0] + [0.0] * (dim - 1)), (2008, [-0.0] + [0.0] * (dim - 2) + [1.0]), (2009, [0.0] * (dim - 1) + [1.0])]


@pytest.mark.parametrize(("similarity", "small"), [(0.95, False), (0.95, True), (0.6, True), (1.0, False)])
def test_equals_brute_force(spark, monkeypatch, similarity, small):
    if small:  # many tiles and strips
        monkeypatch.setattr(op, "BLOCK_ROWS", 20)
        monkeypatch.setattr(op, "BLOCK_BYTES", 8 * 8 * 20)
        monkeypatch.setattr(op, "STRIP_ROWS", 7)
        monkeypatch.setattr(op, "STRIP_COLUMNS", 5)
    rows = awkward(8)
    if similarity == 1.0:
        rows = [(i, [float(round(x)) if x is not None and math.isfinite(x) and abs(x) < 9 else x for x in v] if v else v) for i, v in rows][:100]
        rows = [(i, v) for i, v in rows if v and sum(map(bool, v)) == 1]  # exact units, no rounding at the threshold
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = op.near_duplicate_vectors(df, similarity).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, similarity)


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(13)
    x = op._units(np.concatenate([rng.normal(size=(150, 33)), rng.standard_t(1, size=(150, 33))]))
    codes, scale, size, left = op.quantised(x)
    about = op._products(codes, codes) * scale[:, None] * scale
    assert (np.abs(x @ x.T - about) <= size[:, None] * left + left[:, None] * (size + left) + 1e-12).all()


def test_only_pairs_that_may_reach_the_threshold_are_computed(monkeypatch):
    """Pairs far from the threshold never get to double precision: a wrong double product would change nothing."""
    rng = np.random.default_rng(14)
    x = op._units(rng.normal(size=(200, 64)))
    part = (x, *op.quantised(x))
    wrong = (np.zeros_like(x), *op.quantised(x))
    met = op._linked(part, part, 0.95)
    assert (met == np.eye(200, dtype=bool)).all() and not op._linked(wrong, wrong, 0.95).any()
    hollow = (np.full_like(x, 1.0), *op.quantised(x))  # every double product is 64
    assert (op._linked(hollow, hollow, 0.95) == met).all()


def test_exact_products_of_many_components():
    rng = np.random.default_rng(15)
    a, b = rng.integers(-127, 128, (3, 5000), dtype=np.int8), rng.integers(-127, 128, (4, 5000), dtype=np.int8)
    assert (op._products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def test_empty(spark):
    assert op.near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    got = op.near_duplicate_vectors(spark.createDataFrame([(3, None, 0, "x", 1), (None, None, 0, "x", 1)], SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == ["(3, 0, 3, True)", "(None, 0, None, True)"]
    with pytest.raises(ValueError, match="similarity"):
        op.near_duplicate_vectors(spark.createDataFrame([], SCHEMA), 0)
