"""Clustering against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from spindle.llm import drake


def brute(rows, k=8, rounds=10, d=64, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v], v) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    c = [list(r[1]) for r in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c)) for _, v, _ in kept]

    for _ in range(rounds):
        got = assign()
        for j in range(len(c)):
            mine = [kept[n][1] for n, (_, y) in enumerate(got) if y == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    got = assign()
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    inertia = [sum(x for x, y in got if y == j) for j in range(len(c))]
    return sorted(((kept[n][0], y, x, inertia[y], sum(inertia), sha[y]) for n, (x, y) in enumerate(got)), key=repr)


def data(d, n=300):
    rng = random.Random(d)
    hot = [rng.gauss(0, 0.3) for _ in range(d)]
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 0.3) + (i % 5) * 0.2 for _ in range(d)]) for i in range(n)]
    bad = [(1001, None), (1002, [None] * d), (1003, [float("nan")] * d), (1004, [float("-inf")] + [0.0] * (d - 1)), (1005, []), (1006, [0.1] * (d + 1))]
    return rows + bad + [(None, [0.25] * d), (5, [0.5] * d), (5, [0.5] * d), (7, [-0.5] * d)]


SCHEMA = "vec_id long, embedding array<double>, cluster string, ids int"


@pytest.mark.parametrize("d,k,held", [(64, 8, 3), (3, 12, 2), (5, 4, 0), (2, 1, 3), (4, 9, 20)])
def test_against_integers(spark, d, k, held):
    rows = data(d)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(5)
    got = sorted(map(tuple, drake.cluster(df, clusters=k, dimensions=d, held=held).collect()), key=repr)
    assert got == brute(rows, k=k, d=d)


def test_few_none_and_large(spark):
    df = spark.createDataFrame([(1, [1.0] * 64, "", 1), (2, [1.0] * 64, "", 1), (3, [2.0] * 64, "", 1)], SCHEMA)
    assert sorted(map(tuple, drake.cluster(df).collect())) == brute([(1, [1.0] * 64), (2, [1.0] * 64), (3, [2.0] * 64)])
    assert drake.cluster(df.limit(0)).collect() == [] and drake.cluster(df, dimensions=65).collect() == []
    assert {r.cluster for r in drake.cluster(df, rounds=0).collect()} == {r[1] for r in brute([(1, [1.0] * 64), (2, [1.0] * 64), (3, [2.0] * 64)], rounds=0)}
    with pytest.raises(Exception, match="too large"):
        drake.cluster(spark.createDataFrame([(1, [1e12] * 64, "", 1), (2, [-1e12] * 64, "", 1)], SCHEMA)).collect()


def test_bounds_save_distances_and_stay_exact():
    """Rounds of moving centroids: always the exact nearest, with few distances once centroids settle."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (40, 16))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-90, 90, (3000, 16))
    c, b = x[:40].copy(), drake.Bounds.none(len(x), 3)
    b.assign(x, c)
    spent = []
    for _ in range(14):
        new = np.array([x[b.own == j].sum(axis=0) // max(1, (b.own == j).sum()) if (b.own == j).any() else c[j] for j in range(len(c))])
        b.move(np.sqrt(drake.squared(new, c[:, None, :])[:, 0]) * (1 + drake.SLACK))
        c, b.exact, b.scans = new, 0, 0
        b.assign(x, c)
        assert (b.own == drake.squared(x, c).argmin(axis=1)).all()
        d = np.sqrt(drake.squared(x, c))
        assert (b.upper >= d.min(axis=1)).all() and (b.lower <= np.take_along_axis(d, b.held, 1)).all()
        np.put_along_axis(d, np.concatenate([b.own[:, None], b.held], axis=1), np.inf, 1)
        assert (b.rest <= d.min(axis=1)).all()
        spent.append((b.exact, b.scans))
    assert spent[-1][0] < 0.05 * x.shape[0] * len(c) and spent[-1][1] < spent[0][1]


def test_ties_go_to_the_smaller_number():
    x = np.array([[0, 0], [10, 0], [5, 0]])
    b = drake.Bounds.none(3, 1)
    b.assign(x, np.array([[10, 0], [0, 0], [0, 0]]))
    assert b.own.tolist() == [1, 0, 0]
    b.move(np.array([0.0, 0.0, 0.0]))
    b.assign(x, np.array([[10, 0], [0, 0], [0, 0]]))
    assert b.own.tolist() == [1, 0, 0]
