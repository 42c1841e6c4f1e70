"""Top-k search against all pairs."""

import math
import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spindle.llm import topk


def brute(rows, k=20):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for i, q in asked.items():
        s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok if j != i and len(v) == len(q))
        out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


def data(d, n=400):
    rng = random.Random(d)
    hot = [rng.gauss(0, 0.2) for _ in range(d)]
    rows = [(i, hot if i % 3 == 0 else [rng.choice([rng.gauss(0, 0.2), round(rng.gauss(0, 0.1), 1)]) for _ in range(d)]) for i in range(n)]
    bad = [(1001, None), (1020, [None] * d), (None, hot), (1040, [float("nan")] * d), (1060, [float("inf")] * d), (1080, []), (1081, []), (1100, [0.5, -0.25]), (1101, [1.0, 1.0])]
    return rows + bad + [rows[0], rows[20], (40, [0.3] * d), rows[7]]


@pytest.mark.parametrize("d,wave", [(64, 4096), (33, 5), (3, 4096)])
def test_against_all_pairs(spark, monkeypatch, d, wave):
    rows = data(d)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0, wave=wave).collect())
    assert got == brute(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 8192)]
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.search(df.where("vec_id = 1"), F.col("vec_id") % 20 == 0).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    x = np.floor(np.cumsum(rng.normal(0, 9, (300, 64)), axis=1))
    exact = x @ x.T
    last = None
    for s in topk.segment_counts(64):
        bound = topk.summary(x, s) @ topk.summary(x, s).T
        assert (bound >= exact - 1e-6 * np.abs(exact) - 1e-6).all()
        assert last is None or (bound <= last + 1e-6 * np.abs(last)).all()
        last = bound
    assert (last[0] < np.sort(exact[0])[-20]).mean() > 0.5


def test_products_are_for_survivors(sf):
    """On the table the bounds rule out a third of all pairs before an exact product is taken."""
    path = f"{os.path.dirname(sf)}/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no larger table")
    t = pq.read_table(path)
    ok, rows = topk.quantised(t.column("embedding"), 64)
    ids, x = next(iter(topk.by_dimension(t.column("vec_id").to_numpy()[ok].astype(np.int64), rows).values()))
    asked = ids % 20 == 0
    best = topk.Best(ids[asked], x[asked], 20, topk._first_bounds(ids[asked], x[asked], 20))
    best.offer(ids, x)
    assert best.pairs == asked.sum() * (len(ids) - 1) and 0 < best.products < 0.7 * best.pairs
    assert topk.segment_counts(64) == [4, 16, 32] and topk.segment_counts(3) == [1] and topk.segment_counts(1) == [] and topk.segment_counts(12) == [1, 3, 6]


def test_overflow(spark):
    df = spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.search(df, F.col("vec_id") % 20 == 0).collect()
