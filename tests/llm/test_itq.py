"""Near-duplicate vectors against all pairs."""

import math
import random

import numpy as np
import pytest

from spindle.llm import itq


def brute(rows, least=0.98):
    """``(vec_id, n_links, component_id, kept)`` of rows that repeat no id."""
    ok = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in ok}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    near = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                near[a].add(b)
                near[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        c = None if i is None else min(rows[x][0] for x in seen)
        out.append((i, len(near[k]), c, c is None or c == i))
    return sorted(out, key=repr)


def turned(rng, v, cosine):
    """A vector at a given cosine to another one."""
    off = np.array([rng.gauss(0, 1) for _ in v])
    off -= off @ v / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * off / np.linalg.norm(off)


def corpus(d=24):
    rng, rows = random.Random(d), []
    for i in range(120):
        v = np.array([rng.gauss(0, 1) for _ in range(d)])
        rows.append((v, i % 4))
        if i % 3 == 0:
            rows += [(turned(rng, v, c), i % 4) for c in (0.97, 0.979, 0.981, 0.99)]
        if i % 10 == 0:
            rows += [(v.copy(), i % 4), (2.5 * v, i % 4), (v.copy(), 9), (v.copy(), None), (-v, i % 4)]
    chain = rows[0][0]
    for _ in range(12):  # a chain whose ends are far apart
        chain = turned(rng, chain, 0.985)
        rows.append((chain, 0))
    centre = np.array([rng.gauss(0, 1) for _ in range(d)])
    rows += [(turned(rng, centre, rng.uniform(0.985, 0.9999)), 2) for _ in range(150)] + [(centre, 2)] * 40
    rng.shuffle(rows)
    out = [(7 * k + 3, [float(x) for x in v], lab) for k, (v, lab) in enumerate(rows)]
    out += [(90_000 + k, v, 1) for k, v in enumerate([None, [], [0.0] * d, [None] * d, [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [1.0], [2.0], [-3.0], [1e300] * d, [2e300] * d, [1e-300] * d, [1.0, 0.0], [1.0, 0.01]])]
    return out + [(None, out[0][1], out[0][2]), (None, None, None)]


SCHEMA = "vec_id long, embedding array<double>, label int, n_links int, lab string, component_id int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("block", [2048, 16])
def test_against_all_pairs(spark, block):
    """Also with blocks so small that most buckets are cut."""
    rows = corpus()
    got = sorted(map(tuple, itq.near_duplicates(frame(spark, rows).repartition(5), block=block).collect()), key=repr)
    want = brute(rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sum(g[1] for g in got) >= 0.998 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[2:] != w[2:] for g, w in zip(got, want, strict=True)) <= 0.002 * len(want)


def test_recall_at_the_least_cosine(spark):
    """Pairs just above the threshold, the hardest there are, in a table whose substrings are as long as a larger table's."""
    rng = random.Random(5)
    base = [np.array([rng.gauss(0, 1) for _ in range(64)]) for _ in range(1500)]
    rows = [(2 * k + j, [float(x) for x in v], 0) for k, b in enumerate(base) for j, v in enumerate((b, turned(rng, b, 0.98001)))]
    links = sum(r.n_links for r in itq.near_duplicates(frame(spark, rows)).collect())
    assert 0.99 * len(rows) <= links <= len(rows) + 2


def test_repeated_ids_ties_and_none(spark):
    a, b = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    got = sorted(map(tuple, itq.near_duplicates(frame(spark, [(5, a, 1), (5, a, 1), (5, b, 1), (2, b, 1), (9, a, 2)])).collect()))
    assert got == [(2, 1, 2, True), (5, 1, 2, False), (5, 1, 5, True), (5, 1, 5, True), (9, 0, 9, True)]
    assert itq.near_duplicates(frame(spark, []).coalesce(1)).collect() == []
    assert [tuple(r) for r in itq.near_duplicates(frame(spark, [(1, None, None)])).collect()] == [(1, 0, 1, True)]


def test_codes_are_balanced_and_closer_than_random():
    """Half of the rows have each bit set, and like vectors differ in fewer bits than by random axes."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 48)) * np.linspace(3, 0.2, 48) + 0.5
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit + 0.05 * rng.standard_normal(unit.shape)
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    learnt = itq.fit_codes(unit)
    code = learnt.of(unit)
    shares = [((code >> np.uint64(k)) & np.uint64(1)).mean() for k in range(48)]
    assert all(abs(s - 0.5) < 0.01 for s in shares)
    assert np.allclose(learnt.axes.T @ learnt.axes, np.eye(48), atol=1e-9)
    quantised = lambda c: np.square(np.where((p := (unit - learnt.mean) @ c.axes) > 0, 1, -1) / np.sqrt(48) - p / np.sqrt((p**2).sum(axis=1, keepdims=True))).sum(axis=1).mean()
    assert quantised(learnt) < quantised(itq.Codes(learnt.mean, itq.unlearnt(48).axes, 0))


def test_vectors_longer_than_the_sample():
    rng = np.random.default_rng(6)
    unit = rng.standard_normal((150, 1000))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    c = itq.fit_codes(unit)
    assert c.axes.shape == (1000, 64) and np.allclose(c.axes.T @ c.axes, np.eye(64), atol=1e-9)
    near = unit + 0.002 * rng.standard_normal(unit.shape)
    assert np.bitwise_count(c.of(unit) ^ c.of(near)).mean() < 8


def test_every_pair_of_a_run_once():
    """Candidates come from the first table that they meet in, whatever the run's length."""
    import pyarrow as pa

    codes = {3: itq.unlearnt(3)}
    index = itq.Index(codes, {3: [np.array([0], np.uint64), np.array([1], np.uint64)]}, {3: 64})
    for n in (5, 200):
        for t, met in ((0, lambda a, b: True), (1, lambda a, b: (a ^ b) & 1)):
            code = np.arange(n, dtype=np.int64) & 7 & ~(1 << t)  # a run has one bucket
            cols = {"code": code, "tab": np.full(n, t, np.int32), "dim": np.full(n, 3, np.int32), "side": np.zeros(n, np.int32), "one": np.zeros(n, np.int32), "two": np.zeros(n, np.int32)}
            pairs = [(int(a), int(b)) for i, j in itq.tiles(pa.table(cols), np.array([0, n]), index) for a, b in zip(i, j, strict=True)]
            assert len(pairs) == len(set(pairs))
            assert set(pairs) == {(a, b) for a in range(n) for b in range(a + 1, n) if met(int(code[a]), int(code[b]))}
