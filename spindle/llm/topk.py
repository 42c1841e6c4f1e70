"""Exact top-k search by inner product with segment statistics from coarse to fine.

A vector is cut into segments. With the mean m and the deviation s of each segment of length L, the squared distance of
q and x is at least the sum of ``L ((mq - mx)^2 + (sq - sx)^2)``. As ``2 q.x = |q|^2 + |x|^2 - |q - x|^2``, this lower
bound on the distance is an upper bound on the inner product: the sum of ``L (mq mx + sq sx)``. A pair whose bound lies
below the query's k-th best score so far is dropped; the others go on to more segments, with a sixteenth, a quarter and
half as many segments as components, and at last to the exact product, which is taken for survivors alone. A query's first k-th best score comes from the other queries, which are candidates too.

Queries go out in waves of bounded size, as broadcasts, one wave at a time: its result is written and its broadcast
destroyed before the next one is gathered. Each wave passes over all candidates where they are, and every task hands on
its best k for each query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.session import keep, materialise, scratch

WAVE, TILE_Q, TILE_X = 4096, 256, 2048
SHARES = (16, 4, 2)
SPARSE = 0.05


def segment_counts(d: int) -> list[int]:
    """Numbers of segments from coarse to fine; as many as components would be the exact product."""
    return sorted({max(1, d // x) for x in SHARES if d // x < d} if d > 1 else ())


def quantised(column: pa.Array, scale: int) -> tuple[np.ndarray, list]:
    """Rows that take part, and ``floor(scale * x)`` of their components in float64: a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.int64), []
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values
    bad = np.asarray(values.is_null())
    x = np.asarray(values.fill_null(0)).astype(np.float64)
    bad = bad | ~np.isfinite(x)
    wrong = np.concatenate([[0], np.cumsum(bad)])
    ok = np.asarray(column.is_valid()) & (wrong[offsets[1:]] == wrong[offsets[:-1]])
    x = np.floor(scale * np.where(bad, 0, x))
    return np.flatnonzero(ok), [x[a:b] for a, b in zip(offsets[:-1][ok], offsets[1:][ok], strict=True)]


def by_dimension(ids: np.ndarray, rows: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of each dimension, in ascending order of ids."""
    out = {}
    size = np.array([len(r) for r in rows], np.int64)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        at = at[np.argsort(ids[at], kind="stable")]
        out[int(d)] = (ids[at], np.stack([rows[i] for i in at]) if d else np.zeros((len(at), 0)))
    return out


def summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of segments, weighted so that products of two rows are the bound."""
    d = x.shape[1]
    edge = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))
    size = np.diff(edge)
    mean = np.add.reduceat(x, edge[:-1], axis=1) / size
    square = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, edge[:-1], axis=1)
    return np.concatenate([mean * np.sqrt(size), np.sqrt(square)], axis=1)


def _check(q: np.ndarray, x: np.ndarray) -> None:
    if q.size and x.size and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] >= 2**53:
        raise OverflowError("components are too large for exact scores")


class Best:
    """The best scores of each query so far; equal scores go to smaller ids."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()
        self.scores = [np.zeros(0, np.int64)] * len(ids)
        self.found = [np.zeros(0, np.int64)] * len(ids)
        self.counts = segment_counts(q.shape[1])
        self.levels = [summary(q, s) for s in self.counts]
        self.pairs = self.products = 0  # pairs offered, and exact products taken

    def _take(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        s, v = np.concatenate([self.scores[i], scores]), np.concatenate([self.found[i], ids])
        by = np.lexsort((v, -s))[: self.k]
        self.scores[i], self.found[i] = s[by], v[by]
        if len(by) == self.k:
            self.least[i] = max(self.least[i], s[by[-1]])

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes candidates, in ascending order of ids."""
        _check(self.q, x)
        for b in range(0, len(ids), TILE_X):
            xi, xs = ids[b : b + TILE_X], x[b : b + TILE_X]
            levels = [summary(xs, s) for s in self.counts]
            for a in range(0, len(self.ids), TILE_Q):
                self._tile(slice(a, a + TILE_Q), xi, xs, levels)

    def _tile(self, part: slice, xi: np.ndarray, xs: np.ndarray, levels: list[np.ndarray]) -> None:
        own, least = self.ids[part], self.least[part].copy()
        alive = own[:, None] != xi[None, :]
        self.pairs += int(alive.sum())
        slack = 1e-6 * (1 + np.abs(least))
        slack[~np.isfinite(slack)] = 0
        pairs = bound = None
        for mine, theirs in zip(self.levels, levels, strict=True):
            mine = mine[part]
            if pairs is None:
                bound = mine @ theirs.T
                alive &= bound >= (least - slack)[:, None]
                if alive.mean() < SPARSE:
                    pairs = np.nonzero(alive)
                    bound = bound[pairs]
            else:
                i, j = pairs
                bound = np.einsum("nd,nd->n", mine[i], theirs[j])
                held = bound >= (least - slack)[i]
                pairs, bound = (i[held], j[held]), bound[held]
        if pairs is None:
            pairs = np.nonzero(alive)
            bound = np.full(len(pairs[0]), np.inf) if bound is None else bound[pairs]
        i, j = pairs
        if not len(i):
            return
        edge = np.append(np.flatnonzero(np.append(True, i[1:] != i[:-1])), len(i))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            row, some, most = int(i[a]), j[a:b], bound[a:b]
            # Those of the highest bounds first: what they score rules out others.
            order, size = np.argsort(-most, kind="stable"), 4 * self.k
            some, most = some[order], most[order]
            while len(some):
                self._exact(part.start + row, xi, xs, some[:size])
                some, most = some[size:], most[size:]
                left = int(np.searchsorted(-most, slack[row] - self.least[part.start + row], "right"))
                some, most = some[:left], most[:left]

    def _exact(self, row: int, xi: np.ndarray, xs: np.ndarray, some: np.ndarray) -> None:
        """Exact products of a query with some candidates."""
        self.products += len(some)
        score = xs[some] @ self.q[row]
        kept = score >= self.least[row]
        if kept.any():
            self._take(row, xi[some[kept]], score[kept].astype(np.int64))


def _first_bounds(ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among the other queries, if there are so many."""
    out = np.full(len(ids), -np.inf)
    if len(ids) > k:
        _check(q, q)
        for a in range(0, len(ids), TILE_Q):
            score = q[a : a + TILE_Q] @ q.T
            score[np.arange(len(score)), np.arange(a, a + len(score))] = -np.inf
            out[a : a + TILE_Q] = np.partition(score, -k, axis=1)[:, -k]
    return out


def _task(shared, k: int, scale: int):
    def run(source):
        best = {d: Best(ids, q, k, least) for d, (ids, q, least) in shared.value.items()}
        for batch in source:
            ok, rows = quantised(batch.column("vec"), scale)
            ids = np.asarray(batch.column("id").to_numpy(zero_copy_only=False))[ok].astype(np.int64)
            for d, (xi, xs) in by_dimension(ids, rows).items():
                if d in best:
                    best[d].offer(xi, xs)
        for b in best.values():
            n = [len(s) for s in b.scores]
            if sum(n):
                out = pa.RecordBatch.from_arrays([pa.array(np.repeat(b.ids, n)), pa.array(np.concatenate(b.found)), pa.array(np.concatenate(b.scores))], ["query_id", "vec_id", "score"])
                for a in range(0, out.num_rows, 50_000):
                    yield out.slice(a, 50_000)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", wave: int = WAVE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best other rows of each query by inner product of ``floor(scale * x)``.

    All if there are fewer; equal scores go to the smaller id. Rows with a null id or vector, or with a null or
    non-finite component, take no part. A row is never its query's own candidate, nor is another row of the same id.
    Other rows that repeat an id are candidates of their own; of queries that repeat an id, the smallest vector asks.
    Vectors are compared with those of their own dimension; an empty vector scores 0 with every other. Components so
    large that scores would not be exact raise an error. Other columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    asked = rows.where(is_query).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    waves = max(1, math.ceil(asked.count() / wave))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = []
    with scratch(spark):
        for w in range(waves):
            t = asked.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == w).toArrow()
            ok, vecs = quantised(t.column("vec"), scale)
            ids = t.column("id").to_numpy()[ok].astype(np.int64) if len(ok) else np.zeros(0, np.int64)
            order = sorted(range(len(ids)), key=lambda i: (ids[i], vecs[i].tolist()))
            order = [i for n, i in enumerate(order) if not n or ids[i] != ids[order[n - 1]]]
            queries = {d: (i, q, _first_bounds(i, q, k)) for d, (i, q) in by_dimension(ids[order], [vecs[i] for i in order]).items()} if order else {}
            shared = spark.sparkContext.broadcast(queries)
            rows_ = rows.mapInArrow(_task(shared, k, scale), "query_id long, vec_id long, score long")
            ranked = rows_.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            found.append(keep(materialise(ranked, "wave")))
            shared.destroy()
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out
