"""Centroid clustering of integer vectors with adaptive distance bounds.

Vectors are held in blocks, a row each: ids, components in the narrowest integers that hold them, and each vector's state. The
state is the nearest centroid, an upper bound on the distance to it, the next few centroids in order with a lower bound
on the distance to each, and one lower bound for all the rest. Once centroids have moved, bounds are moved by how far; a
vector whose upper bound is still below all lower bounds keeps its centroid unseen. Otherwise its own distance and then
those to the centroids in order are taken exactly, which settles it if the best lies below the remainder's bound. Where
that cannot be certified either, all centroids are scanned exactly and the order is made anew. Equal distances go to the smaller
number, so every certificate is strict.

Assignments are those of exact arithmetic: distances and sums are integers, bounds are floats that leave room for rounding. A
round reads the blocks, writes them with their new state and with the sums of each centroid, and gives the old ones up; no vector
is shuffled. Only the sums of sums go to the driver: numbers of clusters and of components, whatever the rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.session import discard, keep, materialise, scratch, small_batches

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Centroids with a lower bound of their own, beside the nearest.
HELD = 3
BLOCK = 4096
#: Bounds are floats: what is certified must hold by more than this share.
SLACK = 1e-9
#: What there is no remainder to bound by: far beyond any distance, and finite so that it can be moved.
NOTHING = 1e300
NAMES = ["ids", "vecs", "width", "own", "upper", "held", "lower", "rest", "sums", "scans"]
STATE = "ids binary, vecs binary, width int, own binary, upper binary, held binary, lower binary, rest binary, sums array<struct<cluster:int,n:long,inertia:long,sum:array<long>>>, scans long"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids, ``c`` one for all rows (k rows) or some for each (n, k rows)."""
    most = x.shape[-1] * (int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))) ** 2
    if most >= 2**63:
        raise OverflowError("components are too large for exact distances")
    if c.ndim == 2 and most < 2**51:  # every partial sum of the products is then exact
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    if c.ndim == 2:
        return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    return ((x[:, None, :] - c) ** 2).sum(axis=2)


class Bounds:
    """The state of a block's vectors."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, held: np.ndarray, lower: np.ndarray, rest: np.ndarray):
        self.own, self.upper, self.held, self.lower, self.rest = own, upper, held, lower, rest
        self.exact = self.scans = 0  # distances taken, and vectors that all centroids were scanned for

    @classmethod
    def none(cls, n: int, held: int) -> Bounds:
        """Bounds that certify nothing."""
        return cls(np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, held), np.int32), np.full((n, held), -np.inf), np.full(n, -np.inf))

    def move(self, moved: np.ndarray) -> None:
        """Widens all bounds by how far their centroids have moved."""
        self.upper = (self.upper + moved[self.own]) * (1 + SLACK)
        self.lower = (self.lower - moved[self.held]) - SLACK * np.abs(self.lower)
        self.rest = self.rest - moved.max(initial=0) - SLACK * np.abs(self.rest)

    def assign(self, x: np.ndarray, c: np.ndarray) -> None:
        """Every vector's nearest centroid."""
        low = np.minimum(self.lower.min(axis=1, initial=np.inf), self.rest)
        open_ = np.flatnonzero(~(self.upper < low))
        known = open_[np.isfinite(self.upper[open_])]
        if len(known):  # the own distance may settle it
            self.upper[known] = np.sqrt(squared(x[known], c[self.own[known]][:, None, :])[:, 0]) * (1 + SLACK)
            self.exact += len(known)
            open_ = open_[~(self.upper[open_] < low[open_])]
        asked = open_[np.isfinite(self.upper[open_])] if self.held.shape[1] else open_[:0]
        if len(asked):  # the centroids in order, and nothing else, if the remainder is farther
            some = np.concatenate([self.own[asked][:, None], self.held[asked]], axis=1)
            d = squared(x[asked], c[some])
            self.exact += some.shape[1] * len(asked)
            order = np.lexsort((some, d), axis=1)
            d, some = np.take_along_axis(d, order, 1), np.take_along_axis(some, order, 1)
            sure = np.sqrt(d[:, 0]) * (1 + SLACK) < self.rest[asked]
            self._set(asked[sure], some[sure], d[sure], None)
            left = np.ones(len(x), bool)
            left[asked[sure]] = False
            open_ = open_[left[open_]]
        if len(open_):
            d = squared(x[open_], c)
            self.exact += d.size
            self.scans += len(open_)
            order = np.argsort(d, axis=1, kind="stable")
            self._set(open_, order, np.take_along_axis(d, order, 1), self.held.shape[1] + 1)

    def _set(self, at: np.ndarray, order: np.ndarray, d: np.ndarray, rest: int | None) -> None:
        """New bounds of some vectors from exact distances in order; ``rest`` is where the remainder begins, if it was scanned too."""
        far, b = np.sqrt(d), self.held.shape[1]
        self.own[at], self.upper[at] = order[:, 0], far[:, 0] * (1 + SLACK)
        self.held[at], self.lower[at] = order[:, 1 : b + 1], far[:, 1 : b + 1] * (1 - SLACK)
        if rest is not None:
            self.rest[at] = far[:, rest] * (1 - SLACK) if rest < d.shape[1] else NOTHING


def integers(column: pa.Array, dimensions: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the right number of components, none null or non-finite, and ``floor(scale * x)`` of them as integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.int64), np.zeros((0, dimensions), np.int64)
    offsets = np.asarray(column.offsets).astype(np.int64)
    at = np.flatnonzero(np.asarray(column.is_valid()) & (np.diff(offsets) == dimensions))
    values = column.values
    x = np.asarray(values.fill_null(np.nan) if values.null_count else values).astype(np.float64)
    rows = x[offsets[at][:, None] + np.arange(dimensions)]
    ok = np.isfinite(rows).all(axis=1)
    at, rows = at[ok], np.floor(scale * rows[ok])
    if rows.size and np.abs(rows).max() >= 2**62:
        raise OverflowError("components are too large for exact distances")
    return at, rows.astype(np.int64)


def _pack(ids: pa.Array, x: np.ndarray, b: Bounds, c: np.ndarray) -> pa.RecordBatch:
    """A block as a row, with the sums of its clusters."""
    distance = squared(x, c[b.own][:, None, :])[:, 0]
    width = next(w for w in (2, 4, 8) if x.size == 0 or np.abs(x).max() < 2 ** (8 * w - 1))
    sums = []
    for k in np.unique(b.own):
        mine = b.own == k
        sums.append({"cluster": int(k), "n": int(mine.sum()), "inertia": sum(distance[mine].tolist()), "sum": [int(v) for v in x[mine].sum(axis=0)]})
    binary = [x.astype(f"<i{width}").tobytes(), width, b.own.astype("<i4").tobytes(), b.upper.tobytes(), b.held.astype("<i4").tobytes(), b.lower.tobytes(), b.rest.tobytes()]
    kinds = [pa.binary(), pa.int32(), *[pa.binary()] * 5]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", ids.type)])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([ids], ["id"]))
    held = pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("inertia", pa.int64()), ("sum", pa.list_(pa.int64()))])
    cols = [pa.array([sink.getvalue().to_pybytes()], pa.binary()), *[pa.array([v], k) for v, k in zip(binary, kinds, strict=True)], pa.array([sums], pa.list_(held)), pa.array([b.scans], pa.int64())]
    return pa.RecordBatch.from_arrays(cols, NAMES)


def _unpack(batch: pa.RecordBatch, row: int, dimensions: int, held: int) -> tuple[pa.Array, np.ndarray, Bounds]:
    get = lambda c: batch.column(c)[row].as_py()
    ids = pa.ipc.open_stream(get("ids")).read_all().column("id").combine_chunks()
    x = np.frombuffer(get("vecs"), f"<i{get('width')}").reshape(len(ids), dimensions).astype(np.int64)
    f = lambda c, t, shape: np.frombuffer(get(c), t).reshape(shape).copy()
    n = len(ids)
    return ids, x, Bounds(f("own", "<i4", n), f("upper", "<f8", n), f("held", "<i4", (n, held)), f("lower", "<f8", (n, held)), f("rest", "<f8", n))


def _first_task(shared, dimensions: int, scale: int, held: int):
    """Blocks of the vectors that take part, each with its nearest first centroid."""

    def run(source):
        c = shared.value
        for batch in source:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows, x = integers(part.column("vec"), dimensions, scale)
                if len(rows):
                    b = Bounds.none(len(rows), held)
                    b.assign(x, c)
                    yield _pack(part.column("id").take(pa.array(rows)), x, b, c)

    return run


def _round_task(shared, dimensions: int, held: int):
    def run(source):
        c, moved = shared.value
        for batch in source:
            for row in range(batch.num_rows):
                ids, x, b = _unpack(batch, row, dimensions, held)
                b.move(moved)
                b.assign(x, c)
                yield _pack(ids, x, b, c)

    return run


def _final_task(shared, dimensions: int, held: int):
    def run(source):
        c, inertia, digests = shared.value
        for batch in source:
            for row in range(batch.num_rows):
                ids, x, b = _unpack(batch, row, dimensions, held)
                distance = squared(x, c[b.own][:, None, :])[:, 0]
                cols = [ids, pa.array(b.own), pa.array(distance), pa.array(inertia[b.own]), pa.array(np.full(len(x), inertia.sum())), pa.array([digests[k] for k in b.own.tolist()])]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


def _totals(blocks: DataFrame, clusters: int, dimensions: int) -> tuple[list[int], list[list[int]], list[int]]:
    """Counts, sums and inertias of all clusters; a row for each cluster and component comes to the driver."""
    each = blocks.select(F.explode("sums").alias("s"))
    parts = each.select("s.cluster", F.posexplode(F.concat("s.sum", F.array("s.n", "s.inertia"))).alias("at", "v"))
    got = [[0] * (dimensions + 2) for _ in range(clusters)]
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        got[r["cluster"]][r["at"]] = int(r["v"])
    return [x[-2] for x in got], [x[:-2] for x in got], [x[-1] for x in got]


def cluster(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, held: int = HELD, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of all vectors that take part.

    These have ``dimensions`` components, none null or non-finite; they count as ``floor(scale * x)``. The first centroids
    are those whose ids have the smallest SHA-256 of seed and id (a null id counts as no digits; of rows that repeat an id the smaller
    vector comes first); if there are fewer vectors than ``clusters``, there are as many centroids as vectors. After each
    of ``rounds`` assignments a centroid becomes the floor of its vectors' mean, component by component; one without
    vectors stays. Then vectors are assigned once more. Ties go to the smaller number. Equal vectors, repeated ids and
    null ids are rows of their own. Other columns are ignored; no rows give no rows. Components so large that distances
    would not be exact raise an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    kind = rows.schema["id"].dataType.simpleString()
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    with scratch(spark), small_batches(spark):
        first = rows.where((F.size("vec") == dimensions) & finite).orderBy(digest, "vec").select("vec").limit(clusters).toArrow()
        c = integers(first.column("vec"), dimensions, scale)[1]
        k = len(c)
        if not k:
            return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        held = min(held, k - 1)
        blocks = None
        for _ in range(rounds + 1):
            shared = spark.sparkContext.broadcast(c if blocks is None else (c, moved))
            before = blocks
            if before is None:
                blocks = materialise(rows.mapInArrow(_first_task(shared, dimensions, scale, held), STATE), "blocks")
            else:
                blocks = materialise(before.mapInArrow(_round_task(shared, dimensions, held), STATE), "blocks")
                discard(before)
            shared.destroy()
            counts, sums, inertia = _totals(blocks, k, dimensions)
            last, c = c, np.array([[v // n for v in s] if n else old.tolist() for n, s, old in zip(counts, sums, c, strict=True)], np.int64)
            # The square of a float's distance may be off by a little, so that is added.
            moved = np.sqrt(squared(c, last[:, None, :])[:, 0]) * (1 + SLACK)
        if max(inertia) >= 2**63 or sum(inertia) >= 2**63:
            raise OverflowError("the inertia is too large for a long")
        digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in last.tolist()]
        shared = spark.sparkContext.broadcast((last, np.array(inertia, np.int64), digests))
        return keep(materialise(blocks.mapInArrow(_final_task(shared, dimensions, held), f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), "clusters"))
