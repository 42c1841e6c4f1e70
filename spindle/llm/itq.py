"""Near-duplicate vectors of equal labels: rotated binary codes, multi-index Hamming tables, cosines of originals.

Iterative quantisation: the unit vectors of a bounded sample are centred and projected onto their principal axes; then
rotation and nearest binary codes are fitted to each other in turn, and each bit is cut at its median, so that codes are
balanced. Every vector gets a code.

The codes are looked up in several tables, each keyed by a substring of the bits. Its length follows the number of
vectors of the largest label (the binary logarithm, less a few bits), so that buckets of unlike vectors stay small
however many vectors there are; the number of tables and the Hamming radius of candidates follow from the sample:
sampled vectors are moved to just the least cosine, at random, and tables are added until ``RECALL`` of these pairs meet.

First the codes alone meet, a few bytes for each vector and table. Those that have another code within the radius go on with
their vectors, and the cosines of candidates decide. A pair counts in the first table where it meets, and in no other.
Buckets of more than ``BLOCK`` vectors are cut into blocks and every pair of blocks is a group of its own, so no group is larger
than two blocks. Pairs are never rows: a group hands on, for each vector with links in it, their number and the smallest
vector that it is joined with there. Vectors that are equal component by component are one from the start, with
the number of copies as its weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.components import components
from spindle.session import keep, materialise, scratch, small_batches

LEAST_COSINE = 0.98
#: Rows of the sample that the rotation, the tables and the radius are fitted on; it bounds nothing else.
SAMPLE = 10_000
#: Components that the sample may have in all; vectors of many components come in fewer rows.
SAMPLE_VALUES = 4_000_000
#: Bits of a code, and vectors that may share a bucket by chance.
BITS, CHANCE = 64, 16
RECALL, ROUNDS, MOST_TABLES = 0.998, 30, 64
BLOCK, CHUNK = 2048, 8192
#: Hot buckets go out as a broadcast up to this number, 32 bytes each; more of them are joined by a shuffle.
BROADCAST_BUCKETS = 200_000
ONE = np.uint64(1)


class Codes:
    """The code of a dimension: mean, projection and the medians of bits."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, median: np.ndarray):
        self.mean, self.axes, self.median = mean, axes, median

    def of(self, unit: np.ndarray) -> np.ndarray:
        """A 64-bit code of each row."""
        bits = (unit - self.mean) @ self.axes > self.median
        return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fit_codes(unit: np.ndarray, rounds: int = ROUNDS, seed: int = 12) -> Codes:
    """Principal axes, then a rotation that brings the projections close to their own signs."""
    d = unit.shape[1]
    b, rng = min(BITS, d), np.random.default_rng(seed)
    if len(unit) < 2 * b:
        return unlearnt(d, seed)
    mean = unit.mean(axis=0)
    x = unit - mean
    # Of vectors longer than the sample is large, the rows say all there is to say.
    axes = np.linalg.svd(x, full_matrices=False)[2][:b].T if len(x) < d else np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :b]
    v = x @ axes
    turn = np.linalg.qr(rng.standard_normal((b, b)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = right.T @ left.T
    axes = axes @ turn
    return Codes(mean, axes, np.median(x @ axes, axis=0))


def unlearnt(d: int, seed: int = 12) -> Codes:
    """Random axes, for dimensions that the sample says too little about."""
    rng = np.random.default_rng([seed, d])
    axes = np.linalg.qr(rng.standard_normal((d, min(BITS, d))))[0] if d else np.zeros((0, 0))
    return Codes(np.zeros(d), axes, np.zeros(axes.shape[1]))


def substrings(bits: int, length: int, seed: int = 12):
    """Positions of bits for one table after the other: those of one permutation have none in common."""
    rng = np.random.default_rng([seed, bits, length])
    while True:
        order = rng.permutation(bits)
        for at in range(0, max(1, bits - length + 1), max(1, length)):
            yield np.sort(order[at : at + length]).astype(np.uint64)


def picked(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits of a substring, as a number."""
    out = np.zeros(len(codes), np.uint64)
    for k, p in enumerate(at):
        out |= ((codes >> p) & ONE) << np.uint64(k)
    return out


class Index:
    """Codes by dimension, masks of the tables' bits, and the radius of candidates."""

    def __init__(self, codes: dict[int, Codes], tables: dict[int, list[np.ndarray]], radius: dict[int, int]):
        self.codes, self.tables, self.radius = codes, tables, radius
        self.masks = {d: np.array([sum(1 << int(p) for p in t) for t in ts], np.uint64) for d, ts in tables.items()}


def _tables(bits: int, length: int, apart: np.ndarray, recall: float) -> list[np.ndarray]:
    """As many tables as it takes for so many of the pairs to meet; none, if too many were needed."""
    out: list[np.ndarray] = []
    left = apart
    for at in substrings(bits, length):
        out.append(at)
        left = left[(left & np.uint64(sum(1 << int(p) for p in at))) != 0]
        if len(left) <= (1 - recall) * len(apart):
            return out
        if len(out) == MOST_TABLES:
            return []
    return out


def fit_index(units: dict[int, np.ndarray], largest: dict[int, int], least: float, recall: float = RECALL) -> Index:
    """An index for the dimensions at hand. ``largest`` has the most vectors of one label for each of them."""
    codes, tables, radius = {}, {}, {}
    for d, n in largest.items():
        unit = units.get(d, np.zeros((0, d)))
        codes[d] = fit_codes(unit)
        bits = min(BITS, d)
        if not len(unit) or not bits:
            unit = np.eye(max(d, 1))[:, :d]
        rng = np.random.default_rng([12, d])
        near = np.repeat(unit, -(-2000 // len(unit)), axis=0)
        off = rng.standard_normal(near.shape)
        off -= (off * near).sum(axis=1, keepdims=True) * near
        off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-300)
        apart = codes[d].of(near) ^ codes[d].of(least * near + math.sqrt(max(0.0, 1 - least * least)) * off)
        radius[d] = int(np.quantile(np.bitwise_count(apart), 0.9995)) + 1
        length = min(bits, max(0, math.ceil(math.log2(max(1, n / CHANCE)))))
        # Shorter substrings meet more often: with none at all every pair meets.
        while not (found := _tables(bits, length, apart, recall)):
            length -= 1
        tables[d] = found
    return Index(codes, tables, radius)


def unit_rows(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension the rows that take part, and their unit vectors: a null, zero or unfinished vector has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return {}
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values
    x = np.asarray(values.fill_null(np.nan) if values.null_count else values).astype(np.float64)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    size = np.diff(offsets)
    ok = np.asarray(column.is_valid()) & (size > 0) & (wrong[offsets[1:]] == wrong[offsets[:-1]])
    out = {}
    for d in np.unique(size[ok]):
        at = np.flatnonzero(ok & (size == d))
        rows = x[offsets[at][:, None] + np.arange(d)]
        most = np.abs(rows).max(axis=1)
        at, rows = at[most > 0], rows[most > 0] / most[most > 0][:, None]
        if len(at):
            out[int(d)] = (at, rows / np.linalg.norm(rows, axis=1, keepdims=True))
    return out


def _code_task(shared):
    def run(source):
        index = shared.value
        for batch in source:
            code, dim = np.zeros(batch.num_rows, np.uint64), np.full(batch.num_rows, -1, np.int32)
            for d, (at, unit) in unit_rows(batch.column("vec")).items():
                code[at], dim[at] = index.codes[d].of(unit), d
            took = pa.array(dim >= 0)
            cols = [*(batch.column(c) for c in ("id", "lab", "h", "g")), pa.array(code.view(np.int64)), pa.array(dim)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "lab", "h", "g", "code", "dim"]).filter(took)

    return run


def _bucket_task(shared):
    """A row for each table that a code goes to."""

    def run(source):
        index = shared.value
        for batch in source:
            dim, code = batch.column("dim").to_numpy(), batch.column("code").to_numpy().view(np.uint64)
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                some = batch.take(pa.array(at))
                for t, bits in enumerate(index.tables[int(d)]):
                    cols = [some.column("lab"), pa.array(np.full(len(at), t, np.int32)), pa.array(picked(code[at], bits).view(np.int64)), *(some.column(c) for c in ("id", "h", "code", "dim", "copies"))]
                    yield pa.RecordBatch.from_arrays(cols, ["lab", "tab", "sub", "id", "h", "code", "dim", "copies"])

    return run


KEY = ["lab", "tab", "sub", "one", "two"]
DEALT = "lab long, tab int, sub long, one int, two int, side int, id long, h long, code long, dim int, copies long"


def runs(source, columns: list[str]):
    """Tables of whole runs of equal keys, about ``CHUNK`` rows each, and where the runs begin. Rows come sorted by key."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(table: pa.Table, last: bool):
        key = [table.column(c).to_numpy() for c in KEY]
        fresh = np.ones(table.num_rows, bool)
        if table.num_rows:
            fresh[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        starts = np.flatnonzero(fresh)
        to = table.num_rows if last else int(starts[-1]) if len(starts) else 0
        return table.slice(0, to), np.append(starts[starts < to], to), table.slice(to)

    for batch in source:
        held.append(batch.select(columns))
        n += batch.num_rows
        if n >= CHUNK:
            whole, starts, rest = cut(pa.Table.from_batches(held), False)
            if whole.num_rows:
                yield whole, starts
            held, n = rest.combine_chunks().to_batches(), rest.num_rows
            # A run longer than a chunk is at most two blocks; what is held grows until it ends.
    if held:
        whole, starts, _ = cut(pa.Table.from_batches(held), True)
        if whole.num_rows:
            yield whole, starts


def tiles(table: pa.Table, starts: np.ndarray, index: Index):
    """Rows of candidate pairs, ``(first, second)``: codes within the radius that meet in this table for the first time.

    Short runs are taken all at once, by the distance of rows in the sorted order; long ones in tiles.
    """
    code, tab, dim = table.column("code").to_numpy().view(np.uint64), table.column("tab").to_numpy(), table.column("dim").to_numpy()
    side, two, one = (table.column(c).to_numpy() for c in ("side", "two", "one"))

    def first_met(i, j, t, d):
        apart = code[i] ^ code[j]
        ok = np.bitwise_count(apart) <= index.radius[d]
        for mask in index.masks[d][:t]:
            ok &= (apart & mask) != 0
        return ok

    size = np.diff(starts)
    end = np.repeat(starts[1:], size)
    short = np.repeat((size <= 64) & (one[starts[:-1]] == two[starts[:-1]]), size) if len(size) else np.zeros(0, bool)
    groups = {(int(d), int(t)) for d, t in set(zip(dim[short].tolist(), tab[short].tolist(), strict=True))}
    for d, t in sorted(groups):
        rows = np.flatnonzero(short & (dim == d) & (tab == t))
        step = 1
        while len(rows := rows[rows + step < end[rows]]):
            ok = first_met(rows, rows + step, t, d)
            if ok.any():
                yield rows[ok], rows[ok] + step
            step += 1
    for k in np.flatnonzero(~short[starts[:-1]]) if len(size) else ():
        a, b = int(starts[k]), int(starts[k + 1])
        own = one[a] == two[a]
        left = np.arange(a, b) if own else a + np.flatnonzero(side[a:b] == 0)
        right = left if own else a + np.flatnonzero(side[a:b] == 1)
        for at in range(0, len(left), 256):
            i = left[at : at + 256]
            j = right if not own else right[right > i[0]]
            ok = first_met(i[:, None], j[None, :], int(tab[a]), int(dim[a]))
            if own:
                ok &= j[None, :] > i[:, None]
            x, y = np.nonzero(ok)
            if len(x):
                yield i[x], j[y]


def _near_task(shared):
    """Rows that have a candidate in their group."""

    def run(source):
        names = DEALT.replace(",", "").split()[::2]
        for table, starts in runs(source, names):
            near = np.zeros(table.num_rows, bool)
            for i, j in tiles(table, starts, shared.value):
                near[i] = near[j] = True
            yield from table.filter(pa.array(near)).to_batches()

    return run


class Joined:
    """Which of ``n`` rows links have joined, by rank: a row's parent is the smallest that it is known to be joined with."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.parent[i], self.parent[j]
            if (a == b).all():
                return
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while (self.parent != (up := self.parent[self.parent])).any():
                self.parent = up


def _link_task(shared, least: float):
    """For each row with links in its group, how many other vectors they go to, and the smallest row they join it with."""

    def run(source):
        names = [*DEALT.replace(",", "").split()[::2], "vec"]
        for table, starts in runs(source, names):
            n, vec = table.num_rows, unit_rows(table.column("vec"))
            unit = {d: np.zeros((n, d)) for d in vec}
            for d, (at, rows) in vec.items():
                unit[d][at] = rows
            dim, copies = table.column("dim").to_numpy(), table.column("copies").to_numpy()
            ids, h = table.column("id").to_numpy(), table.column("h").to_numpy()
            by = np.lexsort((h, ids))
            rank = np.empty(n, np.int64)
            rank[by] = np.arange(n)
            got, links = np.zeros(n, np.int64), Joined(n)
            for i, j in tiles(table, starts, shared.value):
                u = unit[int(dim[i[0]])]
                for a in range(0, len(i), 65_536):
                    x, y = i[a : a + 65_536], j[a : a + 65_536]
                    ok = np.einsum("nd,nd->n", u[x], u[y]) >= least
                    x, y = x[ok], y[ok]
                    if len(x):
                        np.add.at(got, x, copies[y])
                        np.add.at(got, y, copies[x])
                        links.join(rank[x], rank[y])
            root, at = by[links.parent[rank]], np.flatnonzero(got)
            cols = [ids[at], h[at], ids[root[at]], h[root[at]], got[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "h", "root_id", "root_h", "n"])

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: a row for each row of ``vectors``.

    Two vectors link if their labels are equal and not null, their dimensions are equal and their cosine is ``least`` or
    more. Those that are null, empty, zero or hold a null or non-finite component link with nothing, nor do rows with a
    null id, whose ``component_id`` is null and which are kept. ``component_id`` is the smallest id that links reach;
    ``kept`` says that it is the row's own. Rows that repeat an id are vectors of their own, which link with each other
    like any others; each has the links and the component of its own vector. Other columns are ignored; no rows give no rows.

    No pair below ``least`` is linked; of pairs at exactly ``least`` ``RECALL`` are found as the sample has it, of nearer
    ones more, and equal vectors always.
    """
    spark = vectors.sparkSession
    label = F.col(label_col)
    named = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).alias("vec"))
    known = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
    hashes = [F.xxhash64("label", F.size("vec")).alias("lab"), F.xxhash64("vec", "label").alias("h"), F.xxhash64(F.lit(17), "vec", "label").alias("g")]
    rows = named.where(known).select("id", "vec", *hashes)
    with scratch(spark), small_batches(spark):
        sizes = rows.where(F.size("vec") > 0).groupBy("lab", F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()
        sample = min(sample, SAMPLE_VALUES // max((r.d for r in sizes), default=1))
        some = rows.where(F.size("vec") > 0).orderBy(F.xxhash64("id", "h"), "id").select("vec").limit(sample).toArrow()
        index = fit_index({d: u for d, (_, u) in unit_rows(some.column("vec")).items()}, {r.d: r.n for r in sizes}, least)
        shared = spark.sparkContext.broadcast(index)
        coded = materialise(rows.mapInArrow(_code_task(shared), "id long, lab long, h long, g long, code long, dim int"), "coded")
        classes = materialise(coded.groupBy("lab", "h", "g").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("code").alias("code"), F.first("dim").alias("dim")), "classes")
        buckets = classes.mapInArrow(_bucket_task(shared), "lab long, tab int, sub long, id long, h long, code long, dim int, copies long")
        hot = materialise(buckets.groupBy("lab", "tab", "sub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("lab", "tab", "sub", F.ceil(F.col("n") / block).cast("int").alias("k")), "hot")
        few = hot.count() <= BROADCAST_BUCKETS
        cut = buckets.join(F.broadcast(hot) if few else hot, ["lab", "tab", "sub"], "left")
        mine = F.pmod(F.xxhash64("h", "id"), F.coalesce("k", F.lit(1))).cast("int")
        met = cut.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
        dealt = met.select("lab", "tab", "sub", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "id", "h", "code", "dim", "copies")
        near = materialise(dealt.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_near_task(shared), DEALT), "near")
        wanted = near.select("id", "h").distinct()
        vecs = rows.select("id", "h", "vec").join(wanted, ["id", "h"], "left_semi").groupBy("id", "h").agg(F.first("vec").alias("vec"))
        full = near.join(vecs, ["id", "h"]).select(*DEALT.replace(",", "").split()[::2], "vec")
        found = materialise(full.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_link_task(shared, least), "id long, h long, root_id long, root_h long, n long"), "found")
        node = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("h"))
        roots = components(found.select(node("id", "h").alias("u"), node("root_id", "root_h").alias("v")).where("u <> v"))
        links = found.groupBy("id", "h").agg(F.sum("n").alias("n"))
        ends = classes.join(links, ["id", "h"], "left").withColumn("node", F.struct("id", "h")).join(roots, "node", "left")
        ends = ends.select("lab", "h", "g", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("root.id", "id").alias("component")).where("n > 0")
        linked = keep(materialise(ends, "linked"))
        shared.destroy()
    # Rows that take no part are spread by their ids; no vector has their hashes.
    lab = F.when(known, hashes[0]).otherwise(F.xxhash64("id"))
    mine = named.select("id", lab.alias("lab"), *[F.when(known, h).alias(k) for h, k in zip(hashes[1:], ("h", "g"), strict=True)])
    got = mine.join(linked, ["lab", "h", "g"], "left")
    component = F.coalesce("component", "id")
    return got.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
