"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

A document is cut only where it is longer than a sequence: into whole sequences, which need no packing, and a rest.
The rests and the shorter documents are dealt into districts of about ``DISTRICT_ITEMS`` pieces. Every district is
packed by ``ISLANDS`` islands, each a row of its own, so that islands of one district run as different tasks. An
island begins with packings by first fit in random orders. A child takes some whole well-filled sequences of one parent
and keeps those of the other that share no piece with them; those that do are dissolved, what they hold is placed by best fit
among all the others, large pieces first, and nothing else moves. Then the child is mutated: its emptiest sequences and a few
others are dissolved and placed anew in the same way, and the better of the two stays. After every epoch the best packing of an island migrates to the next island of its district, through
a shuffle, and replaces the worst one there. At the end the best packing of all islands is the district's.

Then well-filled sequences stay as they are, and the poorly filled ones of all districts go, whole, to the districts
of the next level, where the packing that they came in is one of the first ones: so no level can need more sequences
than came in. Levels end when one district is left, or when a level saved less than ``LEAST_GAIN`` of its sequences.
"""

from __future__ import annotations

import bisect
import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.textscan import batches
from spindle.llm.tokens import BATCH_BYTES, WORD_VOCABULARY, encoder, vocabulary
from spindle.session import discard, keep, materialise, scratch

CAPACITY, END_ID = 2048, 0
DISTRICT_ITEMS = 4000
ISLANDS, MEMBERS, EPOCHS, GENERATIONS = 2, 4, 2, 20
#: A crossover injects at most one sequence in so many, a mutation dissolves about one in so many.
INJECTED, DISSOLVED = 8, 12
WELL_FILLED, LEAST_GAIN = 0.995, 0.001


class Packing:
    """Bins of items, and how much each holds; ``displaced`` is how many items were placed anew to make it. Bins are never changed."""

    def __init__(self, sizes: list[int], bins: list[list[int]], fills: list[int] | None = None, displaced: int = 0):
        self.bins, self.displaced = bins, displaced
        self.fills = [sum(map(sizes.__getitem__, b)) for b in bins] if fills is None else fills

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: larger is better."""
        return -len(self.bins), sum(f * f for f in self.fills)

    def places(self, n: int) -> np.ndarray:
        """The bin of each item."""
        out = np.zeros(n, np.int32)
        for k, b in enumerate(self.bins):
            out[b] = k
        return out


def from_places(sizes: list[int], places: np.ndarray) -> Packing:
    by = np.argsort(places, kind="stable")
    edge = np.flatnonzero(np.diff(places[by])) + 1
    return Packing(sizes, [x.tolist() for x in np.split(by, edge)] if len(places) else [])


def first_fit(sizes: list[int], order: list[int], capacity: int) -> list[list[int]]:
    """Places items in their order into the first bin with room: a tree has the most room below each of its nodes."""
    leaves = 1 << max(0, len(order) - 1).bit_length()
    most, bins = [capacity] * (2 * leaves), []
    for i in order:
        size, at = sizes[i], 1
        while at < leaves:
            at *= 2
            if most[at] < size:
                at += 1
        if at - leaves == len(bins):
            bins.append([])
        bins[at - leaves].append(i)
        most[at] -= size
        while at > 1:
            at //= 2
            now = max(most[2 * at], most[2 * at + 1])
            if most[at] == now:
                break
            most[at] = now
    return bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """A lower bound on bins (Martello and Toth's L2): what large items leave free cannot hold too much of the middling ones."""
    x = np.sort(np.array(sizes, np.int64))
    total = np.concatenate([[0], np.cumsum(x)])
    half = int(np.searchsorted(x, capacity // 2, "right"))
    a = np.unique(np.concatenate([[0], x[:half]]))
    big = np.maximum(np.searchsorted(x, capacity - a, "right"), half)
    low = np.searchsorted(x, a, "left")
    free = (big - half) * capacity - (total[big] - total[half])
    more = -(-np.maximum(0, total[half] - total[low] - free) // capacity)
    return int((len(x) - half + more).max())


def placed(sizes: list[int], bins: list[list[int]], fills: list[int], loose: list[int], capacity: int) -> Packing:
    """A packing of some bins and of loose items, large ones first, each in the fullest bin with room for it."""
    bins, fills, own = list(bins), list(fills), set()
    loose = sorted(loose, key=lambda i: (-sizes[i], i))
    least = sizes[loose[-1]] if loose else capacity + 1
    room = sorted((capacity - f, k) for k, f in enumerate(fills) if capacity - f >= least)
    for i in loose:
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at == len(room):
            k, left = len(bins), capacity
            bins.append([])
            fills.append(0)
            own.add(k)
        else:
            left, k = room.pop(at)
        if k not in own:
            bins[k] = list(bins[k])
            own.add(k)
        bins[k].append(i)
        fills[k] += sizes[i]
        if left - sizes[i] >= least:
            bisect.insort(room, (left - sizes[i], k))
    return Packing(sizes, bins, fills, len(loose))


def cross(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """A child of ``a`` with some well-filled bins of ``b``. Bins of ``a`` that share no item with them stay as they are."""
    full = [k for k, f in enumerate(b.fills) if f >= WELL_FILLED * capacity] or range(len(b.bins))
    taken = rng.sample(full, rng.randint(1, max(1, min(len(full), len(b.bins) // INJECTED))))
    inside = {i for k in taken for i in b.bins[k]}
    bins, fills, loose = [b.bins[k] for k in taken], [b.fills[k] for k in taken], []
    for x, f in zip(a.bins, a.fills, strict=True):
        if inside.isdisjoint(x):
            bins.append(x)
            fills.append(f)
        else:
            loose += [i for i in x if i not in inside]
    return placed(sizes, bins, fills, loose, capacity)


def mutate(a: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """``a`` with its emptiest bins and a few others dissolved and placed anew."""
    n = max(2, len(a.bins) // DISSOLVED)
    order = sorted(range(len(a.bins)), key=a.fills.__getitem__)
    gone = {*order[: n // 2 + 1], *rng.sample(order, min(len(order), n // 2))}
    stay = [k for k in range(len(a.bins)) if k not in gone]
    return placed(sizes, [a.bins[k] for k in stay], [a.fills[k] for k in stay], [i for k in sorted(gone) for i in a.bins[k]], capacity)


def child(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """A crossover, or its mutation if that is better."""
    crossed = cross(a, b, sizes, capacity, rng)
    return max(crossed, mutate(crossed, sizes, capacity, rng), key=Packing.fitness)


def settle(sizes: list[int], capacity: int, rng: random.Random, known: list[Packing]) -> list[Packing]:
    """An island's first packings: those known, and first fit in random orders."""
    out = list(known[:MEMBERS])
    while len(out) < MEMBERS:
        out.append(Packing(sizes, first_fit(sizes, rng.sample(range(len(sizes)), len(sizes)), capacity)))
    return out


def epoch(people: list[Packing], sizes: list[int], capacity: int, rng: random.Random, bound: int) -> list[Packing]:
    """Some generations of an island, the best first; ends early where a child needs no more than the lower bound."""
    people = sorted(people, key=Packing.fitness, reverse=True)
    for _ in range(GENERATIONS):
        a, b = rng.sample(people, 2)
        people += [child(a, b, sizes, capacity, rng), child(b, a, sizes, capacity, rng)]
        people.sort(key=Packing.fitness, reverse=True)
        del people[MEMBERS:]
        if len(people[0].bins) <= bound:
            break
    return people


def evolve(sizes: list[int], capacity: int, seed: int = 7, epochs: int = EPOCHS, islands: int = ISLANDS) -> list[list[int]]:
    """The same algorithm for one district at hand, without Spark."""
    if not sizes:
        return []
    bound, rngs = least_bins(sizes, capacity), [random.Random(f"{seed}/{i}") for i in range(islands)]
    held = [settle(sizes, capacity, r, []) for r in rngs]
    for k in range(epochs):
        if k:
            elite = [p[0] for p in held]
            for i, p in enumerate(held):
                p[-1] = elite[i - 1]
        held = [epoch(p, sizes, capacity, r, bound) for p, r in zip(held, rngs, strict=True)]
    return max((p[0] for p in held), key=Packing.fitness).bins


def _piece_task(path: str, capacity: int, end_id: int):
    def run(source):
        e, end = encoder(path, False), np.array([end_id], "<u4").tobytes()
        for batch in batches(source, ["text"], BATCH_BYTES, keep_memos=True):
            rows = []
            for doc, x in zip(batch.column("doc_id").to_pylist(), e.encode(batch.column("text")), strict=True):
                x += end
                for k, at in enumerate(range(0, len(x), 4 * capacity)):
                    part = x[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


ITEM = ["doc_id", "piece", "start", "length", "ids_crc32"]
DISTRICT = "district long, doc_id array<long>, piece array<int>, start array<long>, length array<long>, ids_crc32 array<long>, known binary"
PEOPLE = "district long, island int, bound int, sizes binary, people array<binary>"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, filled long"


def _district(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row for a district, its pieces in a fixed order; ``known`` numbers the sequences they came in, if any."""
    first = table.column("sequence_id").null_count == 0
    table = table.sort_by([(c, "ascending") for c in ["length", "doc_id", "piece", "start", "ids_crc32", *(["sequence_id"] if first else [])]])
    known = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)[1].astype("<i4").tobytes() if first else None
    cols = [pa.array([key[0].as_py()], pa.int64())] + [pa.array([table.column(c).to_pylist()], pa.list_(t)) for c, t in zip(ITEM, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
    return pa.Table.from_arrays([*cols, pa.array([known], pa.binary())], ["district", *ITEM, "known"])


def _settle_task(capacity: int, level: int):
    """A row for each island of each district, with its first packings."""

    def run(source):
        for batch in source:
            for k in range(batch.num_rows):
                district, island = batch.column("district")[k].as_py(), batch.column("island")[k].as_py()
                sizes = batch.column("length")[k].as_py()
                known = batch.column("known")[k].as_py()
                rng = random.Random(f"{level}/{district}/{island}")
                first = [] if known is None else [from_places(sizes, np.frombuffer(known, "<i4"))]
                bound = least_bins(sizes, capacity)
                yield _row(district, island, bound, sizes, epoch(settle(sizes, capacity, rng, first), sizes, capacity, rng, bound))

    return run


def _row(district: int, island: int, bound: int, sizes: list[int], people: list[Packing]) -> pa.RecordBatch:
    packed = [p.places(len(sizes)).astype("<i4").tobytes() for p in people]
    return pa.RecordBatch.from_arrays([pa.array([district], pa.int64()), pa.array([island], pa.int32()), pa.array([bound], pa.int32()), pa.array([np.array(sizes, "<i4").tobytes()], pa.binary()), pa.array([packed], pa.list_(pa.binary()))], ["district", "island", "bound", "sizes", "people"])


def _epoch_task(capacity: int, level: int, nth: int):
    """An epoch of each island: the guest from another island takes the place of the worst packing."""

    def run(source):
        for batch in source:
            for k in range(batch.num_rows):
                district, island, bound, sizes, people, guest = (batch.column(c)[k].as_py() for c in ("district", "island", "bound", "sizes", "people", "guest"))
                sizes = np.frombuffer(sizes, "<i4").tolist()
                rng = random.Random(f"{level}/{district}/{island}/{nth}")
                held = [from_places(sizes, np.frombuffer(x, "<i4")) for x in [*people[: MEMBERS - 1], guest]]
                yield _row(district, island, bound, sizes, epoch(held, sizes, capacity, rng, bound))

    return run


def _best_task(level: int):
    """The pieces of a district with their places in the best packing of its islands."""

    def run(source):
        for batch in source:
            for k in range(batch.num_rows):
                sizes = batch.column("length")[k].as_py()
                best = max((from_places(sizes, np.frombuffer(x, "<i4")) for x in batch.column("tops")[k].as_py()), key=Packing.fitness)
                n, at = len(sizes), batch.column("district")[k].as_py()
                seq, offset, filled = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for j, (b, f) in enumerate(zip(best.bins, best.fills, strict=True)):
                    place = 0
                    for i in b:
                        seq[i], offset[i] = (level << 56) + (at << 24) + j, place
                        place += sizes[i]
                    filled[b] = f
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[k].values for c in ITEM), pa.array(seq), pa.array(offset), pa.array(filled)], [*ITEM, "sequence_id", "offset", "filled"])

    return run


def _migrated(people: DataFrame, tasks: int) -> DataFrame:
    """Every island with ``guest``, the best packing of the island before it in its district."""
    guests = people.select("district", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.element_at("people", 1).alias("guest"))
    return people.join(guests.repartition(tasks, "district", "island"), ["district", "island"])


def _pack_level(items: DataFrame, district, capacity: int, level: int, tasks: int) -> DataFrame:
    """Packs the pieces of every district by its islands."""
    schema = ", ".join(f"{c} {t}" for c, t in (("doc_id", "long"), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")))
    rows = items.withColumn("district", district).groupBy("district")
    dealt = materialise(rows.applyInArrow(_district, DISTRICT), "districts")
    islands = dealt.select("district", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "length", "known")
    people = materialise(islands.repartition(tasks, "district", "island").mapInArrow(_settle_task(capacity, level), PEOPLE), "people")
    for nth in range(1, EPOCHS):
        moved = _migrated(people, tasks)
        before, people = people, materialise(moved.mapInArrow(_epoch_task(capacity, level, nth), PEOPLE), "people")
        discard(before)
    tops = people.groupBy("district").agg(F.collect_list(F.element_at("people", 1)).alias("tops"))
    packed = materialise(dealt.join(tops, "district").mapInArrow(_best_task(level), f"{schema}, sequence_id long, offset long, filled long"), "packed")
    discard(people)
    discard(dealt)
    return packed


def pack(docs: DataFrame, tokenizer: str = "", id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, district_items: int = DISTRICT_ITEMS) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: where each piece of each document is.

    A null or empty text is the end id alone. Rows that repeat an id are documents of their own; null ids stay null.
    Other columns are ignored. No rows give no rows. A district holds the pieces that hash to it, whatever their
    lengths; equal pieces are spread like any others.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark):
        pieces = materialise(texts.mapInArrow(_piece_task(tokenizer or vocabulary(WORD_VOCABULARY), capacity, end_id), schema), "pieces")
        done = [pieces.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
        items = pieces.where(F.col("length") < capacity).withColumn("sequence_id", F.lit(None).cast("long"))
        n, level, came = items.count(), 0, None
        # Places in the table spread equal rows over the districts; the table is written, so they do not change.
        spread = F.xxhash64(F.monotonically_increasing_id())
        while n:
            districts = math.ceil(n / district_items)
            packed = _pack_level(items, F.pmod(spread, F.lit(districts)), capacity, level, max(1, min(most, ISLANDS * districts)))
            good = F.col("filled") >= WELL_FILLED * capacity
            poor = packed.where(~good)
            left = poor.agg(F.countDistinct("sequence_id").alias("sequences"), F.count(F.lit(1)).alias("n")).first()
            made = left["sequences"] + (packed.where(good).select("sequence_id").distinct().count() if came else 0)
            if districts == 1 or came and came - made < max(1, LEAST_GAIN * came):
                done.append(packed.drop("filled"))
                break
            done.append(packed.where(good).drop("filled"))
            items, n, level, came = poor.drop("filled", "offset"), left["n"], level + 1, left["sequences"]
            spread = F.xxhash64("sequence_id")
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return keep(materialise(out, "sequences"))
