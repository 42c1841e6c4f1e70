"""Exact Jaccard join of word-shingle sets by grouped prefixes, and the classes of linked documents.

Sets with a Jaccard similarity of at least t share a token among the first ``n - ceil(t n) + 1`` tokens of each, in any
order of tokens that holds for all sets. The order here puts the tokens that most documents share last.

1. Counts. Every shingle of every document is counted. Map tasks count locally and send packed key lists by key range.
   The most frequent tokens, at most ``heavy_tokens`` of them, make up the broadcast part of the order; all others
   come before them by hash. A shorter table would only make lists longer, never lose a link.
2. Groups. Documents with the same prefix and size are one group. Map tasks send (token, group) once per group.
   A list of a token's groups is cut where the sizes of neighbours differ by more than t allows.
3. Blocks. Groups that share lists get a common label and are dealt into blocks of bounded size by label and size
   class. Two blocks are compared if some list has groups of both and their size classes can match.
4. Members. Groups expand to their distinct sets, one per class of equal sets. A task gets two blocks, so no pair is
   ever a row. First it sees the sets as bits, each the parity of how many tokens hash to its place: two sets differ in
   at least as many tokens as bits, which bounds their overlap. Only sets with a partner within the bound are then sent
   whole, and all overlaps in two blocks are counted by matrix products. The result is a forest of links, and a degree
   for each set.
5. Classes. Components of the links, by joins.

Shingles and sets are compared as 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.components import components
from spindle.llm.textscan import batches, shingle_sets
from spindle.session import discard, keep, materialise, scratch

FLUSH = 500_000
BLOOM_BITS = (16, 30)  # at least and at most; sixteen bits a candidate between
BROADCAST_ROWS = 200_000  # of three numbers each
BLOCK_SETS, BLOCK_SHINGLES = 512, 500_000
#: Bytes of text that a key range stands for, and blocks of one list that are paired at a time.
RANGE_BYTES, LIST_BLOCKS = 32 << 20, 256


def pack(x: np.ndarray) -> bytes:
    """Bytes of sorted 32-bit values as differences in planes, which the shuffle's compression shrinks."""
    d = np.diff(x, prepend=x[:1] * 0).astype(np.uint32)
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(b: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(d, dtype=np.uint64)


def _ranges(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.arange(1 << bits), np.append(np.searchsorted(keys, edges), len(keys))


def _low(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the leading ``bits``."""
    return ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def range_bits(text_bytes: int) -> int:
    """Leading bits of a key that name its range: ranges grow in number with the text, so that none outgrows a task."""
    return max(7, math.ceil(math.log2(max(1, text_bytes / RANGE_BYTES))))


def flush_after(bits: int) -> int:
    """Tokens that a map task holds before it sends them: some for each range, or a row would have no more than one."""
    return max(FLUSH, 4 << bits)


def _count_task(k: int, bits: int):
    def run(source):
        held, n, most = [], 0, flush_after(bits)

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            at, edges = _ranges(keys, bits)
            rows = [(int(i), pack(_low(keys[a:b], bits)), counts[a:b].astype(np.uint32).tobytes()) for i, a, b in zip(at, edges[:-1], edges[1:], strict=True) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "keys", "counts"])

        for batch in batches(source, ["text"]):
            for s in shingle_sets(batch.column("text"), k):
                if len(s):
                    held.append(s)
                    n += len(s)
                    if n >= most:
                        yield flush()
                        held, n = [], 0
        if held:
            yield flush()

    return run


def _frequent(least: int):
    """Tokens of a key range that at least so many documents have."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(x.as_py()) for x in table.column("keys")])
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")])
        keys, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, counts).astype(np.int64)
        keep = total >= least
        key = (np.uint64(table.column("bucket")[0].as_py()) << np.uint64(32)) + keys[keep]
        return pa.table({"key": key.astype(np.int64), "times": total[keep]})

    return run


class Order:
    """The order of tokens: frequent ones last, by their counts; others by hash."""

    def __init__(self, keys: np.ndarray, times: np.ndarray, bits: int):
        at = np.argsort(keys)
        self.keys, self.times, self.bits = keys[at].astype(np.uint64), times[at], bits
        self.shift = np.uint64(max(0, 32 + bits - 22))
        self.maybe = np.zeros(1 << 22 if 32 + bits >= 22 else 1 << (32 + bits), bool)
        self.maybe[(self.keys >> self.shift).astype(np.int64)] = True

    def prefix(self, s: np.ndarray, length: int) -> np.ndarray:
        """The first tokens of a sorted set."""
        key = s >> np.uint64(32 - self.bits)
        hit = np.flatnonzero(self.maybe[(key >> self.shift).astype(np.int64)]) if len(self.keys) else ()
        if not len(hit):
            return s[:length]
        at = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
        times = np.zeros(len(s), np.int64)
        times[hit] = np.where(self.keys[at] == key[hit], self.times[at], 0)
        return s[np.lexsort((s, times))[:length]]


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


ROWS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("node", pa.int64()), ("grp", pa.int64()), ("bits", pa.binary()), ("bucket", pa.int32()), ("keys", pa.binary()), ("groups", pa.binary()), ("sizes", pa.binary())])


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def node_of(s: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(s.tobytes()))


def parities(s: np.ndarray) -> bytes:
    """Twice to four times as many bits as tokens, at least 64: the parity of the number of tokens at each place."""
    b = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1).tobytes()


def folded(marks: list[bytes]) -> np.ndarray:
    """Parities as words, all folded to the shortest of them."""
    least, out = min(map(len, marks)), []
    for m in marks:
        x = np.frombuffer(m, np.uint8)
        while len(x) > least:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out.append(x)
    return np.stack(out).view(np.uint64)


def _prefix_task(k: int, num: int, den: int, bits: int, order):
    """Rows of kind 0 (a document's size, set and group) and kind 1 (tokens with their groups, by key range)."""

    def run(source):
        rank, seen, tokens, groups, sizes, n = order.value, set(), [], [], [], 0
        limit = flush_after(bits)

        def flush():
            t, g, z = np.concatenate(tokens), np.array(groups, np.int64), np.array(sizes, np.uint32)
            each = np.repeat(np.arange(len(g)), [len(x) for x in tokens])
            at = np.argsort(t, kind="stable")
            t, each = t[at], each[at]
            rows, edges = _ranges(t, bits)
            cols: dict[str, list] = {x: [] for x in ("bucket", "keys", "groups", "sizes")}
            for i, a, b in zip(rows, edges[:-1], edges[1:], strict=True):
                if b > a:
                    for name, v in (("bucket", int(i)), ("keys", pack(_low(t[a:b], bits))), ("groups", g[each[a:b]].tobytes()), ("sizes", z[each[a:b]].tobytes())):
                        cols[name].append(v)
            m = len(cols["bucket"])
            return pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(cols["bucket"], pa.int32()), pa.array(cols["keys"], pa.binary()), pa.array(cols["groups"], pa.binary()), pa.array(cols["sizes"], pa.binary())], schema=ROWS)

        for batch in batches(source, ["text"]):
            ns, nodes, grps, marks = [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                ns.append(len(s))
                if not len(s):
                    nodes.append(None)
                    grps.append(None)
                    marks.append(None)
                    continue
                p = rank.prefix(s, prefix_length(len(s), num, den))
                g = _signed(xxhash.xxh3_64_intdigest(p.tobytes(), seed=len(s)))
                nodes.append(node_of(s))
                grps.append(g)
                marks.append(parities(s))
                if g not in seen:
                    seen.add(g)
                    tokens.append(p)
                    groups.append(g)
                    sizes.append(len(s))
                    n += len(p)
            m = len(ns)
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), batch.column("doc_id").cast(pa.int64()), pa.array(ns, pa.int32()), pa.array(nodes, pa.int64()), pa.array(grps, pa.int64()), pa.array(marks, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], schema=ROWS)
            if n >= limit:
                yield flush()
                seen, tokens, groups, sizes, n = set(), [], [], [], 0
        if n:
            yield flush()

    return run


def _lists(num: int, den: int):
    """Lists of two groups or more in a key range, cut at gaps between sizes; equal lists once."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack(x.as_py()) for x in table.column("keys")])
        g = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("groups")])
        z = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("sizes")]).astype(np.int64)
        at = np.lexsort((g, z, keys))
        keys, g, z = keys[at], g[at], z[at]
        keep = np.ones(len(keys), bool)
        keep[1:] = (keys[1:] != keys[:-1]) | (g[1:] != g[:-1])
        keys, g, z = keys[keep], g[keep], z[keep]
        cut = np.ones(len(keys), bool)
        cut[1:] = (keys[1:] != keys[:-1]) | (den * z[:-1] < num * z[1:])
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(keys)))
        hub = np.minimum.reduceat(g, start) if len(start) else g
        mark = np.add.reduceat(xx(g), start) if len(start) else np.zeros(0, np.uint64)
        _, once = np.unique(np.stack([mark, length.astype(np.uint64)]), axis=1, return_index=True) if len(start) else (0, np.zeros(0, np.int64))
        pick = np.zeros(len(start), bool)
        pick[once] = True
        pick &= length > 1
        rows = np.repeat(pick, length)
        return pa.table({"list": np.repeat(mark, length)[rows].astype(np.int64), "grp": g[rows], "n": z[rows].astype(np.int32), "hub": np.repeat(hub, length)[rows]})

    return run


def xx(g: np.ndarray) -> np.ndarray:
    from spindle.llm.textscan import mix

    return mix(g.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _set_task(k: int, bloom):
    """Sets of the documents that may be in the candidates' table of bits."""

    def run(source):
        bits = bloom.value
        for batch in source:
            pos = batch.column("pos").to_numpy(zero_copy_only=False)
            keep = (bits[pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1)
            batch = batch.filter(pa.array(keep.astype(bool)))
            if not batch.num_rows:
                continue
            for part in batches([batch], ["text"]):
                sets = [s for s in shingle_sets(part.column("text"), k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "tokens"])

    return run


def _screen(num: int, den: int):
    """The sets in two blocks that have a partner there whose overlap is not ruled out by the parities."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        sets = [_members(table, i) for i in range(len(blocks))]
        words = folded([x for m in sets for x in m.field("bits").to_pylist()])
        size = np.concatenate([m.field("n").to_numpy() for m in sets]).astype(np.int64)
        cut = len(sets[0])
        left, right = np.arange(cut), np.arange(cut if len(sets) > 1 else 0, len(size))
        some = np.zeros(len(size), bool)
        rows = max(1, (1 << 20) // (len(right) * words.shape[1]))
        for a in range(0, cut, rows):
            i = left[a : a + rows]
            differ = np.bitwise_count(words[i][:, None, :] ^ words[right][None, :, :]).sum(axis=2, dtype=np.int64)
            both = size[i][:, None] + size[right][None, :]
            most = (both - differ) // 2
            near = (den * most >= num * (both - most)) & (i[:, None] != right[None, :])
            some[i] |= near.any(axis=1)
            some[right] |= near.any(axis=0)
        masks = [some[:cut], some[cut:]][: len(sets)]
        keep = [i for i, m in enumerate(masks) if m.any()]
        pair = table.column("pair")[0].as_py()
        return pa.table({"pair": pa.array([pair] * len(keep), pa.int64()), "block": pa.array([blocks[i] for i in keep], pa.int64()), "mask": pa.array([np.packbits(masks[i]).tobytes() for i in keep], pa.binary())})

    return run


def _members(table: pa.Table, i: int) -> pa.StructArray:
    """The sets of a block, which a row holds as an array ordered by node."""
    return table.column("sets")[i].values


def _either(table: pa.Table) -> pa.Table:
    """A block's masks in one."""
    masks = [np.frombuffer(x.as_py(), np.uint8) for x in table.column("mask")]
    return pa.table({"block": table.column("block")[:1], "mask": pa.array([np.bitwise_or.reduce(masks).tobytes()], pa.binary())})


def _marked(source):
    """The nodes of blocks that a mask has."""
    for batch in source:
        for i in range(batch.num_rows):
            sets = batch.column("sets")[i].values
            on = np.flatnonzero(np.unpackbits(np.frombuffer(batch.column("mask")[i].as_py(), np.uint8))[: len(sets)])
            node = sets.field("node").take(pa.array(on))
            yield pa.RecordBatch.from_arrays([node, pa.array([batch.column("block")[i].as_py()] * len(on), pa.int64())], ["node", "block"])


def _compare(num: int, den: int):
    """Links within two blocks: each linked set with the smallest set linked to it here, and the copies it links to."""

    def run(table: pa.Table) -> pa.Table:
        blocks = [_members(table, i) for i in range(table.num_rows)]
        block = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
        node, copies = (np.concatenate([b.field(c).to_numpy() for b in blocks]) for c in ("node", "copies"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for b in blocks for x in b.field("tokens")]
        size = np.array([len(s) for s in sets], np.int64)
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        by = np.argsort(every, kind="stable")
        every, owner = every[by], owner[by]
        fresh = np.ones(len(every), bool)
        fresh[1:] = every[1:] != every[:-1]
        word = np.cumsum(fresh) - 1
        shared = np.bincount(word)[word] > 1
        word, owner = word[shared], owner[shared]
        if len(word):
            word = np.cumsum(np.append(True, word[1:] != word[:-1])) - 1
        common = np.zeros((len(sets), len(sets)), np.float32)
        wide = 4096
        edges = np.searchsorted(word, np.arange(0, (int(word[-1]) if len(word) else -1) + wide + 1, wide))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                m = np.zeros((len(sets), wide), np.float32)
                m[owner[a:b], word[a:b] - i * wide] = 1
                common += m @ m.T
        common = common.astype(np.int64)
        link = den * common >= num * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(link, False)
        if len(blocks) > 1:
            link &= block[:, None] != block[None, :]  # each block is compared with itself elsewhere
        root = np.arange(len(sets))
        while True:
            near = np.where(link, root[None, :], len(sets)).min(axis=1)
            new = np.minimum(root, near)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        some = link.any(axis=1)
        return pa.table({"node": node[some], "root": node[root][some], "links": (link @ copies)[some].astype(np.int64)})

    return run


def _heavy(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens: all above a power of the fourth root of two that keeps them at ``most`` or fewer."""
    step = F.floor(4 * F.log2("times")).cast("int")
    found = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for s, n in found:
        if total + n > most:
            break
        total, least = total + n, s
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = counts.where(step >= least).toArrow()
    return t.column("key").to_numpy(), t.column("times").to_numpy()


def block_pairs(in_list: DataFrame, most: int = LIST_BLOCKS) -> DataFrame:
    """``(x, y)``: the blocks that some list has groups of and whose size classes are equal or next to each other, once each.

    A list of more than ``most`` blocks is cut into parts of about as many, and every two parts are taken by themselves, so
    that no row and no task has all blocks of a list, or all its pairs.
    """
    ats = materialise(in_list.distinct(), "listed")
    long = ats.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("list", F.ceil(F.col("n") / most).cast("int").alias("parts"))
    long = materialise(long, "long")
    cut = ats.join(F.broadcast(long) if long.count() <= BROADCAST_ROWS else long, "list", "left")
    parts = F.coalesce("parts", F.lit(1))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("at"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    one, two = F.least("mine", "other"), F.greatest("mine", "other")
    side = lambda first: F.sort_array(F.collect_list(F.when((F.col("mine") == F.col("one")) if first else (F.col("mine") == F.col("two")), F.col("at"))))
    met = cut.withColumn("one", one).withColumn("two", two).groupBy("list", "one", "two").agg(side(True).alias("xs"), side(False).alias("ys"))
    each = met.select("xs", "ys").distinct().select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
    near = each.where(F.abs(F.col("y.sc") - F.col("x.sc")) <= 1).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return near.select(F.col("x.block").alias("x"), F.col("y.block").alias("y")).distinct()


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100, heavy_tokens: int = 1 << 19, least_times: int = 4) -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)``, a row for each row of ``docs``.

    Two documents link when ``den * |A & B| >= num * |A | B|``. ``component_id`` is the smallest id that links lead to,
    ``n_links`` the number of other rows that a row links with. A null or wordless text has an empty set and links with
    nothing. Rows of equal sets link with each other; rows that repeat an id are rows of their own. A row with a null id
    links like any other, but its id names no component unless all ids of it are null. Other columns are ignored; no rows
    give no rows.
    """
    with scratch(docs.sparkSession):
        return keep(materialise(_classes(docs, id_col, text_col, k, num, den, heavy_tokens, least_times), "classes"))


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, heavy_tokens: int, least_times: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits = range_bits(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

    packed = texts.select("text").mapInArrow(_count_task(k, bits), "bucket int, keys binary, counts binary")
    counts = materialise(packed.groupBy("bucket").applyInArrow(_frequent(least_times), "key long, times long"), "counts")
    order = spark.sparkContext.broadcast(Order(*_heavy(counts, heavy_tokens), bits))

    rows = materialise(texts.mapInArrow(_prefix_task(k, num, den, bits, order), "kind int, doc_id long, n int, node long, grp long, bits binary, bucket int, keys binary, groups binary, sizes binary"), "prefixes", ["kind"])
    meta = rows.where("kind = 0").select("doc_id", "n", "node", "grp", "bits")
    posted = rows.where("kind = 1").select("bucket", "keys", "groups", "sizes")
    lists = materialise(posted.groupBy("bucket").applyInArrow(_lists(num, den), "list long, grp long, n int, hub long"), "lists")
    discard(counts)

    # Blocks of groups: by label and size class, as many as their sets and shingles need.
    sets = meta.where("node is not null").groupBy("node").agg(F.first("grp").alias("grp"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    sets = materialise(sets, "sets")
    several = sets.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n")).where("m > 1").select("grp", "n", F.col("grp").alias("hub"))
    label = lists.select("grp", "n", "hub").union(several).groupBy("grp").agg(F.min("hub").alias("label"), F.first("n").alias("n"))
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num))).cast("int")
    label = label.withColumn("sc", size_class).drop("n")
    members = materialise(sets.join(label, "grp").select("node", "grp", "n", "label", "sc"), "members")
    wanted = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    # Labels of one block need no row here, so only those of many sets do: where they are few, no label is dealt to one task.
    room = materialise(members.groupBy("label", "sc").agg(wanted.alias("blocks")).where("blocks > 1"), "room")
    room = F.broadcast(room) if room.count() <= BROADCAST_ROWS else room
    block = F.xxhash64("label", "sc", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)))).alias("block")
    placed = materialise(members.join(room, ["label", "sc"], "left").select("node", "grp", "sc", block), "blocks")

    of_group = placed.select("grp", F.struct("sc", "block").alias("at")).distinct()
    in_list = lists.select("list", "grp").union(several.select(F.col("grp").alias("list"), "grp")).join(of_group, "grp")
    pairs = block_pairs(in_list.select("list", "at"))
    sides = pairs.select(F.xxhash64("x", "y").alias("pair"), F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))

    # A block is one row from here on, so joins with pairs of blocks make no rows for their sets.
    held = placed.select("node", "block").join(sets.select("node", "n", "bits"), "node")
    held = materialise(held.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("node", "n", "bits"))).alias("sets")), "packed")
    kept = materialise(held.join(sides, "block").groupBy("pair").applyInArrow(_screen(num, den), "pair long, block long, mask binary"), "screened")
    marked = materialise(kept.select("block", "mask").groupBy("block").applyInArrow(_either, "block long, mask binary").join(held, "block").mapInArrow(_marked, "node long, block long"), "marked")

    # Whole sets of those that are left, from the texts. The table of bits has a bounded size; it only saves work.
    left = marked.join(sets, "node").select("node", "block", "least_id", "copies")
    bloom_bits = min(max(BLOOM_BITS[0], (16 * marked.count()).bit_length()), BLOOM_BITS[1])
    pos = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bloom_bits))
    words = left.select(pos("least_id").alias("pos")).groupBy(F.expr("pos div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pos % 64 as int))")).alias("b")).toArrow()
    table = np.zeros(1 << (bloom_bits - 6), np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint64)
    bloom = spark.sparkContext.broadcast(table)
    full = texts.select("text", pos("doc_id").alias("pos")).mapInArrow(_set_task(k, bloom), "node long, tokens binary")
    full = full.groupBy("node").agg(F.first("tokens").alias("tokens")).join(left.select("node", "block", "copies"), "node")
    full = full.groupBy("block").agg(F.collect_list(F.struct("node", "copies", "tokens")).alias("sets"))
    compared = materialise(full.join(kept.select("pair", "block"), "block").groupBy("pair").applyInArrow(_compare(num, den), "node long, root long, links long"), "compared")
    for used in (lists, members, placed, held, kept, marked):
        discard(used)
    degree = compared.groupBy("node").agg(F.sum("links").alias("links"))
    root = components(compared.where("node <> root"), "node", "root")

    # The smallest id of each class, and back to the rows.
    classes = sets.join(root, "node", "left").join(degree, "node", "left").select("node", "least_id", "copies", "links", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_node = classes.join(least, "root").select(F.col("node"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = meta.join(of_node, "node", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
