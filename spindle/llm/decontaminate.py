"""Benchmark passages in documents, found by spaced seeds and verified around the hits.

A seed is a fixed mask over consecutive words, five or six of which count. Every position of every benchmark item and of
every document gives one hash for each mask; the two sides meet on equal hashes. As masks leave words out, a passage
with some words replaced still has hits: the masks are chosen such that a passage of eight words or more has one
whichever words are replaced, as long as enough are equal. Items of fewer
words than the longest mask are looked up whole. Around each hit the item is laid over the document without gaps and the words
are compared: a passage counts if, in some stretch of at least ``least_words`` aligned words (the whole item, if it is
shorter), at least ``least_share`` of the words are equal. Words are runs of letters and digits with A-Z lower-cased.

The items' hashes are broadcast. Their size is checked: items of more than ``slice_bytes`` of text are taken in that
many slices, one after the other, over rows that are numbered and written once; a slice writes only what it found.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.textscan import NOT_ALNUM, batches, fold, mix, scan
from spindle.session import materialise

# The masks; 1 marks a word that counts.
MASKS = ("11111100", "11101011", "11010111", "10111101", "11011011", "11111", "110111", "1110011")
LEAST_WORDS, LEAST_SHARE, SLICE_BYTES = 13, 0.8, 16 << 20
#: Items of one set that are compared with a document at a time.
STEM_ITEMS = 1 << 15
_MULTIPLIER = np.uint64(0xD1342543DE82EF95)
_TABLE_BITS = 20


def seed_hashes(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The mask's hash at every position with room for it."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = out * _MULTIPLIER + h[i : n + i]
    return mix(out)


def covered(a: np.ndarray, b: np.ndarray, least_words: int, least_share: float) -> bool:
    """Whether two aligned runs of words have a stretch that counts.

    If a longer stretch counts, one of ``least_words`` to twice as many words within it does: a longer one could be cut
    in two, and one half would have as large a share. So every length up to there is tried.
    """
    n = len(a)
    if n < least_words:
        return False
    total = np.concatenate([[0], np.cumsum(a == b)])
    if total[-1] < least_share * least_words:
        return False
    return any((total[w:] - total[:-w]).max() >= least_share * w for w in range(least_words, min(n, 2 * least_words) + 1))


class Items:
    """Benchmark items as word hashes, and their seeds sorted by hash.

    Items that have the same seed at the same place are one set, and sets of the same items are one, whichever seeds they
    share: a stem that many items begin with is looked up and laid over a document once for all of them.
    """

    def __init__(self, ids: list[int], texts: list[str | None], masks: tuple[str, ...], least_words: int, least_share: float):
        w = scan(pa.array(texts, pa.string()), NOT_ALNUM)
        self.ids, self.masks, self.least_words, self.least_share = ids, masks, least_words, least_share
        self.words = [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.seeds, self._last = [], None
        # Items shorter than the longest mask, by their number of words and the hash of all of them.
        self.short: dict[int, dict[int, list[int]]] = {}
        # The items of each set, by the sum of their hashes.
        self.sets: dict[int, np.ndarray] = {}
        longest = max(map(len, masks))
        for i, x in enumerate(self.words):
            if 0 < len(x) < longest:
                self.short.setdefault(len(x), {}).setdefault(int(fold(x, len(x))[0]), []).append(i)
        for k, m in enumerate(masks):
            found = [seed_hashes(x if len(x) >= longest else x[:0], m, k + 1) for x in self.words]
            h = np.concatenate(found) if found else np.zeros(0, np.uint64)
            item = np.repeat(np.arange(len(found)), [len(x) for x in found])
            at = np.concatenate([np.arange(len(x)) for x in found]) if found else np.zeros(0, np.int64)
            by = np.lexsort((item, at, h))
            h, item, at = h[by], item[by], at[by]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1]))) if len(h) else np.zeros(0, np.int64)
            which = np.add.reduceat(mix(item.astype(np.uint64) + np.uint64(1)), first) if len(h) else np.zeros(0, np.uint64)
            end = np.append(first, len(h))[1:]
            for s, g in zip(*(x.tolist() for x in np.unique(which, return_index=True)), strict=True):
                if s not in self.sets:
                    self.sets[s] = item[first[g] : end[g]]
            maybe = np.zeros(1 << _TABLE_BITS, bool)
            maybe[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.seeds.append((h[first], which, at[first], maybe))

    def found(self, column: pa.Array) -> list[np.ndarray]:
        """The items (by place) that each document holds a passage of, in ascending order."""
        w = scan(column, NOT_ALNUM)
        out: list[list[np.ndarray]] = [[] for _ in range(len(w.first) - 1)]
        hits = []
        for k, (m, (h, which, at, maybe)) in enumerate(zip(self.masks, self.seeds, strict=True)):
            s = seed_hashes(w.hashes, m, k + 1)
            pos = np.flatnonzero(maybe[(s >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]) if len(h) else np.zeros(0, np.int64)
            lo, hi = np.searchsorted(h, s[pos], "left"), np.searchsorted(h, s[pos], "right")
            n = hi - lo
            if n.sum():
                pos, lo = np.repeat(pos, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                doc = np.searchsorted(w.first, pos, "right") - 1
                inside = pos + len(m) <= w.first[doc + 1]
                hits.append(np.stack([doc, pos - at[lo], which[lo].view(np.int64)], 1)[inside])
        for n, known in self.short.items():
            runs, keys = fold(w.hashes, n), np.array(sorted(known), np.uint64)
            at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, runs), len(keys) - 1)] == runs)
            doc = np.searchsorted(w.first, at, "right") - 1
            inside = at + n <= w.first[doc + 1]
            for d, x in zip(doc[inside].tolist(), runs[at[inside]].tolist(), strict=True):
                out[d].append(np.array(known[x], np.int64))
        for doc, start, which in np.unique(np.concatenate(hits), axis=0).tolist() if hits else ():
            items = self.sets[which % 2**64]
            held = self._covered(items, w.hashes, start, int(w.first[doc]), int(w.first[doc + 1]))
            if len(held):
                out[doc].append(held)
        return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in out]

    def _covered(self, items: np.ndarray, words: np.ndarray, start: int, a: int, b: int) -> np.ndarray:
        """Those of a set of items that count, laid over the words from ``a`` to ``b`` with their first word at ``start``."""
        if len(items) <= 8:
            like = [np.array([k]) for k in range(len(items))]
        else:
            like = [k + x for k in range(0, len(items), STEM_ITEMS) for x in self._alike(items[k : k + STEM_ITEMS], words, start, a, b)]
        out = [items[:0]]
        for group in like:
            x = self.words[items[group[0]]]
            lo, hi = max(0, a - start), min(len(x), b - start)
            if covered(x[lo:hi], words[start + lo : start + hi], min(self.least_words, len(x)), self.least_share):
                out.append(items[group])
        return np.concatenate(out)

    def _alike(self, items: np.ndarray, words: np.ndarray, start: int, a: int, b: int) -> list[np.ndarray]:
        """Items whose words are equal at the same places, in groups, without those that have too few: all compared at once."""
        size, table = self.size[items], self._table(items)
        lo, hi = max(0, a - start), np.minimum(size, b - start)
        end = int(hi.max())
        same = table[lo:end] == words[start + lo : start + end, None]
        if int(hi.min()) < end:
            same &= np.arange(lo, end)[:, None] < hi
        least = np.minimum(self.least_words, size)
        some = np.flatnonzero(np.count_nonzero(same, axis=0) >= self.least_share * least - 1e-9)
        if not len(some):
            return []
        pattern = mix(hi[some].astype(np.uint64) * np.uint64(1 << 20) + least[some].astype(np.uint64))
        for row in np.packbits(same[:, some], axis=0):
            pattern = mix(pattern + row)
        by = np.argsort(pattern, kind="stable")
        return np.split(some[by], np.flatnonzero(np.diff(pattern[by])) + 1)

    def _table(self, items: np.ndarray) -> np.ndarray:
        """The items of a set side by side, word by word; the last set's are kept, as documents that share one come together."""
        if self._last is None or not np.array_equal(self._last[0], items):
            table = np.zeros((int(self.size[items].max()), len(items)), np.uint64)
            for k, i in enumerate(items.tolist()):
                table[: self.size[i], k] = self.words[i]
            self._last = (items, table)
        return self._last[1]


def _tag_task(shared):
    """The items of each document, in ascending order of their ids."""

    def run(source):
        items = shared.value
        ids = np.array(items.ids, np.int64)
        for batch in batches(source, ["text"]):
            found = [np.unique(ids[x]) for x in items.found(batch.column("text"))]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found) if found else ids[:0]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], ["key", "items"])

    return run


def _clean_task(shared, text_col: str):
    def run(source):
        items = shared.value
        for batch in batches(source, [text_col]):
            yield batch.filter(pa.array([not len(x) for x in items.found(batch.column(text_col))], pa.bool_()))

    return run


def _slices(benchmark: DataFrame, id_col: str, text_col: str, masks, least_words: int, least_share: float, slice_bytes: int):
    """How many slices of bounded size the items make, and a broadcast of each, one after the other."""
    b = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").distinct()
    n = max(1, math.ceil((b.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / slice_bytes))

    def each():
        for k in range(n):
            rows = b.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()
            yield benchmark.sparkSession.sparkContext.broadcast(Items([r["id"] for r in rows], [r["text"] for r in rows], masks, least_words, least_share))

    return n, each()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``(doc_id, items)``: for every row of ``docs`` the sorted ids of the items that it holds a passage of.

    Null and wordless texts hold none. Items with a null id or text, or without a word, are left out; items of fewer words
    than the longest mask count where all their words stand together. Items that share an id count as one. Rows are independent:
    repeated rows give repeated rows, null ids stay null. Other columns are ignored. An empty benchmark gives empty
    arrays, no documents give no rows.
    """
    n, slices = _slices(benchmark, item_id_col, item_text_col, masks, least_words, least_share, slice_bytes)
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    if n == 1:
        return texts.mapInArrow(_tag_task(next(slices)), "key long, items array<long>").withColumnRenamed("key", "doc_id")
    numbered, hits = _in_slices(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", slices)
    items = hits.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = numbered.drop("text").join(items, "key", "left")
    return out.select("doc_id", F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def _in_slices(docs: DataFrame, text_col: str, slices) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a number ``key`` for each row, written once, and ``(key, items)`` of the rows that hold items, from all slices.

    One slice is held at a time; what it finds is written without any text.
    """
    numbered = materialise(docs.withColumn("key", F.monotonically_increasing_id()), "numbered")
    texts, hits = numbered.select("key", F.col(text_col).alias("text")), []
    for shared in slices:
        hits.append(materialise(texts.mapInArrow(_tag_task(shared), "key long, items array<long>").where(F.size("items") > 0), "hits"))
        shared.destroy()
    found = hits[0]
    for more in hits[1:]:
        found = found.unionAll(more)
    return numbered, found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no passage, with all their columns; cases as in :func:`contamination`."""
    n, slices = _slices(benchmark, item_id_col, item_text_col, masks, least_words, least_share, slice_bytes)
    if n == 1:
        return docs.mapInArrow(_clean_task(next(slices), text_col), docs.schema)
    key = next(c for c in (f"key{'_' * i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    numbered, hits = _in_slices(docs.withColumnRenamed("key", key), text_col if text_col != "key" else key, slices)
    return numbered.join(hits, "key", "left_anti").drop("key").withColumnRenamed(key, "key")
