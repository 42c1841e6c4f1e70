"""Words and word shingles of Arrow string columns, hashed with numpy over the raw UTF-8 bytes.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Separators are ASCII, so the
bytes of a longer UTF-8 sequence are never cut. A null text counts as empty. Work goes through pieces of a quarter of a
megabyte that end at a separator or at a document's end, so memory follows the largest single word, not the text.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C55)
_PINV = np.uint64(pow(int(_P), -1, 2**64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
#: Every ASCII character but letters and digits: words without punctuation.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOW = np.arange(256, dtype=np.uint64)
_LOW[65:91] += np.uint64(32)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        x = np.full(max(n, PIECE + 4096), base)
        x[0] = 1
        _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers[name]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the ``n + 1`` bounds of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


@dataclass
class Words:
    """``hashes``, ``starts`` and ``ends`` (byte positions) of all words; document d has words ``first[d]:first[d + 1]``."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def _pieces(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray):
    lo, end = int(bounds[0]), int(bounds[-1])
    while lo < end:
        hi = min(lo + PIECE, end)
        if hi < end:
            at = int(np.searchsorted(bounds, lo, "right"))
            last = int(bounds[np.searchsorted(bounds, hi, "right") - 1])
            if last > lo:
                hi = last
            else:
                stop = int(bounds[at])
                while hi < stop:
                    found = np.flatnonzero(separators[data[hi : min(hi + 65536, stop)]])
                    if len(found):
                        hi += int(found[0])
                        break
                    hi = min(hi + 65536, stop)
        yield lo, hi
        lo = hi


def scan(column: pa.Array, separators: np.ndarray = _SEP) -> Words:
    """All words of a string column. ``separators`` has 256 flags, set for ASCII bytes only."""
    data, bounds = raw(column)
    hashes, starts, ends = [], [], []
    for lo, hi in _pieces(data, bounds, separators):
        b = data[lo:hi]
        word = ~separators[b]
        fresh = np.zeros(hi - lo + 1, bool)
        fresh[bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi, "right")] - lo] = True
        fresh[0] = fresh[-1] = True
        before = np.empty(hi - lo, bool)
        before[0] = False
        before[1:] = word[:-1]
        s = np.flatnonzero(word & (~before | fresh[:-1]))
        after = np.empty(hi - lo, bool)
        after[-1] = False
        after[:-1] = word[1:]
        e = np.flatnonzero(word & (~after | fresh[1:])) + 1
        if not len(s):
            continue
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_LOW[b] * _table("p", _P, hi - lo)[: hi - lo], out=sums[1:], dtype=np.uint64)
        h = (sums[e] - sums[s]) * _table("q", _PINV, hi - lo)[s]
        hashes.append(mix(h + (e - s).astype(np.uint64) * _STEP))
        starts.append(s + lo)
        ends.append(e + lo)
    none = np.zeros(0, np.int64)
    s = np.concatenate(starts) if starts else none
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), s, np.concatenate(ends) if ends else none, np.searchsorted(s, bounds))


def fold(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= _P
        out += h[i : n + i]
    return mix(out + np.uint64(k * int(_STEP) & (2**64 - 1)))


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The sorted set of ``k``-word shingles of each document.

    Fewer than ``k`` words give one shingle of the whole sequence; no words give an empty set.
    """
    w = scan(column)
    runs = fold(w.hashes, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(fold(w.hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def tidy(keep_memos: bool) -> None:
    """Gives back what earlier tasks left in a reused worker: cycles, freed memory, and encoders' memos if none is used."""
    tokens = sys.modules.get("spindle.llm.tokens")
    if tokens is not None and not keep_memos:
        tokens.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not every C library has it


def batches(source, columns: list[str], limit: int = 2 << 20, keep_memos: bool = False):
    """Slices of record batches with at most ``limit`` bytes of text in ``columns[0]``, one row at least."""
    tidy(keep_memos)
    for batch in source:
        size, at = np.diff(raw(batch.column(columns[0]))[1]), 0
        total = np.concatenate([[0], np.cumsum(size)])
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    # An idle worker should hold little next to those that work.
    batch = size = total = None
    tidy(keep_memos)
