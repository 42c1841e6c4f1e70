"""Token ids by the tokenizers library, memoised by chunk, in Arrow and numpy.

Both vocabularies split a text before any merge, and both always split where white space begins after a word. A text
is cut before each space or line feed that follows anything but white space; where that is in doubt it is not cut, as
a longer chunk is as right. The distinct chunks of a batch are looked up in a memo, new ones are encoded, and the ids
of all chunks are gathered back in order. A chunk of letters, digits and then punctuation is two chunks, as both
vocabularies split there too, and for the vocabulary that knows no case it is made lower case where that is plain
(below U+0130). The memo is bounded in chunks and bytes: when it is full, what was not used for longest goes.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from spindle.llm.textscan import raw

BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Bytes of text that one call of ``encode`` should get, and chunks that are gathered at once.
BATCH_BYTES, STEP = 4 << 20, 1_000_000
#: Chunks in the memo of a worker, and their bytes with ids: what is used for longest goes above either.
MEMO, MEMO_BYTES = 300_000, 16 << 20
#: Longer chunks are not kept in the memo.
KEPT_BYTES = 64
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
# Letters of Latin (but one that is no single letter in lower case) and Cyrillic blocks, ASCII digits; ASCII punctuation but the apostrophe, which begins contractions.
_LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}"
_POINTS = r"!-&(-/:-@\[-`{-~"
_HEAD, _TAIL = rf"^[ \n]?[0-9{_LATIN}]+", rf"[{_POINTS}]+$"


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def _binary(lengths: np.ndarray, data: bytes) -> pa.Array:
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _after_space(chunks: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), chunks, pa.scalar("", pa.large_string()))


def _buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds, from 0, and bytes of a large string or binary array."""
    _, ends, data = a.buffers()
    bounds = np.frombuffer(ends, np.int64)[a.offset : a.offset + len(a) + 1]
    return bounds - bounds[0], np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]


def cut(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All chunks of a string column; document d has those from ``first[d]`` to ``first[d + 1]``."""
    data, bounds = raw(column)
    b, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    here = (b == 32) | (b == 10)
    here[1:] &= ~_WHITE[b[:-1]]
    # Bytes above ASCII before a gap may be white space too.
    at = np.flatnonzero(here[1:] & (b[:-1] >= 128)) + 1
    if len(at):
        one, two, three = (b[np.maximum(at - k, 0)] for k in (1, 2, 3))
        odd = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        odd |= (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80)
        odd |= (three == 0xE1) & ((two == 0x9A) | (two == 0xA0)) | (three == 0xEF) & (two == 0xBB)
        here[at[odd]] = False
    here[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    starts = np.flatnonzero(here)
    ends = np.append(starts, len(b)).astype(np.int64)
    chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(b))
    return chunks, np.searchsorted(starts, bounds)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids. Special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str, spaces_matter: bool, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaces_matter, self.limit = spaces_matter, memo
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.used, self.round = np.zeros(0, np.int64), 0
        # Chunks whose ids can be told apart when many are encoded as one text.
        self.simple = rf"^ [0-9{_LATIN}]+$" if spaces_matter else r"^[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+$"
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token) if spaces_matter else token.endswith("</w>")

    def _plain(self, texts: list[str], some: int):
        """The ids of each text; the library's own results, far larger than the ids, are held for ``some`` texts at a time."""
        for i in range(0, len(texts), some):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + some], add_special_tokens=False):
                yield np.array(e.ids, "<u4")

    def _many(self, chunks: pa.Array) -> pa.Array:
        """The ids of simple chunks, encoded many at a time; each by itself if tokens and chunks do not line up."""
        if not len(chunks):
            return self.ids.slice(0, 0)
        bounds, data = _buffers(chunks if self.spaces_matter else _after_space(chunks))
        some = np.append(bounds[:-1:256], bounds[-1]).tolist()
        texts = [data[a:b].tobytes().decode() for a, b in zip(some, some[1:], strict=False)]
        ids = np.concatenate(list(self._plain(texts, 32)))
        if self.spaces_matter:  # a chunk's tokens have as many bytes as the chunk
            upto = np.cumsum(self.sizes[ids])
            ends = np.searchsorted(upto, bounds[1:]) + 1
            fits = ends[-1] == len(ids) and np.array_equal(upto[ends - 1], bounds[1:])
        else:  # a run of letters ends with a token that ends words
            ends = np.flatnonzero(self.sizes[ids]) + 1
            fits = len(ends) == len(chunks) and ends[-1] == len(ids)
        if not fits:
            return self._singly(chunks)
        return _binary(4 * np.diff(ends, prepend=0), ids.tobytes())

    def _singly(self, chunks: pa.Array) -> pa.Array:
        """The ids of chunks of any kind, each a text of its own."""
        got = list(self._plain(chunks.to_pylist(), 2048))
        return _binary(4 * np.array([len(x) for x in got], np.int64), b"".join(x.tobytes() for x in got))

    def _encode(self, chunks: pa.Array) -> pa.Array:
        """The ids of each chunk by the library."""
        simple = pc.match_substring_regex(chunks, self.simple).to_numpy(zero_copy_only=False)
        singly = self._singly(chunks.filter(pa.array(~simple)))
        at = np.where(simple, np.cumsum(simple) - 1, simple.sum() + np.cumsum(~simple) - 1)
        return pa.concat_arrays([self._many(chunks.filter(pa.array(simple))), singly]).take(pa.array(at))

    def _known(self, parts: pa.Array) -> pa.Array:
        """The ids of distinct parts: by the memo, which takes in new ones, or by the library."""
        place = pc.index_in(parts, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = place < 0
        self.round += 1
        self.used[place[~fresh]] = self.round
        if not fresh.any():
            return self.ids.take(pa.array(place))
        new = parts.filter(pa.array(fresh))
        got = self._encode(new)
        place[fresh] = len(self.words) + np.arange(len(new))
        out = pa.concat_arrays([self.ids, got]).take(pa.array(place))
        short = pc.less_equal(pc.binary_length(new), KEPT_BYTES)
        self.words = pa.concat_arrays([self.words, new.filter(short)])
        self.ids = pa.concat_arrays([self.ids, got.filter(short)])
        self.used = np.append(self.used, np.full(len(self.words) - len(self.used), self.round))
        held = _buffers(self.words)[0][-1] + _buffers(self.ids)[0][-1]
        if len(self.words) > self.limit or held > MEMO_BYTES:
            # Half of what fits stays, in numbers of chunks as long as these.
            most = min(self.limit, int(len(self.words) * min(1.0, MEMO_BYTES / max(1, held))))
            keep = np.sort(np.argsort(self.used, kind="stable")[len(self.words) - most // 2 :])
            self.words, self.ids, self.used = self.words.take(pa.array(keep)), self.ids.take(pa.array(keep)), self.used[keep]
        return out

    def _gather(self, chunks: pa.Array) -> pa.Array:
        """The ids of each chunk, in order."""
        coded = chunks.dictionary_encode()
        keys = coded.dictionary
        if not self.spaces_matter:
            keys = pc.replace_substring_regex(keys, r"^[ \n]+", "")
            keys = pc.if_else(pc.match_substring_regex(keys, r"^[\x{0}-\x{12F}]*$"), pc.utf8_lower(keys), keys)
        split = pc.match_substring_regex(keys, _HEAD + _TAIL).to_numpy(zero_copy_only=False)
        both = keys.filter(pa.array(split))
        parts = pa.concat_arrays([keys.filter(pa.array(~split)), pc.replace_substring_regex(both, _TAIL, ""), pc.replace_substring_regex(both, _HEAD, "")])
        parts = parts.dictionary_encode()
        ids, n, m = self._known(parts.dictionary), len(keys) - len(both), len(both)
        joined = pc.binary_join_element_wise(ids.take(parts.indices[n : n + m]), ids.take(parts.indices[n + m :]), pa.scalar(b"", pa.large_binary()))
        of_key = pa.concat_arrays([ids.take(parts.indices[:n]), joined])
        at = np.where(split, n + np.cumsum(split) - 1, np.cumsum(~split) - 1)
        return of_key.take(pa.array(at[coded.indices.to_numpy()]))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        chunks, first = cut(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        lengths, data = [np.zeros(1, np.int64)], []
        for at in range(0, len(chunks), STEP):
            bounds, ids = _buffers(self._gather(chunks.slice(at, STEP)))
            lengths.append(np.diff(bounds))
            data.append(ids.tobytes())
        whole, ends = b"".join(data), np.cumsum(np.concatenate(lengths))[first].tolist()
        return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


_held: dict[tuple, Encoder] = {}


def forget() -> None:
    """Drops all encoders of this process."""
    _held.clear()


def encoder(path: str, spaces_matter: bool) -> Encoder:
    """One encoder for each worker process."""
    key = (path, spaces_matter)
    if key not in _held:
        _held[key] = Encoder(path, spaces_matter)
    return _held[key]
