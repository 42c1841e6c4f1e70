"""Subword lattice language model: the probability of a text summed over all segmentations of its words.

The arcs of a word's lattice are the pieces of an existing sentencepiece vocabulary and, for a word of the training
texts, one arc over the whole word. Pieces that open a word and pieces that go on with it have weights of their own,
started from how the vocabulary's tokenizer cuts the distinct training words and refined by ``ROUNDS`` rounds of
expectation maximisation over their lattices; a word ends after each piece with a fixed probability. Characters that no piece covers are spelled in byte pieces, so every text has a probability. A forward
recursion in log space sums over all paths:

    P(word) = (1 - b) count / N + b * P(pieces),    b = V / (N + V)   (Witten and Bell)

Whole-word arcs also have weights by class of training text (its language, where known), which back off to the ones
above in the same way. A document's probability sums over the classes: P(text) = sum of P(class) times the product of
the words and the end. The class is never read at scoring.

Word counts are exact and distributed. Scoring looks up the ``FREQUENT`` most frequent words, of long ones up to
``LONG_BYTES``, in a broadcast; every other word goes through a join with the table of all words.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.llm.textscan import batches, mix
from spindle.session import discard, keep, materialise, scratch

PIECES = "piece_bpe_32k.model"
CLASSES = 8
ROUNDS = 2
FREQUENT, LONGEST, LONG_BYTES = 1 << 17, 64, 8 << 20
FLUSH = 150_000
#: Characters below this code have their spelling in a table.
_PLAIN = 0x800
END = b""
_MUL = np.uint64(0x9E3779B97F4A7C55)
_LOG10 = np.log(10.0)
_MARK = "▁"


def words_of(text: str | None) -> list[bytes]:
    """Words as bytes, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def _tokenizer(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@dataclass
class Pieces:
    """Log weights of pieces: ``first`` at the start of a word, ``later`` elsewhere, -inf where one cannot stand."""

    strings: list[str]
    first: np.ndarray
    later: np.ndarray
    stop: float
    bytes_first: np.ndarray
    bytes_later: np.ndarray
    ids: np.ndarray
    byte_ids: np.ndarray

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.strings), default=1)
        ends, starts = [], []
        for s in self.strings:
            h = 0
            for c in map(ord, s):
                h = (h * int(_MUL) + c + 1) & (2**64 - 1)
                starts.append(h)
            ends.append(h)
        keys = mix(np.array(ends, np.uint64))
        by = np.argsort(keys)
        self.keys, self.order = keys[by], by
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        # Hashes that begin a piece: a run of characters that is not among them need not be followed further.
        self.begins = np.zeros(1 << 20, bool)
        self.begins[(mix(np.array(starts, np.uint64)) >> np.uint64(44)).astype(np.int64)] = True
        plain = np.arange(_PLAIN, dtype=np.uint32)
        self.plain = [self._spelled(plain, x, self.bytes_later) for x in (self.bytes_first, self.bytes_later)]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and their places."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        return at[hit], self.order[k[hit]]

    @staticmethod
    def _spelled(codes: np.ndarray, weights: np.ndarray, later: np.ndarray) -> np.ndarray:
        cost = []
        for c in codes.tolist():
            b = list(chr(c).encode("utf-8", "surrogatepass"))
            cost.append(weights[b[0]] + sum(later[x] for x in b[1:]))
        return np.array(cost)

    def spelled(self, codes: np.ndarray, first: bool) -> np.ndarray:
        """Log weights of characters spelled in byte pieces."""
        out = self.plain[0 if first else 1][np.minimum(codes, _PLAIN - 1)]
        far = np.flatnonzero(codes >= _PLAIN)
        if len(far):
            chars, back = np.unique(codes[far], return_inverse=True)
            out[far] = self._spelled(chars, self.bytes_first if first else self.bytes_later, self.bytes_later)[back]
        return out

    def forward(self, words: list[str]) -> np.ndarray:
        """Natural log of the sum over all segmentations of each word."""
        out = np.zeros(len(words))
        size = np.array([len(w) + 1 for w in words], np.int64)
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            for a in range(0, len(rows), max(1, 400_000 // int(n))):
                part = rows[a : a + max(1, 400_000 // int(n))]
                text = "".join(_MARK + words[i] for i in part).encode("utf-32-le", "surrogatepass")
                out[part] = self._forward(np.frombuffer(text, np.uint32).reshape(len(part), n))
        return out

    def _arcs(self, codes: np.ndarray):
        """``(i, j, rows, places, weights)`` of the arcs from position i to j; places are null for spelled characters."""
        m, n = codes.shape
        c = np.ascontiguousarray(codes.T).astype(np.uint64) + np.uint64(1)
        for i in range(n):
            yield i, i + 1, None, None, self.spelled(codes[:, i], i == 0)
            weight = self.first if i == 0 else self.later
            live, h = np.arange(m), np.zeros(m, np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = h * _MUL + c[j, live]
                mixed = mix(h)
                go = np.flatnonzero(self.begins[(mixed >> np.uint64(44)).astype(np.int64)])
                if not len(go):
                    break
                live, h = live[go], h[go]
                at, k = self.find(mixed[go])
                on = np.isfinite(weight[k])
                if on.any():
                    at, k = live[at[on]], k[on]
                    yield i, j + 1, at, k, weight[k]

    def _forward(self, codes: np.ndarray, arcs=None) -> np.ndarray:
        m, n = codes.shape
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0
        for i, j, at, _, w in arcs or self._arcs(codes):
            if at is None:
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + w)
            else:
                alpha[j, at] = np.logaddexp(alpha[j, at], alpha[i, at] + w)
        return alpha if arcs else alpha[n] + self.stop

    def expected(self, words: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts of pieces, as first and as later ones, over all segmentations of each word."""
        first, later = np.zeros(len(self.strings)), np.zeros(len(self.strings))
        size = np.array([len(w) + 1 for w in words], np.int64)
        for n in np.unique(size):
            rows = np.flatnonzero(size == n)
            for a in range(0, len(rows), max(1, 100_000 // int(n))):
                part = rows[a : a + max(1, 100_000 // int(n))]
                text = "".join(_MARK + words[i] for i in part).encode("utf-32-le", "surrogatepass")
                codes = np.frombuffer(text, np.uint32).reshape(len(part), n)
                arcs = list(self._arcs(codes))
                alpha = self._forward(codes, arcs)
                beta = np.full_like(alpha, -np.inf)
                beta[n] = 0
                for i, j, at, k, w in reversed(arcs):
                    if at is None:
                        beta[i] = np.logaddexp(beta[i], beta[j] + w)
                    else:
                        beta[i, at] = np.logaddexp(beta[i, at], beta[j, at] + w)
                        share = np.exp(alpha[i, at] + w + beta[j, at] - alpha[n, at]) * times[part[at]]
                        (later if i else first)[:] += np.bincount(k, share, minlength=len(first))
        return first, later


def pieces_from(path: str, first: np.ndarray, later: np.ndarray, words: float) -> Pieces:
    """Weights from counts by piece id, half a count added to each."""
    sp = _tokenizer(path)
    n = sp.vocab_size()
    is_byte = np.array([sp.is_byte(i) for i in range(n)])
    usable = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]) & ~is_byte
    strings = [sp.id_to_piece(i) for i in range(n)]
    opens = np.array([s.startswith(_MARK) for s in strings]) & usable
    inside = usable & np.array([_MARK not in s for s in strings])
    a = np.where(opens | is_byte, first + 0.5, 0)
    b = np.where(inside | is_byte, later + 0.5, 0)
    stop = (words + 0.5) / (words + later.sum() + 1)
    with np.errstate(divide="ignore"):
        log_first, log_later = np.log(a / a.sum()), np.log(b / b.sum()) + np.log1p(-stop)
    use = np.flatnonzero(opens | inside)
    by_byte = np.zeros(256, np.int64)
    for i in np.flatnonzero(is_byte):
        by_byte[int(strings[i][3:5], 16)] = i
    return Pieces([strings[i] for i in use], log_first[use], log_later[use], float(np.log(stop)), log_first[by_byte], log_later[by_byte], use, np.flatnonzero(is_byte))


def _count_task(classes: list[str]):
    """Words of all texts with their counts in the training texts of each class; words of other texts count zero."""
    index = {c: i for i, c in enumerate(classes)}

    def run(source):
        held: list[Counter] = [Counter() for _ in range(len(classes) + 1)]
        seen: set[bytes] = set()

        def flush():
            words, kinds, counts = [], [], []
            for k, c in enumerate(held):
                words += c.keys()
                kinds += [k] * len(c)
                counts += c.values()
            rest = seen.difference(*held)
            words += rest
            kinds += [0] * len(rest)
            counts += [0] * len(rest)
            for a in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 50_000], pa.binary()), pa.array(kinds[a : a + 50_000], pa.int32()), pa.array(counts[a : a + 50_000], pa.int64())], ["word", "class", "n"])

        for batch in batches(source, ["text"], 512 << 10):
            for text, lang, learn in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), batch.column("learn").to_pylist(), strict=True):
                w = words_of(text)
                if learn:
                    c = held[index.get(lang, len(classes))]
                    c.update(w)
                    c[END] += 1
                else:
                    seen.update(w)
            if sum(map(len, held)) + len(seen) > FLUSH:
                yield from flush()
                held, seen = [Counter() for _ in range(len(classes) + 1)], set()
        yield from flush()

    return run


def _cut_task(path: str):
    """How the vocabulary's tokenizer cuts distinct words: piece ids with their counts as first and as later pieces."""

    def run(source):
        sp = _tokenizer(path)
        first, later = np.zeros(sp.vocab_size()), np.zeros(sp.vocab_size())
        for batch in source:
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            for a in range(0, len(words), 5000):
                cut = sp.encode(words[a : a + 5000], num_threads=1)
                size = np.array([len(x) for x in cut], np.int64)
                ids = np.fromiter((i for x in cut for i in x), np.int64, int(size.sum()))
                lead = np.zeros(len(ids), bool)
                lead[(np.cumsum(size) - size)[size > 0]] = True
                first += np.bincount(ids[lead], minlength=len(first))
                later += np.bincount(ids[~lead], minlength=len(later))
        at = np.flatnonzero(first + later)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(first[at]), pa.array(later[at])], ["piece", "first", "later"])

    return run


def _expect_task(shared):
    """Expected counts of pieces over the lattices of distinct words."""

    def run(source):
        pieces = shared.value
        first, later = np.zeros(len(pieces.strings)), np.zeros(len(pieces.strings))
        for batch in source:
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            f, g = pieces.expected(words, np.ones(len(words)))
            first, later = first + f, later + g
        at = np.flatnonzero(first + later)
        yield pa.RecordBatch.from_arrays([pa.array(pieces.ids[at], pa.int64()), pa.array(first[at]), pa.array(later[at])], ["piece", "first", "later"])

    return run


def fit_pieces(words: DataFrame, path: str) -> Pieces:
    """Weights of the vocabulary's pieces from distinct words, a column ``word`` of bytes. Counts come back by piece."""
    schema, n = "piece long, first double, later double", _tokenizer(path).vocab_size()

    def gather(task) -> tuple[np.ndarray, np.ndarray]:
        t = words.mapInArrow(task, schema).groupBy("piece").agg(F.sum("first").alias("first"), F.sum("later").alias("later")).orderBy("piece").toArrow()
        first, later = np.zeros(n), np.zeros(n)
        first[t.column("piece").to_numpy()], later[t.column("piece").to_numpy()] = t.column("first").to_numpy(), t.column("later").to_numpy()
        return first, later

    first, later = gather(_cut_task(path))
    total, out = float(first.sum()), pieces_from(path, first, later, float(first.sum()))
    for _ in range(ROUNDS):
        f, g = gather(_expect_task(words.sparkSession.sparkContext.broadcast(out)))
        f[out.byte_ids], g[out.byte_ids] = first[out.byte_ids], later[out.byte_ids]
        out = pieces_from(path, f, g, total)
    return out


def _lattice_task(shared):
    def run(source):
        pieces = shared.value
        for batch in source:
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces.forward(words))], [*batch.schema.names, "sub"])

    return run


@dataclass
class Totals:
    """Tokens and distinct tokens of all training texts and of each class, and the classes' shares of texts."""

    tokens: int
    distinct: int
    class_tokens: list[int]
    class_distinct: list[int]
    class_docs: list[int]

    def base(self, c):
        return (c + 1.0) / (self.tokens + 1.0 * (self.distinct + 1))

    @staticmethod
    def _mixed(x, tokens: int, distinct: int, below, of):
        """The log of a count's share mixed with the probability whose log is ``below``. A word without a count stays in logs, as a long one's probability is less than a double holds."""
        if not tokens:
            return below
        rest = distinct / (tokens + distinct)
        return of.where(x > 0, of.log((x * 1.0 / tokens) * (tokens / (tokens + distinct)) + of.exp(below) * rest), below + math.log(rest))

    def overall(self, c, sub, of=np):
        """Natural logs of a word's probability over all classes, for numpy arrays and columns alike. ``sub`` is the lattice's log."""
        return self._mixed(c, self.tokens, self.distinct, sub, of)

    def weights(self, counts: list, below, of=np) -> list:
        """Natural logs of a word's probability in each class; ``below`` is :meth:`overall`."""
        return [self._mixed(x, t, v, below, of) for x, t, v in zip(counts, self.class_tokens, self.class_distinct, strict=True)]


class _Columns:
    """What :class:`Totals` needs of numpy, for columns."""

    log, exp = staticmethod(F.log), staticmethod(F.exp)

    @staticmethod
    def where(met, a, b):
        return F.when(met, a).otherwise(b)


def _frequent(scored: DataFrame, most: int) -> DataFrame:
    """The most frequent words, down to the power of two at which they stay within bounds: ``most`` words, and of words over ``LONGEST`` bytes ``most`` and ``LONG_BYTES`` bytes. Words over ``LONG_BYTES / 128`` fill too much text to have many rows of a join."""
    scored = scored.where(F.octet_length("word") <= LONG_BYTES // 128)
    step, long = F.floor(4 * F.log2(F.col("n") + 1)).cast("int"), F.octet_length("word") > LONGEST
    levels = scored.groupBy(step.alias("s"), long.alias("long")).agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("word")).alias("bytes")).collect()
    wanted = F.lit(False)
    for is_long, room in ((False, most * LONGEST), (True, LONG_BYTES)):
        words = size = 0
        for r in sorted((r for r in levels if r["long"] == is_long), key=lambda r: -r["s"]):
            words, size = words + r["m"], size + r["bytes"]
            if words > most or size > room:
                break
            wanted = wanted | ((long == is_long) & (step == r["s"]))
    return scored.where(wanted)


def _score_task(shared):
    """A row (kind 0) for each document with the sums over its frequent words, and a row (kind 1) for each other word."""

    def run(source):
        words, table = shared.value
        index = {w: i for i, w in enumerate(words)}
        width, key = table.shape[1], TaskContext.get().partitionId() << 40
        end = index.get(END)
        for batch in batches(source, ["text"], 512 << 10):
            keys, sums, sizes, rare_key, rare_word, rare_n = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                c = Counter(words_of(text))
                n = sum(c.values()) + 1
                if end is not None:
                    c[END] = 1
                else:
                    rare_key.append(key)
                    rare_word.append(END)
                    rare_n.append(1)
                at = [(index[w], k) for w, k in c.items() if w in index]
                if len(at) < len(c):
                    for w, k in c.items():
                        if w not in index:
                            rare_key.append(key)
                            rare_word.append(w)
                            rare_n.append(k)
                if at:
                    i, k = np.array(at).T
                    sums.append(k @ table[i])
                else:
                    sums.append(np.zeros(width))
                keys.append(key)
                sizes.append(n)
                key += 1
            m, r = len(keys), len(rare_key)
            kinds = ["kind", "key", "doc_id", "held_out", "n_tokens", "sums", "word", "n"]
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.array(keys, pa.int64()), batch.column("doc_id"), batch.column("held_out"), pa.array(sizes, pa.int64()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64())), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], kinds)
            if r:
                yield pa.RecordBatch.from_arrays([pa.array([1] * r, pa.int32()), pa.array(rare_key, pa.int64()), pa.nulls(r, batch.column("doc_id").type), pa.nulls(r, pa.bool_()), pa.nulls(r, pa.int64()), pa.nulls(r, pa.list_(pa.float64())), pa.array(rare_word, pa.binary()), pa.array(rare_n, pa.int64())], kinds)

    return run


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = "lang", path: str = "", frequent: int = FREQUENT, classes: int = CLASSES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``: a row for each row of ``docs``.

    Learns from the rows that are not ``held_out`` (null counts as not held out). A null text is empty: its only token
    is the end. ``base_score`` is the sum of ``log10((c + 1) / (N + V + 1))`` over tokens, ``score`` the model's log10
    probability of the text. Without training rows all counts are zero, words have the pieces' probability alone and the
    end is certain.
    Rows are independent, repeated ids included; other columns are ignored; no rows give no rows. Of the classes the
    ``classes - 1`` most frequent ones have weights of their own, all other rows one class together.
    """
    with scratch(docs.sparkSession):
        return keep(materialise(_scored(docs, held_out, id_col, text_col, class_col, path, frequent, classes), "scores"))


def _scored(docs: DataFrame, held_out: Column, id_col: str, text_col: str, class_col: str | None, path: str, frequent: int, most_classes: int) -> DataFrame:
    path = path or public_tokenizers.path(PIECES)
    spark = docs.sparkSession
    lang = F.col(class_col).cast("string") if class_col else F.lit(None).cast("string")
    out_flag = F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), lang.alias("lang"), out_flag.alias("held_out"))
    learn = rows.where(~F.col("held_out"))
    top = learn.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_classes - 1).collect()
    classes = [r["lang"] for r in top]
    k = len(classes) + 1

    # Counts of all words, in all training texts and by class.
    counted = rows.select("text", "lang", (~F.col("held_out")).alias("learn")).mapInArrow(_count_task(classes), "word binary, class int, n long")
    by_class = [F.sum(F.when(F.col("class") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(k)]
    counts = materialise(counted.groupBy("word").agg(F.sum("n").alias("n"), *by_class), "words")
    sums = counts.agg(F.sum("n").alias("t"), F.count(F.when(F.col("n") > 0, 1)).alias("v"), *[F.sum(f"c{i}").alias(f"t{i}") for i in range(k)], *[F.count(F.when(F.col(f"c{i}") > 0, 1)).alias(f"v{i}") for i in range(k)], *[F.sum(F.when(F.col("word") == F.lit(bytearray(END)), F.col(f"c{i}"))).alias(f"d{i}") for i in range(k)]).first()
    get = lambda x: sums[x] or 0
    totals = Totals(get("t"), get("v"), [get(f"t{i}") for i in range(k)], [get(f"v{i}") for i in range(k)], [get(f"d{i}") for i in range(k)])

    # Weights of pieces, then the lattice's probability of every word, once a word.
    proper = counts.where(F.octet_length("word") > 0)
    pieces = spark.sparkContext.broadcast(fit_pieces(proper.where("n > 0").select("word"), path))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema)
    scored = counts.mapInArrow(_lattice_task(pieces), fields + ", sub double")
    scored = materialise(scored, "lattice")
    discard(counts)

    # The most frequent words go out as a table.
    t = _frequent(scored, frequent).toArrow()
    c = t.column("n").to_numpy().astype(np.float64)
    with np.errstate(divide="ignore"):
        p = totals.weights([t.column(f"c{i}").to_numpy() for i in range(k)], totals.overall(c, t.column("sub").to_numpy()))
    table = np.stack([*p, np.log10(totals.base(c)), (c > 0).astype(np.float64)], 1)
    shared = spark.sparkContext.broadcast((t.column("word").to_pylist(), table))

    schema = "kind int, key long, doc_id long, held_out boolean, n_tokens long, sums array<double>, word binary, n long"
    parts = materialise(rows.select("doc_id", "text", "held_out").mapInArrow(_score_task(shared), schema), "parts", ["kind"])
    width = k + 2
    below = scored.withColumn("below", totals.overall(F.col("n"), F.col("sub"), _Columns))
    other = below.select("word", *[x.alias(f"l{i}") for i, x in enumerate(totals.weights([F.col(f"c{i}") for i in range(k)], F.col("below"), _Columns))], F.log10(totals.base(F.col("n"))).alias(f"l{k}"), (F.col("n") > 0).cast("double").alias(f"l{k + 1}"))
    rare = parts.where("kind = 1").select("key", "word", F.col("n").alias("times"))
    rare = rare.join(other, "word").groupBy("key").agg(*[F.sum(F.col("times") * F.col(f"l{i}")).alias(f"r{i}") for i in range(width)])
    d = parts.where("kind = 0").select("key", "doc_id", "held_out", "n_tokens", "sums").join(rare, "key", "left")
    total = [F.element_at("sums", i + 1) + F.coalesce(F.col(f"r{i}"), F.lit(0.0)) for i in range(width)]
    n_docs = sum(totals.class_docs)
    prior = [np.log(x / n_docs) if x else None for x in totals.class_docs] if n_docs else [0.0] + [None] * (k - 1)
    joint = F.array(*[total[i] + F.lit(float(q)) for i, q in enumerate(prior) if q is not None])
    d = d.withColumn("joint", joint).withColumn("most", F.array_max("joint"))
    score_ = (F.col("most") + F.log(F.aggregate(F.col("joint"), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most"))))) / _LOG10
    return d.select("doc_id", "held_out", "n_tokens", F.round(total[k + 1]).cast("long").alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"), total[k].alias("base_score"), score_.alias("score"))
