"""Language identification: averaged embeddings of hashed subwords, a linear softmax, and calibrated rejection.

A document is the average of the embeddings of its subwords: the words (runs of letters, lower case) between marks,
and all their byte n-grams of two to five bytes, hashed to ``BUCKETS`` places. Embeddings and classifier are trained
together by stochastic gradient descent in numpy, on at most ``SAMPLE_A_LANGUAGE`` documents of each of at most
``LANGUAGES`` languages. A part of the sample is held back (of few rows, each part in turn). The bias is set such that
texts of random subwords are of no language, and a temperature of the softmax is fitted to documents held back and such
texts. Documents with a probability below a threshold are rejected. It is the largest that rejects at most
``REJECT_SHARE`` of the documents held back and ``REJECT_MIXED`` of even mixtures of two of them in different languages,
as mixed texts stay, but no larger than needed to reject ``CAUGHT`` of the negatives: texts of random subwords, and
documents held back under models that have not learnt their language (surety above chance, carried over to the number
of languages). With one language nothing can be told, and no text with letters goes.

As prediction is linear up to the softmax, a word adds a fixed vector to a document's scores. Every worker keeps those
of the words that it has met lately.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.textscan import batches, mix
from spindle.session import materialise, scratch

SAMPLE_A_LANGUAGE, LANGUAGES = 800, 64
BUCKETS, DIM, EPOCHS, BATCH, RATE = 1 << 15, 16, 4, 16, 2.0
HELD_BACK, FOLDS, REJECT_SHARE, REJECT_MIXED, CAUGHT = 5, 4, 0.005, 0.05, 0.99
MEMO = 150_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_MUL = np.uint64(0x9E3779B97F4A7C55)


def words_of(text: str | None) -> Counter:
    """Runs of letters in lower case with their counts; numerals that are no digits do not count as letters."""
    found = _WORD.findall(text.lower()) if text else []
    out = Counter(found)
    if out and not any(map(str.isalpha, out)):
        out = Counter(w for w in found if any(map(str.isalpha, w)))
    return out


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subwords of all words, and the bound of each word's run of places."""
    b = [f"<{w}>".encode() for w in words]
    size = np.array([len(x) for x in b], np.int64)
    data = np.frombuffer(b"".join(b), np.uint8).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(b)), size)
    place, owner = [], []
    h = data
    for n in range(2, 6):
        if len(h) < 2:
            break
        h = h[:-1] * _MUL + data[n - 1 :]
        ok = word[: len(h)] == word[n - 1 :]
        place.append(mix(h[ok] + np.uint64(n)))
        owner.append(word[: len(h)][ok])
    whole = np.array([hash_bytes(x) for x in b], np.uint64)
    place.append(mix(whole))
    owner.append(np.arange(len(b)))
    place, owner = np.concatenate(place), np.concatenate(owner)
    by = np.argsort(owner, kind="stable")
    return (place[by] & np.uint64(BUCKETS - 1)).astype(np.int32), np.searchsorted(owner[by], np.arange(len(b) + 1))


def hash_bytes(x: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(x)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of a whole text's subwords and their shares; empty if it has no letter."""
    c = words_of(text)
    if not c:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    place, edge = subwords(list(c))
    times = np.repeat(np.array(list(c.values()), np.float64), np.diff(edge))
    sums = np.bincount(place, times, minlength=BUCKETS)
    at = np.flatnonzero(sums)
    return at.astype(np.int32), (sums[at] / sums.sum()).astype(np.float32)


@dataclass
class Model:
    """``scores`` has a row of class scores for each place; a document's scores are their average plus ``bias``."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    rejected: dict = field(default_factory=dict)  # the share of each kind of text that calibration saw below the threshold

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _fitted(rows: list, label: np.ndarray, k: int, which: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of places and biases of ``k`` classes, from the rows ``which``."""
    rng = np.random.default_rng(seed)
    emb, w, bias = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    w[:] = rng.normal(0, 0.1, w.shape)
    steps = EPOCHS * -(-len(which) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(which)
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            place = np.concatenate([rows[i][1] for i in part])
            share = np.concatenate([rows[i][2] for i in part])
            n = np.array([len(rows[i][1]) for i in part])
            start = np.cumsum(n) - n
            h = np.add.reduceat(emb[place] * share[:, None], start)
            z = h @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), label[part]] -= 1
            back = (p @ w.T)[np.repeat(np.arange(len(part)), n)] * share[:, None]
            w -= rate * (h.T @ p) / len(part)
            bias -= rate * p.mean(axis=0)
            # Embeddings see tiny shares of the gradient; their rate is that much larger.
            np.add.at(emb, place, -(rate * 20) * back)
    return (emb @ w).astype(np.float64), bias.astype(np.float64)


def _logits(rows: list, which: np.ndarray, scores: np.ndarray) -> np.ndarray:
    return np.stack([(scores[rows[i][1]] * rows[i][2][:, None]).sum(axis=0) for i in which])


def _negatives(rows: list, label: np.ndarray, k: int, held: np.ndarray, seed: int) -> np.ndarray:
    """How much surer than chance, from 0 to 1, models are of the documents held back in languages that they have not learnt."""
    groups, out = min(k, FOLDS), []
    for g in range(groups):
        own = np.arange(k) % groups != g
        n = int(own.sum())
        at = held[~own[label[held]]]
        if n < 2 or not len(at):
            continue
        of = np.cumsum(own) - 1
        learnt = own[label]
        learnt[held] = False
        scores, bias = _fitted(rows, of[label], n, np.flatnonzero(learnt), seed)
        mine = held[own[label[held]]]
        model = Model([""] * n, scores, bias, 1.0, 0.0)
        if len(mine):
            _calibrate(model, _logits(rows, mine, scores), of[label[mine]], _noise(rows, mine, scores, seed))
        out.append((model.probabilities(_logits(rows, at, scores)).max(axis=1) * n - 1) / (n - 1))
    return np.concatenate(out) if out else np.zeros(0)


def _noise(rows: list, which: np.ndarray, scores: np.ndarray, seed: int) -> np.ndarray:
    """Logits of texts like the rows ``which`` whose subwords are drawn at random."""
    rng = np.random.default_rng(seed)
    return _logits([("", rng.integers(0, BUCKETS, len(rows[i][1])), rows[i][2]) for i in which], np.arange(len(which)), scores)


def _calibrate(model: Model, logits: np.ndarray, label: np.ndarray, noise: np.ndarray) -> None:
    """Sets the bias such that noise is of no language, and the temperature to what fits documents and noise best."""
    model.bias = -noise.mean(axis=0)
    own, best = (np.arange(len(label)), label), np.inf
    for t in np.exp(np.linspace(np.log(0.05), np.log(20), 60)):
        tried = Model(model.langs, model.scores, model.bias, t, 0.0)
        loss = -np.log(np.maximum(tried.probabilities(logits)[own], 1e-12)).mean() - np.log(np.maximum(tried.probabilities(noise), 1e-12)).mean()
        if loss < best:
            best, model.temperature = loss, float(t)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """Fits a model to ``(lang, places, shares)``; none without rows. Rows come in a fixed order."""
    rows = [r for r in rows if len(r[1])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return None
    k, every = len(langs), np.arange(len(rows))
    label = np.array([langs.index(r[0]) for r in rows])
    few = len(rows) < 20 * k
    # Of few rows each is held back once, from a model of its own, and the model returned learns from all.
    parts = [every[every % HELD_BACK == p] for p in range(HELD_BACK if few else 1)]
    scores, bias = _fitted(rows, label, k, every if few else np.setdiff1d(every, parts[0]), seed)
    model = Model(langs, scores, bias, 1.0, 0.0)
    if k == 1:
        return model
    logits, at = [], []
    for part in parts:
        rest = np.setdiff1d(every, part)
        if len(part) and len(rest):
            s = _fitted(rows, label, k, rest, seed)[0] if few else scores
            logits.append(_logits(rows, part, s) - (_noise(rows, part, s, seed).mean(axis=0) if few else 0))
            at.append(part)
    if not at:
        return model
    logits, at = np.concatenate(logits), np.concatenate(at)
    drawn = _noise(rows, at, scores, seed)
    if few:  # each part's logits are over its own model's noise
        logits = logits + drawn.mean(axis=0)
    _calibrate(model, logits, label[at], drawn)
    other = np.random.default_rng(seed).permutation(len(at))
    mixed = label[at] != label[at[other]]
    top = model.probabilities(logits).max(axis=1)
    both = model.probabilities(((logits + logits[other]) / 2)[mixed]).max(axis=1) if mixed.any() else top
    noise = model.probabilities(drawn).max(axis=1)
    foreign = (1 + (k - 1) * _negatives(rows, label, k, at if not few else parts[0], seed)) / k
    bad = np.quantile(np.concatenate([noise, foreign]), CAUGHT)
    model.threshold = float(min(np.quantile(top, REJECT_SHARE), np.quantile(both, REJECT_MIXED), bad))
    model.rejected = {name: float((x < model.threshold).mean()) for name, x in (("clean", top), ("mixed", both), ("noise", noise), ("foreign", foreign)) if len(x)}
    return model


class Predictor:
    """Predicts with a bounded memo of words' scores."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.langs) + 1))

    def _learn(self, words: list[str]) -> None:
        n = len(self.index)
        while n + len(words) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        for a in range(0, len(words), 20_000):
            some = words[a : a + 20_000]
            place, edge = subwords(some)
            self.sums[n : n + len(some), :-1] = np.add.reduceat(self.model.scores[place], edge[:-1])
            self.sums[n : n + len(some), -1] = np.diff(edge)
            self.index.update(zip(some, range(n, n + len(some)), strict=True))
            n += len(some)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, probabilities and whether each text is rejected."""
        if len(self.index) > MEMO:
            self.reset()
        counts = [words_of(t) for t in texts]
        new, index = set(), self.index
        for c in counts:
            new.update([w for w in c if w not in index])
        if new:
            self._learn(sorted(new))
        sums = np.zeros((len(texts), self.sums.shape[1]))
        for i, c in enumerate(counts):
            if c:
                at = np.fromiter(map(self.index.__getitem__, c), np.int64, len(c))
                sums[i] = np.fromiter(c.values(), np.float64, len(c)) @ self.sums[at]
        some = sums[:, -1] > 0
        p = self.model.probabilities(sums[:, :-1] / np.where(some, sums[:, -1], 1)[:, None])
        best = p.argmax(axis=1)
        score = np.where(some, p[np.arange(len(p)), best], 0.0)
        return [self.model.langs[j] if ok else UNKNOWN for j, ok in zip(best, some, strict=True)], score, ~some | (score < self.model.threshold)


def _feature_task(source):
    for batch in batches(source, ["text"]):
        got = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("lang"), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())], ["rank", "lang", "places", "shares"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", a_language: int = SAMPLE_A_LANGUAGE, languages: int = LANGUAGES) -> Model | None:
    """Trains on a bounded sample of rows with a language: of the ``languages`` most frequent ones, ``a_language`` rows each.

    A row's place in the sample is the hash of its id and text; rows that repeat both count once, so null and repeated ids
    do not enlarge the sample. Rows of rarer languages are not learnt from. Reads ids, languages and texts once to count,
    and the texts of the sample alone after that. No rows with a language and a text give no model.
    """
    rank = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(17))
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), rank.alias("rank"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not counts:
        return None
    wanted = F.lit(False)
    for c in counts:
        # Half as many again as wanted, on average; the rest goes by rank.
        share = min(1.0, (1.5 * a_language + 50) / c["n"])
        top = F.lit(-(2**63) + int(share * 2**64)) if share < 1 else None
        wanted = wanted | ((F.col("lang") == c["lang"]) & (F.lit(True) if top is None else F.col("rank") < top))
    got = rows.where(wanted).dropDuplicates(["lang", "rank"]).select("lang", "text", "rank").mapInArrow(_feature_task, "rank long, lang string, places binary, shares binary")
    with scratch(labelled.sparkSession):
        return train(_sampled(materialise(got, "features"), a_language))


def _sampled(got: DataFrame, a_language: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """The rows of each language with the smallest ranks, in order of rank."""
    table, taken, sample = sorted((r["lang"], r["rank"]) for r in got.select("lang", "rank").collect()), Counter(), set()
    for lang, r in table:
        if taken[lang] < a_language:
            taken[lang] += 1
            sample.add((lang, r))
    last = {lang: max(r for x, r in sample if x == lang) for lang in taken}
    keep = F.lit(False)
    for lang, r in last.items():
        keep = keep | ((F.col("lang") == lang) & (F.col("rank") <= r))
    out = []
    for r in got.where(keep).orderBy("rank", "lang").toLocalIterator():
        out.append((r["lang"], np.frombuffer(bytes(r["places"]), np.int32), np.frombuffer(bytes(r["shares"]), np.float32)))
    return out


def _predict_task(shared, keep_rejected: bool, text_col: str, names: list[str]):
    def run(source):
        predictor = Predictor(shared.value)
        for batch in batches(source, [text_col]):
            lang, score, rejected = predictor.predict(batch.column(text_col).to_pylist())
            if not keep_rejected:
                yield batch.filter(pa.array(~rejected))
            else:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    return run


def _no_model() -> Model:
    """Without labelled rows every text is of an unknown language; none is rejected but those without letters."""
    return Model([UNKNOWN], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 0.0)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` of every row, from its whole text alone.

    A null text, or one without a letter, gives ``und``, score 0 and a rejection. Without a model every language is
    ``und``. Rows are independent; null ids stay null; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or _no_model())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict_task(shared, True, "text", ["doc_id"]), f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model or _no_model())
    return docs.mapInArrow(_predict_task(shared, False, text_col, []), docs.schema)
