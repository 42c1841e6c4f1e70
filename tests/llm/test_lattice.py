"""The lattice model against enumeration of segmentations and plain counting."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spindle.llm import lattice
from spindle.llm.queries import LLM_QUERIES

PATH = public_tokenizers.path(lattice.PIECES)


def plain(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def model():
    rng = np.random.default_rng(0)
    first, later = rng.integers(0, 50, 32000).astype(float), rng.integers(0, 50, 32000).astype(float)
    return lattice.pieces_from(PATH, first, later, first.sum())


def enumerate_paths(p, word):
    at = {s: i for i, s in enumerate(p.strings)}
    chars = "▁" + word

    def from_(i):
        if i == len(chars):
            return math.exp(p.stop)
        total = 0.0
        b = list(chars[i].encode())
        total += math.exp((p.bytes_later if i else p.bytes_first)[b[0]] + sum(p.bytes_later[x] for x in b[1:])) * from_(i + 1)
        for j in range(i + 1, len(chars) + 1):
            k = at.get(chars[i:j])
            if k is not None:
                total += math.exp((p.later if i else p.first)[k]) * from_(j)
        return total

    return from_(0)


def test_forward_sums_all_segmentations():
    p = model()
    words = ["the", "a", "hello", "naïve", "中文", "x🙂y", "▁a", "thing.", "zz", "\x00"]
    assert np.exp(p.forward(words)) == pytest.approx([enumerate_paths(p, w) for w in words], rel=1e-9)
    assert np.isfinite(p.forward(["q" * 3000, "é" * 40])).all()
    # Weights are probabilities: of first pieces, and of later pieces with the stop.
    assert np.exp(p.first).sum() + np.exp(p.bytes_first).sum() == pytest.approx(1)
    assert np.exp(p.later).sum() + np.exp(p.bytes_later).sum() + math.exp(p.stop) == pytest.approx(1)


def test_expected_counts():
    p = model()
    words, times = ["hello", "the", "x"], np.array([2.0, 1.0, 3.0])
    first, later = p.expected(words, times)
    step = 1e-5
    for w, t in (("hello", 2.0),):
        base = p.forward([w])[0]
        for name, got in (("first", first), ("later", later)):
            for k in [p.strings.index(x) for x in (("▁hel", "▁he") if name == "first" else ("ll", "o")) if x in p.strings]:
                only = p.expected([w], np.array([t]))[0 if name == "first" else 1][k]
                getattr(p, name)[k] += step
                slope = (p.forward([w])[0] - base) / step
                getattr(p, name)[k] -= step
                assert only == pytest.approx(t * slope, rel=1e-3) and got[k] >= only - 1e-12


def check_base(rows, got):
    """Base columns of rows ``(doc_id, text, held_out)``."""
    c = Counter()
    for _, text, out in rows:
        if not out:
            c.update([*plain(text), None])
    n, v = sum(c.values()), len(c)
    want = []
    for d, text, out in rows:
        tokens = [*plain(text), None]
        want.append((d, out, len(tokens), sum(c[t] > 0 for t in tokens), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and math.isfinite(a[6]) and a[6] <= 0


@pytest.mark.parametrize("frequent", [1 << 17, 40, 0])
def test_query_over_both_ways(spark, sf, frequent):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if frequent == 1 << 17:
        got = [tuple(r) for r in LLM_QUERIES["op9_lm_scoring"](spark, sf).collect()]
        # Where all tokens are known, the model must beat the base, which knows no classes of text.
        known = [r for r in got if r[2] == r[3] and r[2] > 20]
        assert len(known) > 50 and all(r[6] > r[5] for r in known)
        test_query_over_both_ways.scores = {r[0]: r[6] for r in got}
    else:
        got = [tuple(r) for r in lattice.score(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, frequent=frequent).collect()]
        assert {r[0]: r[6] for r in got} == pytest.approx(test_query_over_both_ways.scores, rel=1e-9)
    check_base(rows, got)


def test_edges(spark):
    rows = [(1, "A b\x0bc  ÀB\n", False), (2, None, False), (3, "", True), (4, "unseen wörds\x1fx", True), (None, "a b", False), (1, "a b c", True), (1, "a b c", True), (9, "z" * 30_000 + " a", False)]
    d = spark.createDataFrame([(i, t, o, None, 1.0) for i, t, o in rows], "doc_id long, text string, o boolean, lang string, score double")
    check_base(rows, [tuple(r) for r in lattice.score(d, F.col("o")).collect()])
    none = [(i, t, True) for i, t, _ in rows]
    check_base(none, [tuple(r) for r in lattice.score(d, F.lit(True)).collect()])
    assert lattice.score(d.limit(0), F.col("o")).collect() == []


def test_probabilities_of_words_sum_to_less_than_one(spark):
    t = lattice.Totals(10, 3, [6, 0], [2, 0], [1, 0])
    c, own = np.array([5.0, 3.0, 2.0]), np.array([4.0, 2.0, 0.0])
    sub = np.array([0.1, 0.2, 0.3])
    p, q = (np.exp(x) for x in t.weights([own, np.zeros(3)], t.overall(c, np.log(sub))))
    assert p.sum() <= 1 and q.sum() <= 1 and (p > 0).all()


def test_document_score_against_enumeration(spark):
    rows = [(1, "the cat the", False, "a"), (2, "a thing", False, "b"), (3, "The zq thing", True, None), (4, None, True, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, o boolean, lang string")
    got = {r.doc_id: r.score for r in lattice.score(docs, F.col("o")).collect()}
    learnt = {lang: Counter([*plain(text), ""]) for _, text, out, lang in rows if not out}
    every = learnt["a"] + learnt["b"]
    p = lattice.fit_pieces(spark.createDataFrame([(bytearray(w.encode()),) for w in every if w], "word binary"), PATH)

    def chance(word, c, below):
        n, v = sum(c.values()), len(c)
        return (c[word] + v * below) / (n + v)

    for d, text, _, _ in rows:
        words = [*plain(text), ""]
        total = sum(0.5 * math.prod(chance(w, c, chance(w, every, enumerate_paths(p, w))) for w in words) for c in learnt.values())
        assert got[d] == pytest.approx(math.log10(total), rel=1e-9)


def test_spelling_of_near_and_far_characters():
    p = model()
    chars = ["a", "é", chr(lattice._PLAIN - 1), chr(lattice._PLAIN), "中", "🙂"]
    for first, lead in ((True, p.bytes_first), (False, p.bytes_later)):
        want = [lead[c.encode()[0]] + sum(p.bytes_later[x] for x in c.encode()[1:]) for c in chars]
        assert p.spelled(np.array([ord(c) for c in chars], np.uint32), first) == pytest.approx(want)


@pytest.mark.parametrize("frequent", [1 << 17, 0])
def test_words_less_likely_than_a_double_holds(spark, frequent):
    """A long unknown word counts by its log probability; one that was learnt keeps its share."""
    known = "y" * 3000
    rows = [(1, f"a cat {known}", False), (2, "x" * 5000, True), (3, known, True), (4, "", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, o boolean")
    got = {r.doc_id: r.score for r in lattice.score(docs, F.col("o"), class_col=None, frequent=frequent).collect()}
    p = lattice.fit_pieces(spark.createDataFrame([(bytearray(w.encode()),) for w in ("a", "cat", known)], "word binary"), PATH)
    sub, end = p.forward(["x" * 5000])[0], got[4]
    assert sub < -1000 and got[2] == pytest.approx(end + (2 * math.log(0.5) + sub) / math.log(10), rel=1e-9)
    assert got[3] == pytest.approx(end + math.log10(1 / 8 + 1 / 16 * 1 + 1 / 16 * 0), rel=1e-9)


def test_long_words_that_are_frequent_need_no_join(spark):
    rows = [(bytearray(b"z" * 100), 1000), (bytearray(b"q" * (9 << 20)), 900), (bytearray(b"a"), 5), (bytearray(b"b" * 70), 1)]
    words = spark.createDataFrame(rows, "word binary, n long")
    assert sorted(len(r.word) for r in lattice._frequent(words, 10).collect()) == [1, 70, 100]
    assert lattice._frequent(words, 0).collect() == []
