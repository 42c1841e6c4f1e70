"""Language identification: held-out accuracy, rejection and edge cases."""

import zlib
from collections import Counter

import numpy as np

from spindle.llm import language
from spindle.llm.queries import LLM_QUERIES


def test_held_out_accuracy(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = LLM_QUERIES["op2_language_id"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95
    assert not any(r.rejected for r in held if len(docs[r.doc_id].text.split()) > 20)


def test_memo_equals_features(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(80).collect()
    model = language.train([(r.lang, *language.features(r.text)) for r in rows])
    texts = [r.text for r in rows] + [None, "", "12 ½ ²", "½a", "Ω", "x" * 50_000]
    monkeypatch.setattr(language, "MEMO", 10)
    p = language.Predictor(model)
    langs, score, rejected = zip(*[(a[0], b[0], c[0]) for a, b, c in (p.predict([t]) for t in texts)], strict=True)
    for t, lang, s, r in zip(texts, langs, score, rejected, strict=True):
        at, share = language.features(t)
        if not len(at):
            assert (lang, s, r) == ("und", 0.0, True)
            continue
        want = model.probabilities((model.scores[at] * share[:, None]).sum(axis=0)[None, :])[0]
        assert lang == model.langs[int(want.argmax())] and abs(s - want.max()) < 1e-5 and r == (s < model.threshold)
    assert langs[-3] != "und" and langs[-5:-3] == ("und", "und")


def test_edges(spark):
    rows = [(1, "guten tag liebe leute", "de"), (2, "good day dear people", "en"), (3, None, "en"), (4, "!!", None), (None, "tag", "de"), (2, "good day dear people", "en")]
    d = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = language.fit(d)
    assert model.langs == ["de", "en"]
    got = sorted(((r.doc_id, r.lang_pred, r.rejected) for r in language.predict(d, model).collect()), key=repr)
    assert got == sorted([(1, "de", False), (2, "en", False), (2, "en", False), (3, "und", True), (4, "und", True), (None, "de", False)], key=repr)
    left = language.accepted(d, model)
    assert left.columns == d.columns and left.count() == 4
    none = language.fit(d.limit(0))
    assert none is None and {r.lang_pred for r in language.predict(d, none).collect()} == {"und"} and language.accepted(d, none).count() == 4
    assert language.predict(d.limit(0), model).collect() == []
    one = language.fit(d.where("lang = 'de'"))
    assert {r.lang_pred for r in language.predict(d, one).collect()} == {"de", "und"}


FOREIGN = [
    "これは日本語の文章です。今日は天気がいいですね。", "Это предложение написано на русском языке и совсем не похоже на другие", "Dit is een zin in het Nederlands die niemand hier geleerd heeft en die lang is",
    "To jest zdanie w języku polskim, którego model nigdy nie widział", "Bu cümle Türkçe yazılmıştır ve model onu daha önce görmedi", "Αυτή είναι μια ελληνική πρόταση", "Tämä lause on kirjoitettu suomeksi eikä malli tunne sitä",
]


def test_rejection(spark, sf):
    """Most foreign texts and letter junk go, next to no text of a learnt language does."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null")
    model = language.fit(docs)
    rng = np.random.default_rng(1)
    junk = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxyz"), rng.integers(3, 10))) for _ in range(40)) for _ in range(50)]
    p = language.Predictor(model)
    assert np.mean(p.predict(junk)[2]) > 0.8 and np.mean(p.predict(FOREIGN)[2]) > 0.5
    assert np.mean(p.predict([r.text for r in docs.collect()])[2]) <= 0.01
    assert model.rejected["noise"] > 0.9 and model.rejected["clean"] <= 0.01 and model.rejected["mixed"] <= 0.06


def test_few_rows_have_a_threshold(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null").orderBy("doc_id").limit(70).collect()
    model = language.train([(r.lang, *language.features(r.text)) for r in rows])
    assert len(rows) < 20 * len(model.langs) and model.threshold > 1 / len(model.langs)
    assert not any(language.Predictor(model).predict([r.text for r in rows if len(r.text.split()) > 20])[2])


def test_sample_is_bounded(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "train", lambda rows: seen.extend(rows))
    language.fit(spark.read.parquet(f"{sf}/documents.parquet"), a_language=5, languages=2)
    assert len(seen) == 10 and len({r[0] for r in seen}) == 2


def test_sample_is_bounded_by_rows(spark):
    """Rows that repeat an id and a text, or have no id, do not enlarge the sample."""
    rows = [(None, f"alpha beta word{i % 40} gamma", "en") for i in range(300)] + [(7, "eins zwei drei", "de")] * 200 + [(i, f"uno dos tres {chr(97 + i % 26)}{i}", "es") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    language.train, real = lambda r: seen.append(r), language.train
    try:
        language.fit(df, a_language=50)
    finally:
        language.train = real
    counts = Counter(r[0] for r in seen[0])
    assert counts["de"] == 1 and 0 < counts["en"] <= 40 and counts["es"] == 50
