"""Fill-in-the-middle against a version that lists all units, and exact round trips."""

import hashlib
import random
import re
import tracemalloc

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindle.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc, text, seed=42, rate=50, spm=80):
    text = text or ""
    u = UNITS.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc, len(u), "plain", None, None, text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return (doc, len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def rows():
    rng = random.Random(11)
    words = ["a", "dès", "🙂🙃", "<", "<P", "S>", "M>", "\x00", " ", " x", "wörd"]
    space = [" ", "  ", "\n", "\t\r\n", "\x0b\x0c", "\x1c"]
    texts = ["".join(rng.choice(words) + rng.choice(space) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    out = list(enumerate(texts)) + [(i + 1000, "x y") for i in range(60)]
    out += [(2000, None), (2001, ""), (2002, "  \n"), (2003, "word"), (None, "no id here"), (None, "nor here, at all"), (7, "again seven"), (7, "again seven")]
    out += [(3000 + i, t) for i, t in enumerate(["has <P> in it", "<S>", "ends in <M>", "<P<S", "S>P>"])]
    return out + [(4000, " leading" * 50_000), (4001, "x" * 300_000), (4002, " " * 300_000)]


def test_against_all_units(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, 1, "f", "o") for d, t in data], "doc_id long, text string, n int, form string, output string").repartition(5)
    got = fim.fill_in_middle(df)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute(d, t) for d, t in data), key=repr)
    back = got.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((d, t or "") for d, t in data), key=repr)
    assert {r.form for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_parameters(spark):
    df = spark.createDataFrame([(i, f"one two three {i} four") for i in range(200)], "k long, t string")
    every = fim.fill_in_middle(df, seed=7, fim_percent=100, spm_percent=0, id_col="k", text_col="t", sentinels=("[pre]", "[suf]", "[mid]"))
    assert {r.form for r in every.collect()} == {"psm"}
    back = every.select(fim.restored(F.col("output"), F.col("form"), ("[pre]", "[suf]", "[mid]")).alias("t"), "doc_id").collect()
    assert sorted((r.doc_id, r.t) for r in back) == sorted(tuple(r) for r in df.collect())
    assert {r.form for r in fim.fill_in_middle(df, fim_percent=0, id_col="k", text_col="t").collect()} == {"plain"}
    assert fim.fill_in_middle(df.limit(0), id_col="k", text_col="t").collect() == []
    for bad in (("<P>", "<P>", "<M>"), ("<>", "><", "m"), ("", "a", "b"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, id_col="k", text_col="t", sentinels=bad)


@given(st.text(alphabet="ab \n<PSM>🙂", max_size=40), st.integers(0, 50), st.integers(0, 50))
def test_passes(text, x, y):
    u = UNITS.findall(text)
    assert fim.count_units(text) == len(u)
    a, b = sorted((x % (len(u) + 1), y % (len(u) + 1)))
    assert fim.borders(text, a, b) == (len("".join(u[:a])), len("".join(u[:b])))


def test_memory_is_constant():
    """A text with a million units costs no more than one with a thousand: no pass keeps them."""
    def peak(text):
        tracemalloc.start()
        n = fim.count_units(text)
        fim.borders(text, n // 3, 2 * n // 3)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    small, large = "ab cd " * 500, "ab cd " * 500_000
    peak(small)
    assert peak(large) < peak(small) + 10_000
