"""Spaced seeds against sliding every item over every document."""

import itertools
import random
import re

import pytest

from spindle.llm.decontaminate import LEAST_SHARE, MASKS, clean, contamination


def words(t):
    return re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    d, out = words(text), set()
    for i, t in items:
        x = words(t)
        if i is None or t is None or not x:
            continue
        if len(x) < 8:
            if any(d[k : k + len(x)] == x for k in range(len(d))):
                out.add(i)
            continue
        least = min(13, len(x))
        for start in range(-len(x), len(d)):
            m = [0 <= start + k < len(d) and d[start + k] == x[k] for k in range(len(x))]
            inside = [k for k in range(len(x)) if 0 <= start + k < len(d)]
            n = len(inside)
            if sum(m) < 0.8 * least:
                continue
            if any(sum(m[inside[a]] for a in range(i0, i0 + w)) >= 0.8 * w for w in range(least, n + 1) for i0 in range(n - w + 1)):
                out.add(i)
                break
    return sorted(out)


def data():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(150)] + ["É", "ü"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([4, 8, 10, 15, 30, 59]))) for i in range(25)] + [(40, None), (None, text(20)), (41, ""), (3, text(20))]

    def passage():
        x = [w if rng.random() > rng.choice([0, 0.1, 0.15, 0.3]) else "zz" for w in rng.choice([t for _, t in items if t]).split()]
        a = rng.randrange(max(1, len(x) - 10))
        return rng.choice([" ", ", ", "\n"]).join(x[a:] if rng.random() < 0.5 else x).upper()

    docs = [(i, " ".join([text(rng.randint(0, 60)), passage() if rng.random() < 0.6 else "", text(rng.randint(0, 30))])) for i in range(120)]
    return [*docs, (500, None), (501, ""), (502, items[5][1]), (502, items[5][1]), (None, items[5][1])], items


def test_against_sliding(spark):
    docs, items = data()
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, items int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.items) for r in contamination(d, b).collect()), key=repr)
    want = sorted(((i, brute(t, items)) for i, t in docs), key=repr)
    assert got == want and sum(bool(w[1]) for w in want) > 30
    assert sorted(((r.doc_id, r.items) for r in contamination(d, b, slice_bytes=500).collect()), key=repr) == got
    left = clean(d, b)
    assert left.columns == d.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((i for i, x in got if not x), key=repr)
    assert sorted((r.doc_id for r in clean(d, b, slice_bytes=500).collect()), key=repr) == sorted((i for i, x in got if not x), key=repr)


def test_empty_tables(spark):
    docs, items = data()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert contamination(d.limit(0), b).collect() == [] and clean(d, b.limit(0)).count() == len(docs)
    assert all(r.items == [] for r in contamination(d, b.limit(0)).collect())


@pytest.mark.parametrize("n", range(8, 21))
def test_no_substitution_is_missed(n):
    """Every way to replace as many words of a passage standing alone as the share allows leaves a mask whole."""
    seeds = [sum(1 << (at + i) for i, c in enumerate(m) if c == "1") for m in MASKS for at in range(n - len(m) + 1)]
    most = max(r for r in range(n) if n - r >= LEAST_SHARE * n)
    for gone in itertools.combinations(range(n), most):
        x = sum(1 << i for i in gone)
        assert not all(s & x for s in seeds)


def test_long_text_and_short_items(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    d = spark.createDataFrame([(1, text), (2, "Red, green"), (3, "red x green")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "red GREEN"), (8, "w199998 w199999"), (9, " ".join(f"w{i}" for i in range(150_000, 150_020))), (10, "..")], "item_id long, text string")
    assert sorted((r.doc_id, r.items) for r in contamination(d, b).collect()) == [(1, [8, 9]), (2, [7]), (3, [])]


@pytest.mark.parametrize("every", [6, 7, 9])
def test_regular_substitutions(spark, every):
    x = [f"q{i}" for i in range(30)]
    t = " ".join("zz" if i % every == 3 else w for i, w in enumerate(x))
    d, b = spark.createDataFrame([(1, "a b " + t)], "doc_id long, text string"), spark.createDataFrame([(9, " ".join(x))], "item_id long, text string")
    assert contamination(d, b).first().items == [9]


def test_query(spark, sf):
    from spindle.llm.queries import LLM_QUERIES

    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").limit(25).collect()
    got = {r.doc_id: r.items for r in LLM_QUERIES["op5_benchmark_decontamination"](spark, sf).collect()}
    assert len(got) == 200
    assert all((got[r.doc_id] or "") == ",".join(map(str, brute(r.text, items))) for r in docs)


def test_a_stem_of_many_items():
    """20,000 items that begin alike, and documents that hold their beginning: looked up once for all of them, in bounded time and memory."""
    import time
    import tracemalloc

    import pyarrow as pa

    from spindle.llm.decontaminate import Items

    rng = random.Random(8)
    stem = " ".join(f"s{i}" for i in range(10))
    items = [(i, stem + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(10))) for i in range(20_000)]
    docs = []
    for i in range(1000):
        tail = items[i][1].split()[10:] if i % 10 == 0 else [f"v{rng.randrange(10**6)}" for _ in range(10)]
        docs.append("before it " + stem + " " + " ".join(tail[: rng.choice([1, 2, 10])]) + " and after")
    known = Items([i for i, _ in items], [t for _, t in items], MASKS, 13, 0.8)
    began = time.process_time()
    got = [known.found(pa.array(docs[a : a + 100])) for a in range(0, 1000, 100)]
    took = time.process_time() - began
    tracemalloc.start()
    known.found(pa.array(docs[:50]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = [x.tolist() for part in got for x in part]
    for i in [*range(0, 1000, 97), *range(0, 1000, 110)]:
        near = [items[i], *rng.sample(items, 5)]
        assert sorted(set(got[i]) & {n for n, _ in near}) == brute(docs[i], near)
    assert sum(map(bool, got)) >= 60 and most < 500e6
    assert took < 30  # a few seconds on a machine that does nothing else


def test_items_that_many_share_whole(spark):
    """Repeated and nearly repeated items, more than are looked at one by one, in slices and at once."""
    base = [f"w{i}" for i in range(16)]
    items = [(i, " ".join(w if k != i % 17 else "other" for k, w in enumerate(base))) for i in range(60)]
    docs = [(1, "x " + " ".join(base) + " y"), (2, " ".join(base[:12])), (3, " ".join(base[3:])), (4, "none of it"), (4, None)]
    d, b = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, key int"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, brute(t, items)) for i, t in docs), key=repr)
    for slice_bytes in (1 << 20, 1000):
        got = sorted(((r.doc_id, r.items) for r in contamination(d, b, slice_bytes=slice_bytes).collect()), key=repr)
        assert got == want and any(len(x) > 40 for _, x in got)
        left = clean(d, b, slice_bytes=slice_bytes)
        assert left.columns == d.columns and sorted(((r.doc_id, r.text, r.key) for r in left.collect()), key=repr) == sorted(((i, t, 7) for (i, t) in docs if not brute(t, items)), key=repr)
