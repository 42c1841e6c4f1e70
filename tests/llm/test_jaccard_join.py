"""The n-gram Jaccard join against all pairs."""

import random
import re

import pytest

from spindle.llm.jaccard_join import jaccard_classes


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if x and 100 * x >= 75 * (len(sets[i]) + len(sets[j]) - x):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i), d), links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def near(rng, words, rate):
    return " ".join(rng.choice(words) if rng.random() < rate else w for w in words)


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)] + ["Äx", "ß", "A"]
    rows, passage = [], " ".join(rng.choices(vocabulary, k=40))
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 4, 5, 6, 30, 120, 400]))
        rows += [near(rng, base, rng.choice([0, 0.005, 0.02, 0.05])) for _ in range(rng.choice([1, 2, 9, 25]))]
    rows += [passage + "\n" + " ".join(rng.choices(vocabulary, k=rng.choice([5, 8, 12, 14, 60]))) for _ in range(40)]
    rows += ["One two THREE four five six", "one  two\tthree\x0bfour five six", "", None, "  ", "a", "A", "a b", "x\x1fy z", "x y z"]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(rows)]
    return [*rows, (3, "a b"), rows[5], (None, rows[5][1]), (None, "alone in the world of words here")]


def test_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, node string").repartition(5)
    got = sorted((tuple(r) for r in jaccard_classes(df).collect()), key=repr)
    assert got == brute(rows)


def test_long_lists_without_frequent_tokens(spark):
    """The table of frequent tokens steers work only."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard_classes(df, heavy_tokens=0).collect()), key=repr) == brute(rows)


def test_empty(spark):
    assert jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n", range(1, 60))
def test_prefix_length(n):
    from spindle.llm.jaccard_join import prefix_length

    assert prefix_length(n, 75, 100) == n - -(-75 * n // 100) + 1 >= 1


@pytest.mark.parametrize("most", [1, 3, 256])
def test_block_pairs(spark, most):
    """All pairs of blocks of some list, once, whether lists are cut into parts or not."""
    from spindle.llm.jaccard_join import block_pairs

    rng = random.Random(most)
    rows = [(rng.randrange(4), (rng.randrange(5), rng.randrange(12))) for _ in range(120)] + [(9, (1, 100)), (10, (2, 101)), (10, (3, 102)), (11, (0, 103)), (11, (2, 104))]
    df = spark.createDataFrame(rows, "list long, at struct<sc:int,block:long>")
    want = {(x[1], y[1]) for k in {r[0] for r in rows} for x in (r[1] for r in rows if r[0] == k) for y in (r[1] for r in rows if r[0] == k) if abs(x[0] - y[0]) <= 1 and x <= y}
    got = [tuple(r) for r in block_pairs(df, most).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_ranges_follow_the_text():
    """No range stands for more than a bounded text, and none has one key a row."""
    from spindle.llm import jaccard_join as j

    assert j.range_bits(0) == 7 and j.range_bits(10**14) == 22
    for size in (10**6, 10**10, 10**12, 10**14, 10**16):
        bits = j.range_bits(size)
        assert size / 2**bits <= j.RANGE_BYTES and (bits == 7 or size / 2 ** (bits - 1) > j.RANGE_BYTES)
        assert j.flush_after(bits) >= 4 * 2**bits


def test_partitions_do_not_matter(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert sorted((tuple(r) for r in jaccard_classes(df.repartition(9)).collect()), key=repr) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
