"""The pipeline's stages against brute force on a small table, and on the smallest input."""

import os
import random
from collections import Counter

import corpus_pipeline as p
import pytest
from test_decontaminate import brute as passages
from test_jaccard_join import corpus
from test_tokens import check_packing

from spindle.session import materialise, settings


def documents(spark):
    """Null and repeated ids included, and columns that clash with the operators' own."""
    texts = [*corpus(), (None, "no id at all here twice over"), (None, "no id at all here twice over"), (90_001, "1 2 3 4 5 6")]
    rows = [(d, t, "en" if (d or 0) % 3 else None, "s", len(t or ""), "x", 1, 2) for d, t in texts]
    long = next(t for _, t in texts if t and len(t.split()) > 100)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, component_id int, items int").repartition(3), long


def test_stages(spark, tmp_path):
    docs, long = documents(spark)
    item = " ".join(long.split()[20:60])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    one = materialise(p.language_id(spark, docs, str(tmp_path)), "one")
    assert one.columns == docs.columns
    before, after = Counter(tuple(r) for r in docs.collect()), Counter(tuple(r) for r in one.collect())
    assert after <= before and all(not any(c.isalpha() for c in r[1] or "") for r in before - after) and before != after

    two = materialise(p.ngram_jaccard_join(spark, one, str(tmp_path)), "two")
    assert two.columns == docs.columns
    left = [tuple(r) for r in two.collect()]
    from test_jaccard_join import brute

    rows = list(after.elements())
    groups: dict = {}
    for i, _, c, _ in brute([(i, r[1]) for i, r in enumerate(rows)]):
        groups.setdefault(c, []).append(rows[i])
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(left) == len(groups) < len(rows) and any(r[0] is None for r in left)
    assert sorted(map(key, left)) == sorted(min(map(key, g)) for g in groups.values())

    three = materialise(p.benchmark_decontamination(spark, two, str(tmp_path)), "three")
    clean = [tuple(r) for r in three.collect()]
    assert three.columns == docs.columns
    assert sorted(clean, key=repr) == sorted((r for r in left if not passages(r[1], [(1, item)])), key=repr) and len(clean) < len(left)

    four = p.best_fit_packing(spark, three, str(tmp_path))
    n, bound = check_packing([tuple(r) for r in four.collect()], [(r[0], r[1]) for r in clean])
    assert n <= bound + 1


def test_rows_keep_their_numbers(spark, tmp_path):
    """What the second stage drops does not follow how the table is split, as when executors come and go between its jobs."""
    rows = [(i, f"the very same words of group {i // 2} again and again" if i % 4 < 2 else f"text {i} by itself with number {i * i} at its end") for i in range(400)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(path)
    with settings(spark, spark__sql__files__minPartitionNum="16", spark__sql__files__maxPartitionBytes="1k"):
        left = p.ngram_jaccard_join(spark, spark.read.parquet(path), "")
    with settings(spark, spark__sql__files__minPartitionNum="1", spark__sql__files__openCostInBytes="1"):
        got = sorted(r.doc_id for r in left.collect())
    assert got == [i for i, _ in rows if i % 4 != 1]


def test_numbers_are_not_written(spark, tmp_path, monkeypatch):
    """Rows of a table that lies in files are numbered by their place there, without a copy; other rows are written with their numbers."""
    written = []
    monkeypatch.setattr(p, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    spark.range(1000).selectExpr("id AS doc_id", "'x' AS row", "'y' AS `a.b`", "'z' AS _metadata").repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    with settings(spark, spark__sql__files__minPartitionNum="1", spark__sql__files__openCostInBytes="1"):
        one = {r.doc_id: r.n for r in p.numbered(docs, "n").collect()}
    with settings(spark, spark__sql__files__maxPartitionBytes="1k"):
        two = {r.doc_id: r.n for r in p.numbered(docs, "n").collect()}
    assert one == two and len(set(one.values())) == 1000 and not written
    assert p.numbered(docs, "n").columns == [*docs.columns, "n"] and p.numbered(docs.limit(0), "n").collect() == []
    twice = p.numbered(docs.join(docs.select("row").limit(2), "row"), "n").collect()
    assert len({r.n for r in twice}) == len(twice) == 2000 and written


def test_shuffle_files_go_with_the_step(spark):
    """What a written table was shuffled with does not stay on the disks."""
    seen = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = lambda: sum(seen.getAllFiles().apply(i).length() for i in range(seen.getAllFiles().size()) if seen.getAllFiles().apply(i).getName().endswith(".data"))
    before = left()
    materialise(spark.range(1_000_000).selectExpr("id", "xxhash64(id) AS h").repartition(4, "h"), "shuffled")
    assert left() < before + (4 << 20)


def test_foreign_texts_and_noise_go(spark):
    """The first stage drops what its model rejects: letters that are no language, and languages not learnt."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet") if os.path.exists("/root/testdata/sf0.01") else None
    if docs is None:
        pytest.skip("no table to learn from")
    noise = [(-i, " ".join("".join(rng.choice("qxzjkvwpbg") for _ in range(rng.randint(2, 9))) for _ in range(60)), None, "s", 1) for i in range(1, 21)]
    foreign = [(-100 - i, t, None, "s", 1) for i, t in enumerate(["这是一个关于语言识别的测试文本" * 8, "Это проверка распознавания языка документа по его тексту " * 8, "これは言語識別のためのテスト文書です" * 8])]
    more = spark.createDataFrame(noise + foreign, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(f.name).cast(f.dataType) for f in docs.schema])
    kept = {r.doc_id for r in p.language_id(spark, docs.unionByName(more), "").select("doc_id").collect()}
    assert not any(r[0] in kept for r in noise + foreign)
    assert len([i for i in kept if i >= 0]) >= 0.99 * docs.count()


def test_run_and_empty(spark, sf, tmp_path):
    got = p.run(spark, sf).collect()
    ids = {r.doc_id for r in got}
    assert 50 < len(ids) < 200
    docs, _ = documents(spark)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.limit(0).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert p.run(spark, str(tmp_path)).collect() == []
