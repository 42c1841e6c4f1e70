"""From raw documents to packed training sequences: language, near copies, benchmark passages, packing."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import decontaminate, jaccard_join, language, packing
from spindle.session import keep, materialise, scratch

#: Ids to drop are broadcast up to this number, 16 bytes each; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bits of a row's number that count rows of one file; those above them count files.
ROW_BITS = 40
# Models and components have no SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the language model rejects, those without a letter included.

    The model learns from the documents that name their language; without any, only texts without letters go.
    """
    return language.accepted(docs, language.fit(docs))


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a number for each row that is the same in every job, whatever number of cores reads the table.

    Rows of a table that is read as it lies have the place of their file among all files, by name, and their place in the
    file: nothing is written. Any other rows are written once with numbers beside them, as numbers made anew in each job
    would follow the splits of the files.
    """
    at = docs.metadataColumn("_metadata") if docs._jdf.queryExecution().analyzed().children().isEmpty() and docs.inputFiles() else None
    if at is None:
        return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    names = sorted(r[0] for r in docs.select(at["file_path"]).distinct().collect())
    file, nth, place = (f"{row}_{n}_of_{len(docs.columns)}_columns" for n in ("file", "nth", "place"))
    files = docs.sparkSession.createDataFrame([(n, i << ROW_BITS) for i, n in enumerate(names)], f"{file} string, {nth} long")
    placed = docs.withColumns({file: at["file_path"], place: at["row_index"]}).join(F.broadcast(files), file)
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col(nth) + F.col(place)).alias(row))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of linked rows, the one with the smallest id; rows without a word are in no group.

    Groups are of rows, each named by a number of its own, so rows that repeat an id or have none are judged like any
    other: one of each group stays, ids before nulls, the first number of equal ids.
    """
    row = next(n for n in itertools.chain(["row"], (f"row_{i}" for i in itertools.count())) if n not in docs.columns)
    placed = numbered(docs, row)
    with scratch(spark):
        classes = jaccard_join.jaccard_classes(placed.select(row, "text"), id_col=row)
        linked = classes.where("n_links > 0").select(F.col("doc_id").alias("at"), "component_id")
        ids = placed.select(F.col(row).alias("at"), F.col("doc_id"))
        members = materialise(linked.join(ids, "at"), "members")
        first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at")).alias("first"))
        gone = keep(materialise(members.select("at").join(first.select(F.col("first.at").alias("at")), "at", "left_anti"), "gone"))
    small = gone.count() <= BROADCAST_IDS
    return placed.join(F.broadcast(gone) if small else gone, placed[row] == gone["at"], "left_anti").drop(row)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark; null and wordless texts, and null ids, stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left: a row for each piece of a document. A null text is the end id alone; null ids stay null."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result but the last is written and read again.

    An empty table gives no rows; further columns are carried along up to the last stage, whatever their names.
    """
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = materialise(docs, "stage")
    return docs
