"""Traversal of a table in numbered chunks of bounded size, which can stop and go on.

The rows are put in order once, across tasks, and written with their positions; a chunk is a run of so many positions. Chunks lie in
folders of ``FOLDER`` chunks each, so what a wave does not ask for is not read. A wave is a number of consecutive chunks that are
processed at the same time, each by one task; waves double until one of their chunks says stop. The traversal then
stands behind the first chunk that did, and can go on from there, in this or in another process.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.session import keep, materialise, scratch

#: Chunks in a folder of the written table; chunks of the first wave, and of the largest.
FOLDER, FIRST_WAVE, LARGEST_WAVE = 64, 8, 4096
POSITION, CHUNK = "position", "chunk"


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``position``: 0, 1, ... in ascending order of some columns, without one task that sees all rows.

    Rows are sorted by ranges; each task counts its rows, and a table of a row a task says where each begins. Equal keys
    are numbered as they come, and may be parted between tasks. Runs one job that writes the sorted rows.
    """
    tie, place, begins = "spindle_tie", "spindle_place", "spindle_begin"
    sorted_ = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    rows = materialise(sorted_.drop(tie).withColumn(place, F.monotonically_increasing_id()), "sorted").withColumn("spindle_task", F.shiftrightunsigned(place, 33))
    before = Window.orderBy("spindle_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    counts = rows.groupBy("spindle_task").agg(F.count(F.lit(1)).alias("n"))
    begin = counts.select("spindle_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(begins))
    at = F.col(begins) + F.col(place).bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(begin), "spindle_task").select(*df.columns, at.alias(POSITION))


@dataclass
class Traversal:
    """Chunks of ``chunk_rows`` rows of a table in the order of some columns; ``next_chunk`` is where it goes on."""

    table: DataFrame
    chunk_rows: int
    chunks: int
    next_chunk: int = 0
    stopped: bool = False
    waves: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def over(cls, df: DataFrame, order: list[str], chunk_rows: int) -> Traversal:
        """Numbers and writes the chunks of a table. The columns ``position`` and ``chunk`` are added."""
        if chunk_rows < 1:
            raise ValueError("a chunk has one row at least")
        taken = {POSITION, CHUNK, "folder"} & {c.lower() for c in df.columns}
        if taken:
            raise ValueError(f"columns of the traversal's own names: {', '.join(sorted(taken))}")
        with scratch(df.sparkSession):
            numbered = positions(df, order).withColumn(CHUNK, F.expr(f"{POSITION} div {chunk_rows}L"))
            table = keep(materialise(numbered.withColumn("folder", F.expr(f"{CHUNK} div {FOLDER}L")), "chunks", partition_by=["folder"]))
        last = table.agg(F.max(CHUNK).alias("last")).first()["last"]
        return cls(table, chunk_rows, 0 if last is None else last + 1)

    def reset(self) -> None:
        """Goes back to the first chunk."""
        self.next_chunk, self.stopped = 0, False

    def chunk_range(self, first: int, end: int) -> DataFrame:
        """The rows of the chunks from ``first`` to before ``end``; only their folders are read."""
        folders = (F.col("folder") >= first // FOLDER) & (F.col("folder") <= (end - 1) // FOLDER)
        return self.table.where(folders & (F.col(CHUNK) >= first) & (F.col(CHUNK) < end)).drop("folder")

    def run(self, process: Callable[[pa.Table], bool], first_wave: int = FIRST_WAVE) -> int | None:
        """Calls ``process`` on chunks, in waves, until it returns false for one: the number of the first such chunk, or none.

        ``process`` gets a chunk's rows in order and returns whether to go on. It runs in tasks, at least once for each
        chunk up to the one that stops, and perhaps for later ones of the same wave, whose answers are then ignored;
        chunks of later waves are not read. The traversal stands behind the chunk returned: running again goes on there.
        """
        wave = first_wave
        self.stopped = False
        while self.next_chunk < self.chunks:
            end = min(self.chunks, self.next_chunk + wave)
            self.waves.append((self.next_chunk, end))
            rows = self.chunk_range(self.next_chunk, end)
            answers = rows.groupBy(CHUNK).applyInArrow(_chunk_task(process), f"{CHUNK} long, go_on boolean")
            stop = answers.where(~F.col("go_on")).agg(F.min(CHUNK).alias("at")).first()["at"]
            if stop is not None:
                self.next_chunk, self.stopped = stop + 1, True
                return stop
            self.next_chunk, wave = end, min(LARGEST_WAVE, 2 * wave)
        return None


def _chunk_task(process: Callable[[pa.Table], bool]):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by(POSITION)
        return pa.table({CHUNK: pa.array([key[0].as_py()], pa.int64()), "go_on": pa.array([bool(process(table))])})

    return run


def resume(spark: SparkSession, path: str, chunk_rows: int, next_chunk: int) -> Traversal:
    """A traversal of chunks that another process wrote, from a chunk on."""
    table = spark.read.parquet(path)
    last = table.agg(F.max(CHUNK).alias("last")).first()["last"]
    return Traversal(table, chunk_rows, 0 if last is None else last + 1, next_chunk)
