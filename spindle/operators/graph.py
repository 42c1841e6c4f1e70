"""Undirected multigraphs over a dense space of vertex ids."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.operators.partition import Partitioner, hash_partitioner, partition_edges, partition_vertices, range_partitioner
from spindle.session import keep, materialise, scratch

#: Neighbours in one row of blocked adjacency.
BLOCK_ENTRIES = 4096


def graph_info(edges: DataFrame) -> DataFrame:
    """One row ``(vertex_num, edge_num)``: one more than the largest id (1 for no edges), and the number of input rows."""
    return edges.agg(
        (F.coalesce(F.max(F.greatest("src", "dst")), F.lit(0)) + 1).cast("long").alias("vertex_num"),
        F.count(F.lit(1)).cast("long").alias("edge_num"),
    )


def symmetrise(edges: DataFrame) -> DataFrame:
    """Every edge in both directions: a self-loop gives two rows, repeated edges stay."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def edge_ends(edges: DataFrame) -> DataFrame:
    """``(id, deg)`` of the vertices that have edges. Counts the ends in one scan, before any shuffle of both directions."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))


def _block_task(most: int):
    """Cuts the runs of each vertex, which come sorted, into rows of at most ``most`` entries."""

    def cut(src: np.ndarray, entry: pa.Array, last: bool):
        """Rows of the blocks that are whole, and where the one that may go on begins."""
        starts = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
        size = np.diff(np.append(starts, len(src)))
        blocks = -(-size // most)
        nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        edge = np.append(np.repeat(starts, blocks) + most * nth, len(src))
        if not last and edge[-1] - edge[-2] < most:
            edge = edge[:-1]
        lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), entry)
        cols = [pa.array(src[edge[:-1]]), lists, pa.array(np.diff(edge).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, ["id", "nbrs", "size"]), int(edge[-1])

    def run(source):
        rest = None
        for batch in source:
            whole = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if whole.num_rows:
                out, at = cut(whole.column("src").to_numpy(), whole.column("entry"), False)
                rest = whole.slice(at)
                if out.num_rows:
                    yield out
        if rest is not None and rest.num_rows:
            yield cut(rest.column("src").to_numpy(), rest.column("entry"), True)[0]

    return run


def adjacency_blocks(sym_edges: DataFrame, most: int = BLOCK_ENTRIES) -> DataFrame:
    """``(id, block, start, nbrs)`` of edges in both directions: see :meth:`Graph.blocks`. Writes the rows once."""
    if most < 1:
        raise ValueError("a block has one entry at least")
    fields = ["dst", "data"] if "data" in sym_edges.columns else ["dst"]
    entry = F.struct(F.col("dst").alias("to"), *fields[1:]).alias("entry")
    tied = sym_edges.withColumn("tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange("src", *fields, "tie").sortWithinPartitions("src", *fields, "tie").select("src", entry)
    row = T.StructType([T.StructField("id", T.LongType()), T.StructField("nbrs", T.ArrayType(ordered.schema["entry"].dataType)), T.StructField("size", T.IntegerType())])
    with scratch(sym_edges.sparkSession):
        cut = ordered.mapInArrow(_block_task(most), row).withColumn("place", F.monotonically_increasing_id())
        rows = keep(materialise(cut, "blocks"))
        # Only vertices of several rows have anything to count, and their rows' sizes go without the neighbours.
        before = Window.partitionBy("id").orderBy("place")
        sizes = rows.select("id", "place", "size").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id"))).where("n > 1")
        # Where a vertex goes on in another task, rows begin anew: these vertices' rows are not whole blocks.
        tasks = F.size(F.collect_set(F.shiftright("place", 33)).over(Window.partitionBy("id")))
        numbers = sizes.select("id", "place", (F.row_number().over(before) - 1).cast("long").alias("block"), (F.sum("size").over(before) - F.col("size")).alias("start"), (tasks == 1).alias("whole"))
        numbers = keep(materialise(numbers, "numbers"))
    got = rows.join(numbers, ["id", "place"], "left")
    got = got.select("id", F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("start", F.lit(0)).alias("start"), "nbrs", F.coalesce("whole", F.lit(True)).alias("whole"))
    return got.where("whole").drop("whole").unionAll(_joined(got.where("not whole").drop("whole"), most))


def _joined(rows: DataFrame, most: int) -> DataFrame:
    """Full rows of the vertices that lie in several tasks: each row is cut where a block ends, and a block's parts are put together."""
    first, last = F.expr(f"start div {most}"), F.expr(f"(start + size(nbrs) - 1) div {most}")
    parts = rows.select("id", "start", "nbrs", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * most)
    part = F.expr(f"slice(nbrs, cast(greatest(block * {most} - start, 0) as int) + 1, cast((block + 1) * {most} - greatest(start, block * {most}) as int))")
    full = parts.select("id", "block", F.struct(begin.alias("start"), part.alias("nbrs")).alias("part")).groupBy("id", "block").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return full.select("id", "block", F.col("parts")[0]["start"].alias("start"), F.flatten(F.col("parts.nbrs")).alias("nbrs"))


@dataclass
class Graph:
    """Edges ``(src, dst[, data])`` with what follows from them, in ``parts`` partitions; every table is a lazy DataFrame."""

    edges: DataFrame
    parts: int = 1
    hashed: bool = False

    @cached_property
    def partitioner(self) -> Partitioner:
        """Which of ``parts`` partitions an id is in: by ranges of ids, or by their hash."""
        return hash_partitioner(self.parts) if self.hashed else range_partitioner(self.vertex_num, self.parts)

    def partitioned_vertices(self) -> DataFrame:
        """``(id, part)`` of all vertices."""
        return partition_vertices(self.vertices(), self.partitioner)

    def partitioned_edges(self) -> DataFrame:
        """Every edge with the partitions of its ends; one row if both are the same."""
        return partition_edges(self.edges, self.partitioner)

    @cached_property
    def info(self) -> tuple[int, int]:
        """``(vertex_num, edge_num)``; runs one aggregate over the edges."""
        row = graph_info(self.edges).first()
        return row["vertex_num"], row["edge_num"]

    @property
    def vertex_num(self) -> int:
        return self.info[0]

    @property
    def edge_num(self) -> int:
        return self.info[1]

    @property
    def sym_edges(self) -> DataFrame:
        return symmetrise(self.edges)

    def vertices(self) -> DataFrame:
        """``(id)``: all ids below ``vertex_num``, whether they have edges or not."""
        return self.edges.sparkSession.range(self.vertex_num)

    def degrees(self) -> DataFrame:
        """``(id, deg)`` of all vertices."""
        return self.vertices().join(edge_ends(self.edges), "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))

    def adjacency(self) -> DataFrame:
        """``(id, nbrs)``: neighbours of all vertices as sorted arrays of ``(to[, data])``.

        One row holds all neighbours of a vertex. For vertices of unbounded degree use :meth:`blocks` or :meth:`neighbours`.
        """
        entry = [F.col("dst").alias("to")] + (["data"] if "data" in self.edges.columns else [])
        lists = self.sym_edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*entry))).alias("nbrs"))
        empty = F.array().cast(lists.schema["nbrs"].dataType)
        return self.vertices().join(lists, "id", "left").select("id", F.coalesce("nbrs", empty).alias("nbrs"))

    def blocks(self, most: int = BLOCK_ENTRIES) -> DataFrame:
        """``(id, block, start, nbrs)``: the adjacency of all vertices with edges, ``most`` entries a row at most.

        ``block`` counts a vertex's rows from 0, ``start`` is how many entries stand before the row, and the entries of all
        rows in order are the sorted array that :meth:`adjacency` has. Both directions are sorted by ranges of vertex and
        neighbour, so tasks share a vertex of many neighbours, even if all are the same one; each task cuts its runs, and rows
        of a vertex in several tasks are fitted together after that: all rows of a vertex but its last have ``most`` entries.
        """
        return adjacency_blocks(self.sym_edges, most)

    def neighbours(self, vertex: int) -> DataFrame:
        """The adjacency entries of one vertex as rows."""
        return self.sym_edges.where(F.col("src") == vertex).drop("src").withColumnRenamed("dst", "to")

    def array(self, init: Column | int | float) -> DataFrame:
        """``(id, value)``: the same value for every vertex."""
        return self.vertices().withColumn("value", init if isinstance(init, Column) else F.lit(init))
