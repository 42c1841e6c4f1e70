"""Assignments of vertices and edges to partitions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Partitioner = Callable[[Column], Column]


def range_partitioner(vertex_num: int, parts: int) -> Partitioner:
    """Contiguous ranges of ``vertex_num // parts + 1`` ids; the last range ends at ``vertex_num``."""
    if parts < 1:
        raise ValueError("at least one partition is needed")
    chunk = vertex_num // parts + 1
    return lambda vid: F.least(F.expr("bigint(0)") + F.floor(vid / chunk), F.lit(parts - 1)).cast("int")


# Fixed value: an odd number near 2^31 times the golden ratio's fraction, below 2^31 so that products stay in 63 bits.
SPREAD = 1_327_217_885


def hash_partitioner(parts: int) -> Partitioner:
    """Partitions by a multiplicative hash: an extension, usable wherever a range partitioner is.

    Neighbouring ids go to different partitions, and every engine with 64-bit integers computes the same ones.
    """
    if not 1 <= parts < 2**31:
        raise ValueError("at least one partition is needed")
    return lambda vid: F.shiftright((F.pmod(vid, F.lit(2**32)) * SPREAD).bitwiseAND(2**32 - 1) * parts, 32).cast("int")


def partition_vertices(vertices: DataFrame, partitioner: Partitioner) -> DataFrame:
    """``(id, part)``."""
    return vertices.select("id", partitioner(F.col("id")).alias("part"))


def edge_partition(edges: DataFrame, partitioner: Partitioner) -> DataFrame:
    """Edges with the partition of their first end."""
    return edges.withColumn("part", partitioner(F.col("src")))


def partition_edges(edges: DataFrame, partitioner: Partitioner) -> DataFrame:
    """Edges with ``part``: a row for the partition of each end, one row if both are the same."""
    return edges.withColumn("part", F.explode(F.array_distinct(F.array(partitioner(F.col("src")), partitioner(F.col("dst"))))))


def partition_bounds(spark, vertex_num: int, parts: int) -> DataFrame:
    """``(part, start_id, end_id)``: half-open ranges of :func:`range_partitioner`, empty ones included."""
    chunk = vertex_num // parts + 1
    start = F.least(F.col("id") * chunk, F.lit(vertex_num))
    end = F.when(F.col("id") == parts - 1, F.lit(vertex_num)).otherwise(F.least((F.col("id") + 1) * chunk, F.lit(vertex_num)))
    return spark.range(parts).select(F.col("id").cast("int").alias("part"), start.cast("long").alias("start_id"), end.cast("long").alias("end_id"))
