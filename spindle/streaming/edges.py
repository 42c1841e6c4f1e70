"""Graph figures over an edge stream: an extension, made of the batch expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spindle.operators.graph import edge_ends, graph_info


def stream_info(edges: DataFrame) -> DataFrame:
    """Running ``(vertex_num, edge_num)`` of a streaming DataFrame of edges, for output mode ``complete``."""
    return graph_info(edges)


def stream_degrees(edges: DataFrame) -> DataFrame:
    """Running ``(id, deg)`` of the vertices seen so far, for output modes ``complete`` and ``update``."""
    return edge_ends(edges)
