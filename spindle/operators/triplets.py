"""Predicates and maps over one, two or three rows, given as SQL expressions and checked against the rows' schemas.

Rows are struct columns: a vertex or an edge by itself, two vertices, or a triplet of source, edge and target. An expression
may name their fields and nothing else; that, and that a predicate is a condition, is checked when it is compiled, before any data is
read. Compiled operations are plain column expressions: they are pushed down, pruned and compiled with the rest of a query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.operators.aggregate import REPLICATE_BYTES, row_bytes, small_enough

SRC, EDGE, DST = "src", "edge", "dst"


@dataclass(frozen=True)
class Judge:
    """A compiled predicate over ``rows``. Where it is unknown, for a null, it is no."""

    text: str
    rows: tuple[str, ...]

    def where(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` that meet it."""
        return df.where(self.text)

    def mark(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with a column that says whether each row meets it."""
        return df.withColumn(name, F.coalesce(F.expr(self.text), F.lit(False)))


@dataclass(frozen=True)
class Combine:
    """A compiled map over ``rows`` to one row with the fields of ``schema``."""

    texts: tuple[str, ...]
    rows: tuple[str, ...]
    schema: T.StructType

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the row that it gives as a struct column."""
        return df.withColumn(name, F.struct(*[F.expr(t) for t in self.texts]))

    def select(self, df: DataFrame) -> DataFrame:
        """Its fields alone, as columns."""
        return df.select(*[F.expr(t) for t in self.texts])


class Operations:
    """Compiles expressions over rows of known schemas: ``Operations(spark, src=..., edge=..., dst=...)``, or of a DataFrame's structs."""

    def __init__(self, spark: SparkSession, **schemas: T.StructType | str):
        self.spark = spark
        self.schemas = {n: s if isinstance(s, T.StructType) else T.StructType.fromDDL(s) for n, s in schemas.items()}

    @classmethod
    def of(cls, df: DataFrame) -> Operations:
        """Of all struct columns of a DataFrame."""
        return cls(df.sparkSession, **{f.name: f.dataType for f in df.schema if isinstance(f.dataType, T.StructType)})

    def _rows(self, rows: tuple[str, ...], least: int = 1) -> DataFrame:
        """No rows, with those structs alone."""
        if not least <= len(rows) <= 3 or len(set(rows)) < len(rows):
            raise ValueError("an operation is over one, two or three different rows")
        unknown = [r for r in rows if r not in self.schemas]
        if unknown:
            raise ValueError(f"no such rows: {', '.join(unknown)}; there are {', '.join(self.schemas)}")
        return self.spark.createDataFrame([], T.StructType([T.StructField(r, self.schemas[r]) for r in rows]))

    def judge(self, text: str, *rows: str) -> Judge:
        """A predicate: an SQL condition on fields ``row.field`` of one, two or three rows."""
        none = self._rows(rows)
        try:
            kind = none.where(text).select(F.expr(text).alias("met")).schema["met"].dataType
        except (AnalysisException, ParseException) as e:
            raise ValueError(f"not a condition on {', '.join(rows)}: {text}: {e}") from None
        if not isinstance(kind, T.BooleanType):
            raise ValueError(f"not a condition: {text}")
        return Judge(text, rows)

    def combine(self, text: str | list[str], *rows: str) -> Combine:
        """A map: one or more SQL expressions ``... AS field`` on fields of one, two or three rows."""
        texts = (text,) if isinstance(text, str) else tuple(text)
        none = self._rows(rows)
        try:
            schema = none.select(*[F.expr(t) for t in texts]).schema
            # An aggregate, a window or a generator is not a map of single rows, and has no place in a condition.
            none.withColumn("row", F.col(rows[0])).where(F.struct(*[F.expr(t) for t in texts]).isNotNull()).schema  # noqa: B018
        except (AnalysisException, ParseException) as e:
            raise ValueError(f"not a map of {', '.join(rows)}: {texts}: {e}") from None
        names = [f.name for f in schema]
        if len({n.lower() for n in names}) < len(names) or not names:
            raise ValueError(f"fields of a map need names of their own: {names}")
        return Combine(texts, rows, schema)


def triplets(edges: DataFrame, vertices: DataFrame, limit: int = REPLICATE_BYTES) -> DataFrame:
    """``(src, edge, dst)``, a struct each: every edge of ``(src, dst[, data])`` with the vertices at its ends.

    ``vertices`` has a row for each ``id`` and its fields; a vertex without a row has nulls for them, but for the id. The
    edge's struct has the fields of ``data``, or none but ``exists``. Vertices are counted: up to ``limit`` bytes they are
    replicated and no edge moves. Beyond that edges are dealt by source for the first join and by target for the second,
    once each; where they already lie by source the first costs nothing. Hubs are split by adaptive execution.
    """
    fields = [c for c in vertices.columns if c != "id"]
    data = "data" in edges.columns
    edge = F.col("data") if data else F.struct(F.lit(True).alias("exists"))
    rows = edges.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), edge.alias(EDGE))
    few = small_enough(vertices.count(), row_bytes(vertices), limit)

    def meet(left: DataFrame, key: str, name: str) -> DataFrame:
        side = vertices.select(F.col("id").alias(key), F.struct(*[F.col(c) for c in fields]).alias("fields") if fields else F.lit(None).alias("fields"))
        got = left.join(F.broadcast(side) if few else side, key, "left")
        return got.withColumn(name, F.struct(F.col(key).alias("id"), *[F.col("fields")[c].alias(c) for c in fields])).drop("fields")

    return meet(meet(rows, "from_id", SRC), "to_id", DST).select(SRC, EDGE, DST)
