"""Readers for typed edge and vertex lists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.sources.schema import MAX_ID, HeaderField, parse_header, struct_of


@dataclass(frozen=True)
class ReadOptions:
    """How to read an edge list. ``header`` overrides the first line, which is still skipped if ``has_header``."""

    has_header: bool = True
    header: str = ""
    include_columns: tuple[str, ...] = field(default_factory=tuple)
    from_column: str = "from"
    to_column: str = "to"
    id_column: str = "id"


def read_fields(spark: SparkSession, path: str, options: ReadOptions) -> list[HeaderField]:
    """The fields of a file: of ``options.header`` if set, else of the first line of one of the files.

    The other files of a folder are not read here: the scan compares each file's own first line with these fields.
    """
    if options.header:
        return parse_header(options.header)
    if not options.has_header:
        raise ValueError("a file without a header line needs options.header")
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} is empty and no header is given")
    return parse_header(first[0])


def checked(column: Column, of: HeaderField) -> Column:
    """The column, failing at run time on nulls and on ids outside of 32 unsigned bits."""
    if isinstance(of.data_type, T.NullType):
        return F.lit(None)
    bad = column.isNull()
    if of.unsigned:
        bad = bad | (column < 0) | (column > MAX_ID)
    message = F.concat(F.lit(f"column {of.name}: null, or out of range: "), F.coalesce(column.cast("string"), F.lit("null")))
    return F.when(bad, F.raise_error(message).cast(of.data_type)).otherwise(column)


def _scan(spark: SparkSession, path: str, fields: list[HeaderField], options: ReadOptions) -> DataFrame:
    reader = spark.read.option("mode", "FAILFAST").option("escape", '"').option("header", str(options.has_header).lower())
    # A projected scan would not notice short or long rows, nor wrong values in columns that nobody selects.
    reader = reader.option("columnPruning", "false")
    schema = struct_of(fields)
    if options.has_header and not options.header:
        # The fields came from one file: the scan holds the first line of every file against them, entry by entry, as it
        # gets there, and fails on a file that has others or in another order. The entries are the columns' names for that.
        entries = [f"{f.name}:{f.token}" for f in fields]
        named = T.StructType([T.StructField(e, f.dataType) for e, f in zip(entries, schema, strict=True)])
        rows = reader.schema(named).option("enforceSchema", "false").csv(path).toDF(*[f.name for f in fields])
    else:
        rows = reader.schema(schema).option("enforceSchema", "true").csv(path)
    bad = F.lit(False)
    for f in fields:
        if not isinstance(f.data_type, T.NullType):
            bad = bad | F.col(f"`{f.name}`").isNull()
    return rows.where(F.when(bad, F.raise_error(F.lit("a row with a missing value")).cast("boolean")).otherwise(F.lit(True)))


def _select(df: DataFrame, fields: list[HeaderField], ids: list[tuple[str, str]], options: ReadOptions) -> DataFrame:
    by_name = {f.name: f for f in fields}
    missing = [c for c, _ in ids if c not in by_name] + [c for c in options.include_columns if c not in by_name]
    if missing:
        raise ValueError(f"no such columns in the header: {', '.join(missing)}")
    wrong = [c for c, _ in ids if not by_name[c].unsigned]
    if wrong:
        raise ValueError(f"id columns must be of an unsigned 32-bit type: {', '.join(wrong)}")
    out = [checked(F.col(f"`{c}`"), by_name[c]).alias(name) for c, name in ids]
    if options.include_columns:
        out.append(F.struct(*[checked(F.col(f"`{c}`"), by_name[c]).alias(c) for c in options.include_columns]).alias("data"))
    return df.select(*out)


@dataclass(frozen=True)
class BatchPayload:
    """User code that makes payloads of batches of columns.

    ``make`` gets the included columns of a batch, in their order, as an Arrow batch, and returns one payload for each row:
    a struct array, or a batch with the fields of ``schema``, a DDL string or a struct type. Fields are taken by name;
    a field that is missing, has another type or another number of rows fails the query. Batches hold a bounded number
    of bytes; which rows share one is Spark's affair, so a payload may depend on its own row alone.
    """

    schema: str | T.StructType
    make: Callable[[pa.RecordBatch], pa.RecordBatch | pa.StructArray]

    @property
    def data_type(self) -> T.StructType:
        return self.schema if isinstance(self.schema, T.StructType) else T.StructType.fromDDL(self.schema)


def _payload_task(make: Callable, want: pa.StructType):
    def run(source):
        for batch in source:
            data = batch.column("data")
            given = pa.RecordBatch.from_arrays(data.flatten(), [f.name for f in data.type])
            got = make(given)
            if isinstance(got, pa.StructArray):
                got = pa.RecordBatch.from_arrays(got.flatten(), [f.name for f in got.type])
            if not isinstance(got, pa.RecordBatch):
                raise TypeError(f"a payload of {type(got).__name__}, not of Arrow structs")
            if got.num_rows != batch.num_rows:
                raise ValueError(f"{got.num_rows} payloads for {batch.num_rows} rows")
            if sorted(got.schema.names) != sorted(f.name for f in want):
                raise ValueError(f"payload fields {got.schema.names}, not {[f.name for f in want]}")
            fields = []
            for f in want:
                have = got.column(f.name)
                if have.type != f.type:
                    raise TypeError(f"payload field {f.name} is {have.type}, not {f.type}")
                fields.append(have)
            rest = [batch.column(c) for c in batch.schema.names if c != "data"]
            names = [c for c in batch.schema.names if c != "data"] + ["data"]
            yield pa.RecordBatch.from_arrays([*rest, pa.StructArray.from_arrays(fields, fields=list(want))], names)

    return run


def map_payload(edges: DataFrame, payload: BatchPayload) -> DataFrame:
    """The edges, or vertices, with the payloads that user code makes of theirs, batch by batch where the rows are."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = payload.data_type
    rest = [f for f in edges.schema if f.name != "data"]
    out = T.StructType([*rest, T.StructField("data", kind)])
    return edges.mapInArrow(_payload_task(payload.make, to_arrow_type(kind)), out)


def read_edges(spark: SparkSession, path: str, options: ReadOptions | None = None, payload: BatchPayload | None = None) -> DataFrame:
    """Edges ``(src, dst[, data])`` of CSV files, gzip included; the payload has ``include_columns`` in their order.

    A folder's files need the same first line, if it is theirs that names the columns: a file with another one fails the
    query, whatever is selected. With ``payload`` user code makes the payload of the included columns.
    """
    options = options or ReadOptions()
    fields = read_fields(spark, path, options)
    edges = _select(_scan(spark, path, fields, options), fields, [(options.from_column, "src"), (options.to_column, "dst")], options)
    if payload is None:
        return edges
    if not options.include_columns:
        raise ValueError("a payload needs include_columns to be made of")
    return map_payload(edges, payload)


def read_vertices(spark: SparkSession, path: str, options: ReadOptions | None = None) -> DataFrame:
    """Vertices ``(id[, data])`` of a CSV file. An extension: same checks as :func:`read_edges`."""
    options = options or ReadOptions()
    fields = read_fields(spark, path, options)
    return _select(_scan(spark, path, fields, options), fields, [(options.id_column, "id")], options)


def edges_from(df: DataFrame, src: Column | str, dst: Column | str, *payload: Column | str, map_payload: Callable[[list[Column]], Column] | None = None) -> DataFrame:
    """Edges from any DataFrame. ``map_payload`` turns the payload columns into one payload value."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    cols = [as_col(c) for c in payload]
    out = [as_col(src).cast("long").alias("src"), as_col(dst).cast("long").alias("dst")]
    if cols:
        out.append((map_payload(cols) if map_payload else F.struct(*cols)).alias("data"))
    return df.select(*out)


def load_edges(spark: SparkSession, path: str, options: ReadOptions | None = None, format: str = "") -> DataFrame:
    """Edges of a file or folder in any format that Spark reads, by ``format`` or else the path's ending; CSV if that says nothing.

    Other formats than CSV have schemas of their own: ids must be integers from 0 to 4294967295, and nulls fail here too.
    """
    options = options or ReadOptions()
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    format = format or (ending if ending in ("parquet", "orc", "json", "avro") else "csv")
    if format == "csv":
        return read_edges(spark, path, options)
    df = spark.read.format(format).load(path)
    names = {"int": "int", "bigint": "uint", "float": "float", "double": "double", "string": "string"}
    kinds = {f.name: names.get(f.dataType.simpleString(), "") for f in df.schema}
    fields = [HeaderField(n, "uint" if n in (options.from_column, options.to_column) and k in ("int", "uint") else "long" if k == "uint" else k) for n, k in kinds.items()]
    return _select(df, fields, [(options.from_column, "src"), (options.to_column, "dst")], options)


def write_edges(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes edges as CSV without a header line; the payload's fields follow the two ids."""
    cols = [F.col("src"), F.col("dst")]
    if "data" in edges.columns:
        cols += [F.col(f"data.`{f.name}`") for f in edges.schema["data"].dataType.fields]
    edges.select(*cols).write.mode(mode).csv(path, escape='"')
