"""Schemas written as ``name:type,name:type`` headers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MAX_ID = 2**32 - 1

# The type names that a header may use.
TYPE_NAMES: dict[str, T.DataType] = {
    "": T.NullType(),
    "empty": T.NullType(),
    "int": T.IntegerType(),
    "int32": T.IntegerType(),
    "i32": T.IntegerType(),
    "uint": T.LongType(),
    "uint32": T.LongType(),
    "u32": T.LongType(),
    "long": T.LongType(),
    "int64": T.LongType(),
    "long long": T.LongType(),
    "i64": T.LongType(),
    "float": T.FloatType(),
    "float32": T.FloatType(),
    "f32": T.FloatType(),
    "double": T.DoubleType(),
    "float64": T.DoubleType(),
    "f64": T.DoubleType(),
    "string": T.StringType(),
}
UNSIGNED = frozenset({"uint", "uint32", "u32"})


@dataclass(frozen=True)
class HeaderField:
    """One ``name:type`` entry of a header."""

    name: str
    token: str

    @property
    def data_type(self) -> T.DataType:
        return data_type(self.token)

    @property
    def unsigned(self) -> bool:
        return self.token in UNSIGNED


def data_type(token: str) -> T.DataType:
    """The Spark type of a type name; matched exactly, without trimming."""
    try:
        return TYPE_NAMES[token]
    except KeyError:
        raise ValueError(f"unknown type name {token!r} in a header") from None


def parse_header(header: str) -> list[HeaderField]:
    """Fields of a header, split at the first colon of each entry."""
    fields = []
    for entry in header.rstrip("\r\n").split(","):
        name, colon, token = entry.partition(":")
        if not colon:
            raise ValueError(f"header entry {entry!r} is not of the form name:type")
        data_type(token)
        fields.append(HeaderField(name, token))
    return fields


def struct_of(fields: list[HeaderField]) -> T.StructType:
    """The schema to scan a file with; columns of the null type are scanned as strings."""
    return T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.data_type, T.NullType) else f.data_type) for f in fields]
    )
