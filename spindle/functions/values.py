"""Strict scalar operators on columns: both sides of one type, no silent coercion.

Integers raise on overflow and on division by zero; floats follow IEEE 754, division by zero included. Booleans,
strings and nulls have no arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = (T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)

# Names of scalar types, and the order in which values of different types compare.
VALUE_TYPES: dict[str, T.DataType] = {
    "empty": T.NullType(),
    "bool": T.BooleanType(),
    "int": T.IntegerType(),
    "int32": T.IntegerType(),
    "long": T.LongType(),
    "int64": T.LongType(),
    "long long": T.LongType(),
    "float": T.FloatType(),
    "float32": T.FloatType(),
    "double": T.DoubleType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
}
TYPE_ORDER = ("void", "boolean", "int", "bigint", "float", "double", "string")


def value_type(name: str) -> T.DataType:
    """The type of a scalar type name."""
    try:
        return VALUE_TYPES[name]
    except KeyError:
        raise ValueError(f"unknown value type {name!r}") from None


def _number_type(df: DataFrame, left: str, right: str) -> T.DataType:
    a, b = df.schema[left].dataType, df.schema[right].dataType
    if a != b:
        raise TypeError(f"operands differ in type: {a.simpleString()} and {b.simpleString()}")
    if not isinstance(a, INTEGERS + FLOATS):
        raise TypeError(f"no arithmetic on {a.simpleString()}")
    return a


def exact(operator: str, a: Column, b: Column, kind: T.DataType) -> Column:
    """``a + b``, ``a - b`` or ``a * b`` of one type. Integers are checked against the type's range, whatever the session's ANSI setting is."""
    if isinstance(kind, FLOATS):
        return {"+": a + b, "-": a - b, "*": a * b}[operator].cast(kind)
    out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[operator](a, b)
    overflow = out.isNull() & a.isNotNull() & b.isNotNull()
    return F.when(overflow, F.raise_error(F.lit(f"overflow of {kind.simpleString()}")).cast(kind)).otherwise(out)


def quotient(a: Column, b: Column, kind: T.DataType) -> Column:
    """``a / b`` of one type: integers truncate toward zero, floats give an infinity or NaN for a zero divisor."""
    if isinstance(kind, INTEGERS):
        name = kind.simpleString()
        low = F.lit(-(2 ** (31 if isinstance(kind, T.IntegerType) else 63))).cast(kind)
        bad = (b == 0) | ((a == low) & (b == -1))
        safe = F.when(bad, F.lit(1).cast(kind)).otherwise(b)
        out = F.call_function("div", a, safe).cast(kind)
        return F.when(bad, F.raise_error(F.lit(f"division of {name} by zero, or overflow")).cast(kind)).otherwise(out)
    inf, nan = F.lit(float("inf")).cast(kind), F.lit(float("nan")).cast(kind)
    negative_zero = b.cast("string").startswith("-")
    at_zero = F.when(F.isnan(a) | (a == 0), nan).otherwise(F.when((a > 0) != negative_zero, inf).otherwise(-inf))
    return F.when(b == 0, at_zero).otherwise((a / F.when(b != 0, b)).cast(kind))


def add(df: DataFrame, left: str, right: str) -> Column:
    """``left + right``."""
    return exact("+", F.col(left), F.col(right), _number_type(df, left, right))


def subtract(df: DataFrame, left: str, right: str) -> Column:
    """``left - right``."""
    return exact("-", F.col(left), F.col(right), _number_type(df, left, right))


def multiply(df: DataFrame, left: str, right: str) -> Column:
    """``left * right``."""
    return exact("*", F.col(left), F.col(right), _number_type(df, left, right))


def divide(df: DataFrame, left: str, right: str) -> Column:
    """``left / right``: integers truncate toward zero, floats give an infinity or NaN for a zero divisor."""
    return quotient(F.col(left), F.col(right), _number_type(df, left, right))


def parse(text: Column, kind: str) -> Column:
    """The typed value of a string; a string that is no such value fails the query. Null stays null."""
    to = value_type(kind)
    if isinstance(to, T.NullType):
        return F.lit(None)
    if isinstance(to, T.StringType):
        return text
    if isinstance(to, T.BooleanType):
        value = F.when(text == "true", True).when(text == "false", False)
    else:
        value = text.try_cast(to)
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"not a {kind}: "), text)).cast(to)).otherwise(value)


def extract(df: DataFrame, column: str, kind: str) -> Column:
    """The column, if it has exactly that type."""
    have, want = df.schema[column].dataType, value_type(kind)
    if have != want:
        raise TypeError(f"{column} is {have.simpleString()}, not {want.simpleString()}")
    return F.col(column)


def order(df: DataFrame, left: str, right: str) -> Column:
    """-1, 0 or 1; null where a NaN makes the two unordered. Different types compare by their place in ``TYPE_ORDER``."""
    a, b = df.schema[left].dataType, df.schema[right].dataType
    if a != b:
        x, y = TYPE_ORDER.index(a.simpleString()), TYPE_ORDER.index(b.simpleString())
        return F.lit(-1 if x < y else 1)
    if isinstance(a, T.NullType):
        return F.lit(0)
    x, y = F.col(left), F.col(right)
    out = F.when(x < y, -1).when(x > y, 1).when(x == y, 0)
    return F.when(~(F.isnan(x) | F.isnan(y)), out) if isinstance(a, FLOATS) else out


def equal(df: DataFrame, left: str, right: str) -> Column:
    """Whether both have one type and value; NaN equals nothing."""
    if df.schema[left].dataType != df.schema[right].dataType:
        return F.lit(False)
    if isinstance(df.schema[left].dataType, T.NullType):
        return F.lit(True)
    out = F.col(left) == F.col(right)
    return out & ~F.isnan(F.col(left)) if isinstance(df.schema[left].dataType, FLOATS) else out
