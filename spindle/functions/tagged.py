"""Values whose type is a matter of the row: one column may mix empty values, booleans, numbers and strings.

A tagged value is a struct: ``tag``, the place of its type in ``TAGS``, and one field for each type, of which the tag's holds the
value. Every operator chooses by the tags of the row at hand, in generated code. Arithmetic wants two numbers of
one type; integers raise on overflow and division by zero, floats follow IEEE 754. Values of different types are unequal and
compare by their tags; a NaN equals nothing and is unordered. Extraction wants the type asked for: nothing is ever
coerced. A null struct stays null in every operator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.functions import values

# The types in the order in which values of different types compare.
TAGS = ("empty", "bool", "int", "long", "float", "double", "string")
FIELDS = {"bool": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType()}
NUMBERS = ("int", "long", "float", "double")
TAGGED = T.StructType([T.StructField("tag", T.ByteType()), *(T.StructField(f"as_{k}", t) for k, t in FIELDS.items())])


def _kind(name: str) -> str:
    """The tag's name of any name of its type."""
    want = values.value_type(name)
    return "empty" if isinstance(want, T.NullType) else next(k for k, t in FIELDS.items() if t == want)


def _struct(kind: str, value: Column | None) -> Column:
    fields = [F.lit(TAGS.index(kind)).cast("tinyint").alias("tag")]
    fields += [(value if k == kind else F.lit(None)).cast(t).alias(f"as_{k}") for k, t in FIELDS.items()]
    return F.struct(*fields)


def tagged(value: Column | None, kind: str) -> Column:
    """A column of one type as tagged values; nulls become empty values, as does everything of the empty type."""
    kind = _kind(kind)
    empty = _struct("empty", None)
    return empty if kind == "empty" or value is None else F.when(value.isNull(), empty).otherwise(_struct(kind, value))


def _known(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for n in values.VALUE_TYPES for x in (n, TAGS.index(_kind(n)))])[name]


def _unknown(name: Column, to: T.DataType) -> Column:
    return F.when(name.isNotNull(), F.raise_error(F.concat(F.lit("unknown value type "), name)).cast(to))


def tag_of(name: Column) -> Column:
    """The tag of a type name that is a matter of the row, aliases included; an unknown name fails the query."""
    return F.coalesce(_known(name).cast("tinyint"), _unknown(name, T.ByteType()))


def _apart(met: Column) -> Column:
    """The same condition, in a form that keeps its projection out of whole-stage code.

    Whole stages write all of a projection into one method, and the JVM never compiles methods over 8000 bytes, as these
    choices by type become. Outside of them Spark deals the projection's generated code out to small methods.
    """
    return F.exists(F.array(met), lambda x: x)


def _fields(tag: Column, of: dict[str, Column]) -> Column:
    """One struct of a tag and the values of those types that have one, each of which is null in rows of other types."""
    return F.struct(tag.cast("tinyint").alias("tag"), *[of.get(k, F.lit(None)).cast(t).alias(f"as_{k}") for k, t in FIELDS.items()])


def _names(kind: str) -> list[str]:
    return [n for n in values.VALUE_TYPES if _kind(n) == kind]


def parse(text: Column, name: Column) -> Column:
    """The tagged value of a string by the type name beside it; a string that is no such value fails the query. A null string or name gives null.

    Both are written out several times in the plan: give columns of an earlier ``select`` if they cost much.
    """
    parsed = _fields(_known(name), {k: F.when(name.isin(_names(k)), values.parse(text, k)) for k in FIELDS})
    return F.when(_apart(text.isNotNull() & _known(name).isNotNull()), parsed).when(text.isNotNull(), _unknown(name, TAGGED))


def type_name(value: Column) -> Column:
    """The name of each value's type."""
    return F.when(value["tag"].isNotNull(), F.element_at(F.array(*[F.lit(t) for t in TAGS]), value["tag"].cast("int") + 1))


def _arithmetic(a: Column, b: Column, name: str, of) -> Column:
    low, high = TAGS.index(NUMBERS[0]), TAGS.index(NUMBERS[-1])
    got = {k: F.when(a["tag"] == TAGS.index(k), of(a[f"as_{k}"], b[f"as_{k}"], FIELDS[k])) for k in NUMBERS}
    out = F.when(_apart(a["tag"].isNull() | b["tag"].isNull()), F.lit(None).cast(TAGGED))
    out = out.when((a["tag"] == b["tag"]) & a["tag"].between(low, high), _fields(a["tag"], got))
    return out.otherwise(F.raise_error(F.concat(F.lit(f"no {name} of "), type_name(a), F.lit(" and "), type_name(b))).cast(TAGGED))


def add(a: Column, b: Column) -> Column:
    """``a + b``, row by row of the type that both have; anything but two numbers of one type fails the query."""
    return _arithmetic(a, b, "sum", lambda x, y, t: values.exact("+", x, y, t))


def subtract(a: Column, b: Column) -> Column:
    """``a - b``, as :func:`add`."""
    return _arithmetic(a, b, "difference", lambda x, y, t: values.exact("-", x, y, t))


def multiply(a: Column, b: Column) -> Column:
    """``a * b``, as :func:`add`."""
    return _arithmetic(a, b, "product", lambda x, y, t: values.exact("*", x, y, t))


def divide(a: Column, b: Column) -> Column:
    """``a / b``, as :func:`add`; integers truncate toward zero."""
    return _arithmetic(a, b, "quotient", values.quotient)


def order(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null where a NaN makes the two unordered. Different types compare by their tags; empty values are equal."""
    out = F.when(_apart(a["tag"].isNull() | b["tag"].isNull()), F.lit(None).cast("int")).when(a["tag"] < b["tag"], -1).when(a["tag"] > b["tag"], 1).when(a["tag"] == 0, 0)
    for kind, t in FIELDS.items():
        x, y = a[f"as_{kind}"], b[f"as_{kind}"]
        sign = F.when(x < y, -1).when(x > y, 1).when(x == y, 0)
        if isinstance(t, values.FLOATS):
            sign = F.when(~(F.isnan(x) | F.isnan(y)), sign)
        out = out.when(a["tag"] == TAGS.index(kind), sign)
    return out


def equal(a: Column, b: Column) -> Column:
    """Whether both have one type and value; NaN equals nothing."""
    return F.when(a["tag"].isNotNull() & b["tag"].isNotNull(), F.coalesce(order(a, b) == 0, F.lit(False)))


def extract(value: Column, kind: str) -> Column:
    """The value as a plain column, if it has exactly that type; any other type fails the query. Empty values come out as null."""
    kind = _kind(kind)
    t = T.NullType() if kind == "empty" else FIELDS[kind]
    have = F.lit(None) if kind == "empty" else value[f"as_{kind}"]
    wrong = F.raise_error(F.concat(F.lit(f"not a {kind}: "), type_name(value)))
    wrong = wrong.cast(t) if kind != "empty" else wrong.cast("string")
    have = have if kind != "empty" else have.cast("string")
    return F.when(value["tag"].isNull() | (value["tag"] == TAGS.index(kind)), have).otherwise(wrong)


def judge(value: Column | str, constraint: str, kind: str) -> Column:
    """Whether a value has the type and meets the constraint, an SQL condition on ``x`` such as ``x > 3 and x < 9``; NaN and unknown are no.

    ``value`` is a column's name. ``x`` stands for the value itself, typed; other columns of the row may be named too.
    """
    kind = _kind(kind)
    if kind == "empty":
        raise ValueError("empty values meet no constraint")
    name = ".".join(f"`{p}`" for p in value.split(".")) if isinstance(value, str) else None
    if name is None:
        raise TypeError("a constraint needs the name of a column")
    met = F.expr(f"exists(array({name}.as_{kind}), x -> ({constraint}))")
    return F.col(value)["tag"].isNotNull() & (F.col(value)["tag"] == TAGS.index(kind)) & F.coalesce(met, F.lit(False))
