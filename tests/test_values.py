"""Scalar operators: overflow, division, parsing and comparison."""

import math

import pytest

from spindle.functions import values as v


def one(spark, kind, a, b, f):
    df = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}")
    return df.select(f(df, "a", "b")).first()[0]


@pytest.mark.parametrize("kind", ["int", "long"])
def test_integers(spark, kind):
    assert [one(spark, kind, -7, 2, f) for f in (v.add, v.subtract, v.multiply, v.divide)] == [-5, -9, -14, -3]
    top = 2**31 - 1 if kind == "int" else 2**63 - 1
    for a, b, f in ((top, 1, v.add), (-top, 2, v.subtract), (top, top, v.multiply), (1, 0, v.divide), (-top - 1, -1, v.divide)):
        with pytest.raises(Exception):  # noqa: B017
            one(spark, kind, a, b, f)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_floats(spark, kind):
    assert one(spark, kind, 7.0, 2.0, v.divide) == 3.5
    assert one(spark, kind, 1.0, 0.0, v.divide) == math.inf and one(spark, kind, -1.0, 0.0, v.divide) == -math.inf
    assert one(spark, kind, 1.0, -0.0, v.divide) == -math.inf and math.isnan(one(spark, kind, 0.0, 0.0, v.divide))


def test_strict_types(spark):
    df = spark.createDataFrame([(1, 2, "x", True)], "a int, b long, s string, t boolean")
    for x, y in (("a", "b"), ("s", "s"), ("t", "t")):
        with pytest.raises(TypeError):
            v.add(df, x, y)
    with pytest.raises(TypeError):
        v.extract(df, "a", "long")
    assert df.select(v.extract(df, "b", "long")).first()[0] == 2
    assert df.select(v.order(df, "b", "a"), v.equal(df, "a", "b")).first()[:] == (1, False)
    with pytest.raises(ValueError):
        v.value_type("u32")


def test_nan_is_unordered(spark):
    assert one(spark, "double", math.nan, math.nan, v.order) is None and one(spark, "double", math.nan, math.nan, v.equal) is False
    assert one(spark, "double", 1.0, 2.0, v.order) == -1


@pytest.mark.parametrize("text,kind,want", [("12", "int", 12), ("true", "bool", True), ("3.5", "double", 3.5), ("x", "string", "x"), (None, "int", None)])
def test_parse(spark, text, kind, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(v.parse(df["t"], kind)).first()[0] == want


@pytest.mark.parametrize("text,kind", [("x", "int"), ("yes", "bool"), ("", "double")])
def test_parse_refuses(spark, text, kind):
    df = spark.createDataFrame([(text,)], "t string")
    with pytest.raises(Exception):  # noqa: B017
        df.select(v.parse(df["t"], kind)).first()
