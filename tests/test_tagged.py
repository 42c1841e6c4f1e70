"""Values whose types differ from row to row."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindle.functions import tagged as t

ROWS = [("3", "int"), ("-4", "int"), ("3", "long"), ("2.5", "double"), ("NaN", "double"), ("-Infinity", "double"), ("0.5", "float"), ("true", "bool"), ("abc", "string"), ("", "string"), ("", "empty"), (None, "int"), ("3", None)]
RANK = {k: n for n, k in enumerate(t.TAGS)}
PLAIN = {"int": int, "long": int, "float": float, "double": float, "string": str, "bool": lambda x: x == "true", "empty": lambda _: None}


def pairs(spark, rows=ROWS):
    a = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, x string, k string").select("n", t.parse(F.col("x"), F.col("k")).alias("v"))
    b = a.select(F.col("n").alias("m"), F.col("v").alias("w"))
    return a.crossJoin(b)


def sign(a, b):
    (x, j), (y, k) = a, b
    if x is None or y is None or j is None or k is None:
        return None
    if RANK[j] != RANK[k]:
        return -1 if RANK[j] < RANK[k] else 1
    x, y = PLAIN[j](x), PLAIN[k](y)
    if j == "empty":
        return 0
    return None if x != x or y != y else (x > y) - (x < y)


def test_order_and_equality(spark):
    got = pairs(spark).select("n", "m", t.order(F.col("v"), F.col("w")).alias("sign"), t.equal(F.col("v"), F.col("w")).alias("same")).collect()
    assert len(got) == len(ROWS) ** 2
    for r in got:
        want = sign(ROWS[r.n], ROWS[r.m])
        known = all(None not in ROWS[i] for i in (r.n, r.m))
        assert r.sign == want and r.same == ((want == 0) if known else None)


def test_names_and_extraction(spark):
    a = spark.createDataFrame(ROWS, "x string, k string").select("k", t.parse(F.col("x"), F.col("k")).alias("v"))
    assert [r[0] for r in a.select(t.type_name(F.col("v"))).collect()] == [k if x is not None else None for x, k in ROWS]
    ints = a.where("k = 'int'").select(t.extract(F.col("v"), "int32").alias("x"))
    assert [r.x for r in ints.collect()] == [3, -4, None] and ints.schema["x"].dataType.simpleString() == "int"
    with pytest.raises(Exception, match="not a int: long"):
        a.where("k = 'long'").select(t.extract(F.col("v"), "int")).collect()
    assert a.where("k = 'empty'").select(t.extract(F.col("v"), "empty")).first()[0] is None
    for x, k in (("x", "int"), ("1", "number"), ("yes", "bool")):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame([(x, k)], "x string, k string").select(t.parse(F.col("x"), F.col("k"))).collect()


NUMBERS = [r for r in ROWS if r[1] in t.NUMBERS and r[0] is not None]


@pytest.mark.parametrize("name,of", [("add", lambda a, b: a + b), ("subtract", lambda a, b: a - b), ("multiply", lambda a, b: a * b)])
def test_arithmetic_by_row(spark, name, of):
    both = pairs(spark, NUMBERS).where(F.col("v.tag") == F.col("w.tag"))
    for r in both.select("n", "m", getattr(t, name)(F.col("v"), F.col("w")).alias("out")).collect():
        (x, k), (y, _) = NUMBERS[r.n], NUMBERS[r.m]
        want = of(PLAIN[k](x), PLAIN[k](y))
        have = r.out[f"as_{k}"]
        assert t.TAGS[r.out.tag] == k and (have == want or (math.isnan(have) and math.isnan(want)))
        assert all(r.out[f"as_{o}"] is None for o in t.FIELDS if o != k)


def test_division(spark):
    rows = [("-7", "2", "int", -3.0), ("7", "-2", "long", -3.0), ("7", "2", "double", 3.5), ("1", "0", "double", math.inf), ("-1", "0", "float", -math.inf)]
    df = spark.createDataFrame(rows[:5], "x string, y string, k string, want double").select("k", "want", t.divide(t.parse(F.col("x"), F.col("k")), t.parse(F.col("y"), F.col("k"))).alias("q"))
    assert all(r.q[f"as_{r.k}"] == r.want for r in df.collect())


@pytest.mark.parametrize("a,b", [(("1", "int"), ("1", "long")), (("1", "int"), ("x", "string")), (("true", "bool"), ("true", "bool")), (("", "empty"), ("", "empty")), (("x", "string"), ("x", "string")), (("1.5", "float"), ("1.5", "double"))])
def test_mixed_arithmetic_fails(spark, a, b):
    df = spark.createDataFrame([(*a, *b)], "x string, k string, y string, l string").select(t.parse(F.col("x"), F.col("k")).alias("v"), t.parse(F.col("y"), F.col("l")).alias("w"))
    for f in (t.add, t.subtract, t.multiply, t.divide):
        with pytest.raises(Exception, match=f"of {a[1]} and {b[1]}"):
            df.select(f(F.col("v"), F.col("w"))).collect()


def test_overflow_and_null(spark):
    top = spark.createDataFrame([(str(2**31 - 1), "int"), (str(2**63 - 1), "long")], "x string, k string").select("k", t.parse(F.col("x"), F.col("k")).alias("v"))
    for k in ("int", "long"):
        with pytest.raises(Exception, match="overflow"):
            top.where(F.col("k") == k).select(t.add(F.col("v"), F.col("v"))).collect()
    none = spark.createDataFrame([(None, "int")], "x string, k string").select(t.parse(F.col("x"), F.col("k")).alias("v"))
    assert none.select(t.add(F.col("v"), t.tagged(F.lit(1), "int"))).first()[0] is None
    assert none.select(t.type_name(t.tagged(F.lit(None).cast("int"), "int"))).first()[0] == "empty"


def test_judge(spark):
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(ROWS)], "n int, x string, k string").select("n", t.parse(F.col("x"), F.col("k")).alias("v"))
    met = lambda c, k: {r.n for r in df.where(t.judge("v", c, k)).collect()}
    assert met("x > 0", "int") == {0} and met("x > 0", "long") == {2} and met("x < 3 or x = 'NaN'", "double") == {3, 4, 5}
    assert met("length(x) = 3", "string") == {8} and met("x", "bool") == {7}
    for bad in ("y_no > 1", "x +", "sum(x) > 1"):
        with pytest.raises(Exception):  # noqa: B017
            df.where(t.judge("v", bad, "int")).collect()
    with pytest.raises(ValueError):
        t.judge("v", "true", "empty")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.tuples(st.integers(-(2**31), 2**31 - 1).map(str), st.just("int")), st.tuples(st.floats(allow_nan=False, width=64).map(repr), st.just("double")), st.tuples(st.text("ab1", max_size=3), st.just("string"))), min_size=1, max_size=6))
def test_order_is_total_without_nan(spark, rows):
    for r in pairs(spark, rows).select("n", "m", t.order(F.col("v"), F.col("w")).alias("sign")).collect():
        assert r.sign == sign(rows[r.n], rows[r.m])
