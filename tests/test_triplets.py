"""Triplets, and predicates and maps over one to three rows."""

import pytest
from pyspark.sql import functions as F

from spindle.operators.graph import Graph
from spindle.operators.placed import place
from spindle.operators.triplets import Operations, triplets

EDGES = [(0, 1, 0.5), (1, 1, 1.5), (1, 2, None), (2, 9, 2.5), (0, 1, 0.5)]
VERTICES = [(0, "a", 10), (1, "b", 20), (2, None, 30)]


def made(spark, limit=1 << 20, data=True):
    e = spark.createDataFrame(EDGES, "src long, dst long, w double")
    e = e.select("src", "dst", F.struct("w").alias("data")) if data else e.select("src", "dst")
    return triplets(e, spark.createDataFrame(VERTICES, "id long, name string, x int"), limit)


def want():
    v = {i: (i, n, x) for i, n, x in VERTICES}
    return sorted(((v.get(a, (a, None, None)), w, v.get(b, (b, None, None))) for a, b, w in EDGES), key=repr)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_triplets(spark, limit):
    got = sorted(((tuple(r.src), r.edge.w, tuple(r.dst)) for r in made(spark, limit).collect()), key=repr)
    assert got == want()
    assert made(spark, limit, data=False).where("edge.exists").count() == len(EDGES)


def test_no_vertices_no_fields_no_edges(spark):
    e = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert [tuple(map(tuple, r)) for r in triplets(e, spark.range(3)).collect()] == [((1,), (True,), (2,))]
    none = spark.createDataFrame([], "id long, name string")
    assert triplets(e, none).first().src.name is None and triplets(e.limit(0), none).collect() == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exchanges(spark):
    """Replicated vertices move no edge; dealt ones move edges once for each join, and placed links not even for the first."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange hashpartitioning" not in plan(made(spark, 1 << 20))
        assert plan(made(spark, 0)).count("Exchange hashpartitioning") == 4  # edges twice, vertices twice
        g = place(Graph(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")), 4)
        linked = g.with_sources()
        assert "Exchange" not in plan(linked)
        names = spark.createDataFrame(VERTICES, "id long, name string, x int").withColumnRenamed("id", "dst").hint("merge")
        assert plan(linked.join(names, "dst")).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_judges(spark):
    df = made(spark)
    ops = Operations.of(df)
    assert ops.judge("src.x >= 20", "src").where(df).count() == 3
    assert ops.judge("src.x < dst.x", "src", "dst").where(df).count() == 3
    assert ops.judge("edge.w * 10 < src.x and dst.name = 'b'", "src", "edge", "dst").where(df).count() == 3
    marked = ops.judge("edge.w > 1", "edge").mark(df, "met").collect()
    assert sorted(r.met for r in marked) == [False, False, False, True, True]  # unknown is no


@pytest.mark.parametrize("text,rows", [("src.nope > 1", ("src",)), ("dst.x > 1", ("src",)), ("src.x + 1", ("src",)), ("src.x >", ("src",)), ("sum(src.x) > 1", ("src",)), ("x > 1", ("src",)), ("true", ()), ("true", ("src", "src")), ("true", ("no",))])
def test_judges_are_checked(spark, text, rows):
    with pytest.raises(ValueError):
        Operations(spark, src="id long, x int", edge="w double", dst="id long, x int").judge(text, *rows)


def test_combines(spark):
    df = made(spark)
    ops = Operations.of(df)
    c = ops.combine(["src.x + dst.x AS total", "concat(src.name, '-', dst.name) AS names", "edge.w AS w"], "src", "edge", "dst")
    assert [(f.name, f.dataType.simpleString()) for f in c.schema] == [("total", "int"), ("names", "string"), ("w", "double")]
    assert sorted(map(tuple, c.select(df).collect()), key=repr)[:1] == [(30, "a-b", 0.5)] and c.add(df, "out").columns[-1] == "out"
    one = ops.combine("src.x * 2 AS twice", "src").add(df, "o")
    assert {r.o.twice for r in one.collect()} == {20, 40, 60}


@pytest.mark.parametrize("text", ["src.q AS q", "sum(src.x) AS s", "explode(array(src.x)) AS s", "row_number() OVER (ORDER BY src.x) AS r", "dst.x AS x", "src.x + AS y", ["src.x AS a", "src.id AS A"], []])
def test_combines_are_checked(spark, text):
    with pytest.raises(ValueError):
        Operations(spark, src="id long, x int", dst="id long, x int").combine(text, "src")
