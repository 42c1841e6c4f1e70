"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.functions import tagged, values
from spindle.operators import aggregate, partition
from spindle.operators.graph import Graph, graph_info, symmetrise
from spindle.operators.pagerank import first_ranks, pagerank
from spindle.operators.placed import place
from spindle.operators.traversal import Traversal
from spindle.operators.triplets import Operations, triplets
from spindle.session import register, shared_dir
from spindle.sources.edges import BatchPayload, ReadOptions, edges_from, load_edges, read_edges, read_vertices, write_edges

Query = Callable[[SparkSession, str], DataFrame]
PARTS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def part_supplier(spark: SparkSession, sf_dir: str, *payload: str) -> DataFrame:
    """Part and supplier of each line item; supplier ids follow the part ids."""
    first = table(spark, sf_dir, "part").agg(F.max("p_partkey") + 1).first()[0]
    return edges_from(table(spark, sf_dir, "lineitem"), "l_partkey", F.col("l_suppkey") + first, *payload)


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and part of each line item; part ids follow the order ids, and some orders have no line items."""
    first = table(spark, sf_dir, "orders").agg(F.max("o_orderkey") + 1).first()[0]
    return edges_from(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_partkey") + first)


def shared_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and supplier in one id space: overlapping ids and self-loops."""
    return edges_from(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


def _read_edges(spark: SparkSession, d: str) -> DataFrame:
    return part_supplier(spark, d)


def _edges_payload(spark: SparkSession, d: str) -> DataFrame:
    e = part_supplier(spark, d, "l_linenumber", "l_quantity")
    return e.select("src", "dst", F.col("data.l_linenumber").alias("l_linenumber"), F.col("data.l_quantity").alias("l_quantity"))


def _written(spark: SparkSession, d: str) -> str:
    """The part-supplier edges with two payload columns as CSV files without a header line."""
    path = f"{shared_dir(spark).rstrip('/')}/spindle-edges-{uuid.uuid4().hex}"
    register(path)
    write_edges(part_supplier(spark, d, "l_linenumber", "l_quantity"), path)
    return path


HEADER = "from:uint,to:uint,l_linenumber:int,l_quantity:double"


def _read_edges_csv(spark: SparkSession, d: str) -> DataFrame:
    return read_edges(spark, _written(spark, d), ReadOptions(has_header=False, header=HEADER))


def _read_edges_csv_payload(spark: SparkSession, d: str) -> DataFrame:
    e = read_edges(spark, _written(spark, d), ReadOptions(has_header=False, header=HEADER, include_columns=("l_quantity", "l_linenumber")))
    return e.select("src", "dst", F.col("data.l_linenumber").alias("l_linenumber"), F.col("data.l_quantity").alias("l_quantity"))


def _new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/spindle-{name}-{uuid.uuid4().hex}"
    register(path)
    return path


def _typed(edges: DataFrame) -> DataFrame:
    """Edges with two payload columns under the names that a typed header line has."""
    e = edges.select(F.col("src").alias("from:uint"), F.col("dst").alias("to:uint"), F.col("data.l_linenumber").alias("l_linenumber:int"), F.col("data.l_quantity").alias("l_quantity:double"))
    return e


#: Edges in one file of those that are written with a header line of their own: a gzip file is read by one task.
FILE_EDGES = 1_000_000


def _dealt(edges: DataFrame, least: int) -> DataFrame:
    """The edges in ``least`` partitions, or in more of about ``FILE_EDGES`` each: tasks and files do not grow with the table."""
    return edges.repartition(max(least, -(-edges.count() // FILE_EDGES)))


def _read_edges_folder(spark: SparkSession, d: str) -> DataFrame:
    """A folder of several CSV files, each with a header line of its own that names and types its columns."""
    path = _new_path(spark, "folder")
    _typed(_dealt(part_supplier(spark, d, "l_linenumber", "l_quantity"), 5)).write.option("header", "true").csv(path)
    e = read_edges(spark, path, ReadOptions(include_columns=("l_linenumber",)))
    return e.select("src", "dst", F.col("data.l_linenumber").alias("l_linenumber"))


def _read_edges_gzip(spark: SparkSession, d: str) -> DataFrame:
    path = _new_path(spark, "gzip")
    _typed(_dealt(part_supplier(spark, d, "l_linenumber", "l_quantity"), 3)).write.option("header", "true").option("compression", "gzip").csv(path)
    return read_edges(spark, path)


def three_fields(batch: pa.RecordBatch) -> pa.StructArray:
    """A payload hook: an integer, a float and a string made of an Arrow batch of two columns."""
    n, q = batch.column(0), batch.column(1)
    text = pc.binary_join_element_wise(pc.cast(n, pa.string()), pc.cast(pc.cast(q, pa.int64()), pa.string()), "/")
    return pa.StructArray.from_arrays([n, pc.cast(q, pa.float32()), text], ["i32_data", "f32_data", "str_data"])


def _read_edges_payload3(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of three fields that user code makes of Arrow batches inside the reader."""
    payload = BatchPayload("i32_data int, f32_data float, str_data string", three_fields)
    e = read_edges(spark, _written(spark, d), ReadOptions(has_header=False, header=HEADER, include_columns=("l_linenumber", "l_quantity")), payload)
    return e.select("src", "dst", F.col("data.i32_data").alias("i32_data"), F.col("data.f32_data").cast("double").alias("f32_data"), F.col("data.str_data").alias("str_data"))


def _load_edges_parquet(spark: SparkSession, d: str) -> DataFrame:
    """Edges in a format other than CSV, told by the path's ending."""
    path = f"{_new_path(spark, 'edges')}.parquet"
    register(path)
    part_supplier(spark, d, "l_quantity").select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("data.l_quantity").alias("l_quantity")).write.parquet(path)
    e = load_edges(spark, path, ReadOptions(include_columns=("l_quantity",)))
    return e.select("src", "dst", F.col("data.l_quantity").alias("l_quantity"))


def _read_vertices_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _new_path(spark, "vertices")
    p = table(spark, d, "part")
    p.select(F.col("p_partkey").alias("id:uint"), F.col("p_name").alias("name:string"), F.col("p_size").cast("int").alias("size:int")).write.option("header", "true").option("escape", '"').csv(path)
    v = read_vertices(spark, path, ReadOptions(include_columns=("size", "name")))
    return v.select("id", F.col("data.size").alias("size"), F.col("data.name").alias("name"))


def _hash_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The partition of every vertex by the hash of its id."""
    return Graph(shared_ids(spark, d), PARTS, hashed=True).partitioned_vertices()


def _all_to_all(spark: SparkSession, d: str) -> DataFrame:
    """Each row's partition after the exchange, counted: it is the one that it was sent to."""
    g = Graph(shared_ids(spark, d), PARTS)
    sent = aggregate.all_to_all(partition.edge_partition(g.edges, g.partitioner), "part", PARTS).withColumn("at", F.spark_partition_id())
    return sent.groupBy("part", "at").agg(F.count(F.lit(1)).alias("n"))


def _value_types(spark: SparkSession, d: str) -> DataFrame:
    """The type names of a column: each line item names one, by its number and part, and has the type looked up."""
    names = F.array(*[F.lit(n) for n in values.VALUE_TYPES])
    at = (F.col("l_partkey") + F.col("l_linenumber")) % len(values.VALUE_TYPES)
    x = table(spark, d, "lineitem").select(F.element_at(names, at.cast("int") + 1).alias("name"))
    kind = F.element_at(F.array(*[F.lit(t) for t in values.TYPE_ORDER]), tagged.tag_of(F.col("name")).cast("int") + 1)
    return x.groupBy("name", kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def _mixed(number: str) -> tuple[Column, Column]:
    """Texts that mix types row by row, longs, ints, doubles, NaN and strings, and the type name of each."""
    at = F.col(number) % 5
    text = F.when(at == 0, F.col("l_partkey").cast("string")).when(at == 1, F.col("l_linenumber").cast("string")).when(at == 2, F.col("l_quantity").cast("string")).when(at == 3, F.lit("NaN")).otherwise(F.col("l_returnflag"))
    return text, F.when(at == 0, "long").when(at == 1, "int32").when(at < 4, "double").otherwise("string")


def _parsed(x: DataFrame, a: tuple[Column, Column], b: tuple[Column, Column]) -> DataFrame:
    """Two tagged columns of texts and type names, which have a ``select`` of their own, so that they are made once."""
    texts = x.select("l_orderkey", "l_linenumber", "l_suppkey", a[0].alias("a"), a[1].alias("a_name"), b[0].alias("b"), b[1].alias("b_name"))
    return texts.select("l_orderkey", "l_linenumber", "l_suppkey", *[tagged.parse(F.col(c), F.col(f"{c}_name")).alias(c) for c in "ab"])


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(table(spark, d, "lineitem"), _mixed("l_linenumber"), _mixed("l_suppkey"))


def _tagged_compare(spark: SparkSession, d: str) -> DataFrame:
    """Order and equality of values whose types differ from row to row, and from each other."""
    a, b = F.col("a"), F.col("b")
    return _tagged(spark, d).select("l_orderkey", "l_linenumber", tagged.type_name(a).alias("a_type"), tagged.order(a, b).alias("sign"), tagged.equal(a, b).alias("same"))


def _tagged_arith(spark: SparkSession, d: str) -> DataFrame:
    """Arithmetic that is of ints in some rows, of longs or doubles in others; its results keep the rows' types."""
    at = F.col("l_linenumber") % 3

    def number(whole: str, real: str) -> tuple[Column, Column]:
        text = F.when(at == 2, F.col(real).cast("string")).otherwise(F.col(whole).cast("string"))
        return text, F.when(at == 0, "int").when(at == 1, "long").otherwise("double")

    x = _parsed(table(spark, d, "lineitem"), number("l_partkey", "l_extendedprice"), number("l_linenumber", "l_quantity"))
    ops = {"plus": tagged.add, "minus": tagged.subtract, "times": tagged.multiply, "quotient": tagged.divide}
    got = x.select("l_orderkey", "l_linenumber", *[f(F.col("a"), F.col("b")).alias(n) for n, f in ops.items()])
    return got.select("l_orderkey", "l_linenumber", *[F.col(n)[f"as_{k}"].alias(f"{n}_{k}") for n in ops for k in ("int", "long", "double")])


def _tagged_extract(spark: SparkSession, d: str) -> DataFrame:
    """Each type's values taken out of the mixed column where they are, as plain columns."""
    x = _tagged(spark, d)
    of = lambda k: tagged.extract(F.when(tagged.type_name(F.col("a")) == k, F.col("a")), k)
    return x.select("l_orderkey", "l_linenumber", of("long").alias("as_long"), of("int").alias("as_int"), F.when(~F.isnan(of("double")), of("double")).alias("as_double"), F.isnan(of("double")).alias("is_nan"), of("string").alias("as_string"))


def _tagged_judge(spark: SparkSession, d: str) -> DataFrame:
    """Which values of the mixed column are of a type and meet a constraint on it."""
    x = _tagged(spark, d)
    return x.select("l_orderkey", "l_linenumber", tagged.judge("a", "x > 100 and x % 2 = 0", "long").alias("even_long"), tagged.judge("a", "x between 10 and 30", "double").alias("middling"), tagged.judge("a", "x in ('A', 'R')", "string").alias("flagged"))


def _part_supplier_triplets(spark: SparkSession, d: str, limit: int) -> DataFrame:
    """Part, line item and supplier as source, edge and target."""
    first = table(spark, d, "part").agg(F.max("p_partkey") + 1).first()[0]
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("size"), F.col("p_retailprice").alias("price"), F.lit(None).cast("double").alias("balance"))
    suppliers = table(spark, d, "supplier").select((F.col("s_suppkey") + first).alias("id"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("double").alias("price"), F.col("s_acctbal").alias("balance"))
    return triplets(part_supplier(spark, d, "l_orderkey", "l_linenumber", "l_quantity"), parts.unionByName(suppliers), limit)


def _triplets_judge(spark: SparkSession, d: str) -> DataFrame:
    """Predicates over one, two and three rows of part, line item and supplier."""
    t = _part_supplier_triplets(spark, d, aggregate.REPLICATE_BYTES)
    ops = Operations.of(t)
    t = ops.judge("edge.l_quantity > 10", "edge").where(t)
    t = ops.judge("src.size < 25 or dst.balance > 0", "src", "dst").where(t)
    t = ops.judge("edge.l_quantity * src.price > dst.balance + 1000", "src", "edge", "dst").mark(t, "worth")
    return t.select("edge.l_orderkey", "edge.l_linenumber", "src.id", "worth")


def _triplets_combine(spark: SparkSession, d: str) -> DataFrame:
    """Maps of two and three rows to one, with the vertices dealt out rather than replicated."""
    t = _part_supplier_triplets(spark, d, 0)
    ops = Operations.of(t)
    t = ops.combine("edge.l_quantity + src.size AS total", "src", "edge").add(t, "two")
    three = ["src.id * 1000 + dst.id AS pair", "round(edge.l_quantity * src.price - dst.balance, 4) AS margin"]
    t = ops.combine(three, "src", "edge", "dst").add(t, "three")
    return t.select("edge.l_orderkey", "edge.l_linenumber", "two.total", "three.pair", "three.margin")


def _adjacency_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Rows of at most 16 neighbours each, with what stands before them."""
    b = Graph(shared_ids(spark, d)).blocks(16)
    return b.select("id", "block", "start", F.array_join(F.transform("nbrs", lambda x: x["to"].cast("string")), ",").alias("nbrs"))


def _placed_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of a graph written in buckets, counted where its links lie, beside those written with the vertices."""
    g = place(Graph(order_part(spark, d)))
    return g.counted().join(g.vertices().hint("merge"), ["id", "piece"]).select("id", "n", "deg")


def _placed_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of a graph written in buckets, joined with their sources' degrees where they lie; small pieces, so most vertices have several."""
    g = place(Graph(shared_ids(spark, d)), piece_links=50)
    return g.with_sources().groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("dst").alias("dsts"), F.max("deg").alias("deg"))


def _placed_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of a graph written in buckets, over its links as they lie; small pieces, so most vertices have several."""
    g = place(Graph(part_supplier(spark, d)), piece_links=50)
    return pagerank(g, replicate_bytes=0).select("id", F.round("pr", 6).alias("pr"))


def _tree_reduce(spark: SparkSession, d: str) -> DataFrame:
    """All orders' steps x -> m x + c modulo a prime, composed in the order of their keys: associative, but not commutative."""
    x = table(spark, d, "orders").select((F.col("o_orderkey") * 3 - 1000).alias("rank"), F.struct((F.col("o_custkey") % 1008 + 1).alias("m"), (F.col("o_orderkey") % 1009).alias("c")).alias("step"))
    then = lambda a, b: F.struct((a["m"] * b["m"] % 1009).alias("m"), ((a["c"] * b["m"] + b["c"]) % 1009).alias("c"))
    return aggregate.tree_reduce(x, "rank", "step", then, fan_in=64).select("value.m", "value.c")


def _all_gather(limit: int) -> Query:
    """Every edge with its target's degree, that vector replicated or dealt out as its size says."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        g = Graph(part_supplier(spark, d))
        met = aggregate.all_gather(g.edges, g.degrees(), "dst", limit=limit)
        return met.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("deg").alias("degs"))

    return run


CHUNK_ROWS = 100


def light(chunk: pa.Table) -> bool:
    """Whether to go on: a chunk's orders, weighted by their customers, are not above a bound."""
    return pc.sum(pc.multiply(pc.cast(chunk.column("o_totalprice"), pa.int64(), safe=False), pc.bit_wise_and(chunk.column("o_custkey"), 3))).as_py() <= 45_000_000


def _first_chunk(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the first chunk of orders, in the order of their keys, at which a traversal stops; chunks of later waves are not read."""
    t = Traversal.over(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], CHUNK_ROWS)
    at = t.run(light)
    return t.chunk_range(at, at + 1) if at is not None else t.chunk_range(t.chunks, t.chunks + 1)


def _scalar_extract(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    return x.select(values.extract(x, "l_orderkey", "long").alias("k"), values.extract(x, "l_linenumber", "int").alias("n"), values.extract(x, "l_quantity", "double").alias("q"))


def _scalar_compare_nan(spark: SparkSession, d: str) -> DataFrame:
    """Doubles, some of them NaN, and values of different types."""
    nan = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", nan.alias("a"), (F.col("l_linenumber") * 10.0).alias("b"), F.col("l_partkey").alias("c"))
    return x.select("l_orderkey", "l_linenumber", values.order(x, "a", "b").alias("sign"), values.equal(x, "a", "a").alias("same"), values.order(x, "c", "a").alias("mixed"), values.equal(x, "c", "a").alias("mixed_same"))


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    return Graph(shared_ids(spark, d)).neighbours(7).select(F.col("to").alias("nbr"))


def _adjacency(spark: SparkSession, d: str) -> DataFrame:
    a = Graph(shared_ids(spark, d)).adjacency()
    return a.select("id", F.array_join(F.transform("nbrs", lambda x: x["to"].cast("string")), ",").alias("nbrs"), F.size("nbrs").cast("long").alias("n_nbrs"))


def _partition_vertices(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(shared_ids(spark, d))
    return partition.partition_vertices(g.vertices(), partition.range_partitioner(g.vertex_num, PARTS))


def _partition_bounds(spark: SparkSession, d: str) -> DataFrame:
    return partition.partition_bounds(spark, Graph(shared_ids(spark, d)).vertex_num, PARTS)


def _partition_edges(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(shared_ids(spark, d))
    return partition.partition_edges(g.edges, partition.range_partitioner(g.vertex_num, PARTS))


def _edge_partition(spark: SparkSession, d: str) -> DataFrame:
    g = Graph(shared_ids(spark, d))
    return partition.edge_partition(g.edges, partition.range_partitioner(g.vertex_num, PARTS))


def _reduce(spark: SparkSession, d: str) -> DataFrame:
    """The subtraction of per-part-range sums in rank order: a fold that isn't commutative."""
    g = Graph(shared_ids(spark, d))
    by = partition.edge_partition(g.edges, partition.range_partitioner(g.vertex_num, PARTS)).groupBy("part").agg(F.sum("dst").alias("v"))
    return aggregate.all_reduce(by, "part", "v", lambda a, b: a - b)


def _pagerank(spark: SparkSession, d: str) -> DataFrame:
    return pagerank(Graph(part_supplier(spark, d))).select("id", F.round("pr", 6).alias("pr"))


def _pagerank_isolated(spark: SparkSession, d: str) -> DataFrame:
    return pagerank(Graph(order_part(spark, d))).select("id", F.round("pr", 6).alias("pr"))


def _pagerank_first10(spark: SparkSession, d: str) -> DataFrame:
    """Ranks dealt out like the links that they meet, as those of large graphs are."""
    return first_ranks(pagerank(Graph(shared_ids(spark, d)), replicate_bytes=0)).select("id", F.round("pr", 6).alias("pr"))


def _numbers(spark: SparkSession, d: str, kind: str) -> DataFrame:
    a, b = ("l_partkey", "l_linenumber") if kind in ("int", "bigint") else ("l_extendedprice", "l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b"))


def _arith(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        x = _numbers(spark, d, kind)
        ops = (("plus", values.add), ("minus", values.subtract), ("times", values.multiply), ("quotient", values.divide))
        return x.select("l_orderkey", "l_linenumber", *[f(x, "a", "b").cast("double" if kind == "float" else kind).alias(name) for name, f in ops])

    return run


def _scalar_compare(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return x.select("l_orderkey", "l_linenumber", values.order(x, "a", "b").alias("sign"), values.equal(x, "a", "b").alias("same"))


def _scalar_parse(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("k"), F.col("l_quantity").cast("string").alias("q"))
    return x.select(values.parse(F.col("k"), "long").alias("k"), values.parse(F.col("q"), "double").alias("q"))


QUERIES: dict[str, Query] = {
    "pagerank": _pagerank,
    "pagerank_first10": _pagerank_first10,
    "pagerank_isolated": _pagerank_isolated,
    "read_edges": _read_edges,
    "edges_payload": _edges_payload,
    "read_edges_csv": _read_edges_csv,
    "read_edges_csv_payload": _read_edges_csv_payload,
    "hash_partitions": _hash_partitions,
    "graph_partitions": lambda s, d: Graph(order_part(s, d), PARTS).partitioned_vertices(),
    "all_to_all": _all_to_all,
    "value_types": _value_types,
    "scalar_extract": _scalar_extract,
    "scalar_compare_nan": _scalar_compare_nan,
    "graph_info": lambda s, d: graph_info(part_supplier(s, d)),
    "symmetrise": lambda s, d: symmetrise(shared_ids(s, d)),
    "degrees": lambda s, d: Graph(order_part(s, d)).degrees(),
    "adjacency": _adjacency,
    "neighbours": _neighbours,
    "vertices": lambda s, d: Graph(order_part(s, d)).vertices(),
    "init_array": lambda s, d: Graph(shared_ids(s, d)).array(1.5),
    "partition_vertices": _partition_vertices,
    "partition_bounds": _partition_bounds,
    "partition_edges": _partition_edges,
    "edge_partition": _edge_partition,
    "global_max": lambda s, d: aggregate.global_max(shared_ids(s, d), "src"),
    "global_sum": lambda s, d: aggregate.global_sum(shared_ids(s, d), "dst"),
    "all_reduce": _reduce,
    "scalar_arith_int": _arith("int"),
    "scalar_arith_long": _arith("bigint"),
    "scalar_arith_float": _arith("float"),
    "scalar_arith_double": _arith("double"),
    "scalar_compare": _scalar_compare,
    "scalar_parse": _scalar_parse,
    "read_edges_folder": _read_edges_folder,
    "read_edges_gzip": _read_edges_gzip,
    "read_edges_payload3": _read_edges_payload3,
    "load_edges_parquet": _load_edges_parquet,
    "read_vertices_csv": _read_vertices_csv,
    "tagged_compare": _tagged_compare,
    "tagged_arith": _tagged_arith,
    "tagged_extract": _tagged_extract,
    "tagged_judge": _tagged_judge,
    "triplets_judge": _triplets_judge,
    "triplets_combine": _triplets_combine,
    "adjacency_blocks": _adjacency_blocks,
    "placed_degrees": _placed_degrees,
    "placed_links": _placed_links,
    "placed_pagerank": _placed_pagerank,
    "tree_reduce": _tree_reduce,
    "all_gather": _all_gather(aggregate.REPLICATE_BYTES),
    "all_gather_dealt": _all_gather(0),
    "first_chunk": _first_chunk,
}

PS = "SELECT l_partkey AS src, l_suppkey + (SELECT max(p_partkey) + 1 FROM part) AS dst FROM lineitem"
OP = "SELECT l_orderkey AS src, l_partkey + (SELECT max(o_orderkey) + 1 FROM orders) AS dst FROM lineitem"
SELF = "SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem"
N = "(SELECT max(greatest(src, dst)) + 1 FROM e)"
SYM = "SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e"


def pagerank_sql(edges: str, iterations: int, tail: str = "") -> str:
    """The rounds written out, each a materialised table."""
    rounds = ", ".join(
        f"r{k} AS MATERIALIZED (SELECT v.id, 0.15 + 0.85 * coalesce(x.got, 0) AS pr FROM v LEFT JOIN "
        f"(SELECT w.dst AS id, sum(r.pr * w.share) AS got FROM w JOIN r{k - 1} r ON r.id = w.src GROUP BY 1) x ON x.id = v.id)"
        for k in range(1, iterations + 1)
    )
    return (
        f"WITH e AS MATERIALIZED ({edges}), s AS MATERIALIZED ({SYM}), v AS MATERIALIZED (SELECT range AS id FROM range({N})), "
        "g AS MATERIALIZED (SELECT src, count(*) AS deg FROM s GROUP BY 1), "
        "w AS MATERIALIZED (SELECT s.src, s.dst, count(*) / any_value(g.deg)::DOUBLE AS share FROM s JOIN g ON g.src = s.src GROUP BY 1, 2), "
        f"r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS pr FROM v), {rounds} "
        f"SELECT id::BIGINT AS id, round(pr, 6) AS pr FROM r{iterations} {tail}"
    )


def _arith_sql(kind: str) -> str:
    whole = kind in ("INTEGER", "BIGINT")
    a, b = ("l_partkey", "l_linenumber") if whole else ("l_extendedprice", "l_quantity")
    wrap = (lambda x: f"CAST({x} AS {kind})") if whole else (lambda x: f"CAST({x} AS DOUBLE)")
    cols = ", ".join(f"{wrap(f'a {op} b')} AS {name}" for name, op in (("plus", "+"), ("minus", "-"), ("times", "*"), ("quotient", "//" if whole else "/")))
    return f"SELECT l_orderkey, l_linenumber, {cols} FROM (SELECT l_orderkey, l_linenumber, CAST({a} AS {kind}) AS a, CAST({b} AS {kind}) AS b FROM lineitem)"


OWNER = f"CAST(least({{}} // ({N} // {PARTS} + 1), {PARTS - 1}) AS INTEGER)"

def _mixed_sql(number: str, name: str) -> str:
    at = f"{number} % 5"
    tag = f"CASE {at} WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 4 THEN 6 ELSE 5 END AS {name}_tag"
    value = f"CASE {at} WHEN 0 THEN l_partkey WHEN 1 THEN l_linenumber WHEN 2 THEN l_quantity END AS {name}_value"
    return f"{tag}, {value}, {at} = 3 AS {name}_nan"


TAGGED_SQL = f"SELECT l_orderkey, l_linenumber, l_returnflag, {_mixed_sql('l_linenumber', 'a')}, {_mixed_sql('l_suppkey', 'b')} FROM lineitem"
SIGN = "CAST(CASE WHEN a_tag < b_tag THEN -1 WHEN a_tag > b_tag THEN 1 WHEN a_tag = 6 THEN 0 WHEN a_nan OR b_nan THEN NULL ELSE sign(a_value - b_value) END AS INTEGER)"
GATHER_SQL = f"WITH e AS ({PS}), s AS ({SYM}), g AS (SELECT src AS id, count(*) AS deg FROM s GROUP BY 1) SELECT src, count(*) AS n, sum(deg)::BIGINT AS degs FROM e JOIN g ON id = dst GROUP BY 1"


def _tagged_arith_sql() -> str:
    cols = []
    for name, op in (("plus", "+"), ("minus", "-"), ("times", "*"), ("quotient", "/")):
        for at, (kind, sql) in enumerate((("int", "INTEGER"), ("long", "BIGINT"), ("double", "DOUBLE"))):
            a, b = ("l_extendedprice", "l_quantity") if kind == "double" else ("l_partkey", "l_linenumber")
            real = op if kind == "double" or op != "/" else "//"
            cols.append(f"CASE WHEN l_linenumber % 3 = {at} THEN CAST({a} {real} {b} AS {sql}) END AS {name}_{kind}")
    return f"SELECT l_orderkey, l_linenumber, {', '.join(cols)} FROM lineitem"


ORACLES: dict[str, str] = {
    "pagerank": pagerank_sql(PS, 100),
    "pagerank_first10": pagerank_sql(SELF, 100, "WHERE id < 10"),
    "pagerank_isolated": pagerank_sql(OP, 100),
    "read_edges": PS,
    "edges_payload": PS.replace(" AS dst FROM", " AS dst, l_linenumber, l_quantity FROM"),
    "read_edges_csv": PS,
    "read_edges_csv_payload": PS.replace(" AS dst FROM", " AS dst, l_linenumber, l_quantity FROM"),
    "hash_partitions": f"WITH e AS ({SELF}) SELECT range AS id, CAST((((range * {partition.SPREAD}) & 4294967295) * {PARTS}) >> 32 AS INTEGER) AS part FROM range({N})",
    "graph_partitions": f"WITH e AS ({OP}) SELECT range AS id, {OWNER.format('range')} AS part FROM range({N})",
    "all_to_all": f"WITH e AS ({SELF}), o AS (SELECT {OWNER.format('src')} AS part FROM e) SELECT part, part AS at, count(*) AS n FROM o GROUP BY 1, 2",
    "value_types": "WITH t(nth, name, type) AS (VALUES "
    + ", ".join(f"({k}, '{n}', '{t}')" for k, (n, t) in enumerate((("empty", "void"), ("bool", "boolean"), ("int", "int"), ("int32", "int"), ("long", "bigint"), ("int64", "bigint"), ("long long", "bigint"), ("float", "float"), ("float32", "float"), ("double", "double"), ("float64", "double"), ("string", "string"))))
    + ") SELECT name, type, count(*) AS n FROM lineitem JOIN t ON nth = (l_partkey + l_linenumber) % 12 GROUP BY 1, 2",
    "scalar_extract": "SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q FROM lineitem",
    "scalar_compare_nan": "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber = 1 THEN NULL WHEN l_quantity < l_linenumber * 10 THEN -1 WHEN l_quantity > l_linenumber * 10 THEN 1 ELSE 0 END AS INTEGER) AS sign, l_linenumber <> 1 AS same, -1 AS mixed, false AS mixed_same FROM lineitem",
    "graph_info": f"WITH e AS ({PS}) SELECT max(greatest(src, dst)) + 1 AS vertex_num, count(*) AS edge_num FROM e",
    "symmetrise": f"WITH e AS ({SELF}) {SYM}",
    "degrees": f"WITH e AS ({OP}), s AS ({SYM}), g AS (SELECT src, count(*) AS n FROM s GROUP BY 1) SELECT range AS id, coalesce(n, 0) AS deg FROM range({N}) LEFT JOIN g ON src = range",
    "adjacency": f"WITH e AS ({SELF}), s AS ({SYM}), g AS (SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS nbrs, count(*) AS n FROM s GROUP BY 1) SELECT range AS id, coalesce(nbrs, '') AS nbrs, coalesce(n, 0) AS n_nbrs FROM range({N}) LEFT JOIN g ON src = range",
    "neighbours": f"WITH e AS ({SELF}), s AS ({SYM}) SELECT dst AS nbr FROM s WHERE src = 7",
    "vertices": f"WITH e AS ({OP}) SELECT range AS id FROM range({N})",
    "init_array": f"WITH e AS ({SELF}) SELECT range AS id, 1.5::DOUBLE AS value FROM range({N})",
    "partition_vertices": f"WITH e AS ({SELF}) SELECT range AS id, {OWNER.format('range')} AS part FROM range({N})",
    "partition_bounds": f"WITH e AS ({SELF}), c AS (SELECT {N} AS n, {N} // {PARTS} + 1 AS chunk) SELECT range::INTEGER AS part, least(range * chunk, n) AS start_id, CASE WHEN range = {PARTS - 1} THEN n ELSE least((range + 1) * chunk, n) END AS end_id FROM c, range({PARTS})",
    "partition_edges": f"WITH e AS ({SELF}), o AS (SELECT src, dst, {OWNER.format('src')} AS p, {OWNER.format('dst')} AS q FROM e) SELECT src, dst, p AS part FROM o UNION ALL SELECT src, dst, q FROM o WHERE p <> q",
    "edge_partition": f"WITH e AS ({SELF}) SELECT src, dst, {OWNER.format('src')} AS part FROM e",
    "global_max": f"WITH e AS ({SELF}) SELECT coalesce(max(src), 0) AS value FROM e",
    "global_sum": f"WITH e AS ({SELF}) SELECT CAST(coalesce(sum(dst), 0) AS BIGINT) AS value FROM e",
    "all_reduce": f"WITH e AS ({SELF}), p AS (SELECT {OWNER.format('src')} AS part, sum(dst) AS v FROM e GROUP BY 1) SELECT CAST(2 * max_by(v, -part) - sum(v) AS BIGINT) AS value FROM p",
    "scalar_arith_int": _arith_sql("INTEGER"),
    "scalar_arith_long": _arith_sql("BIGINT"),
    "scalar_arith_float": _arith_sql("FLOAT"),
    "scalar_arith_double": _arith_sql("DOUBLE"),
    "scalar_compare": "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_partkey < l_suppkey THEN -1 WHEN l_partkey > l_suppkey THEN 1 ELSE 0 END AS INTEGER) AS sign, l_partkey = l_suppkey AS same FROM lineitem",
    "scalar_parse": "SELECT CAST(CAST(l_orderkey AS VARCHAR) AS BIGINT) AS k, CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE) AS q FROM lineitem",
    "read_edges_folder": PS.replace(" AS dst FROM", " AS dst, l_linenumber FROM"),
    "read_edges_gzip": PS,
    "read_edges_payload3": PS.replace(" AS dst FROM", " AS dst, l_linenumber AS i32_data, l_quantity::FLOAT::DOUBLE AS f32_data, l_linenumber || '/' || trunc(l_quantity)::BIGINT AS str_data FROM"),
    "load_edges_parquet": PS.replace(" AS dst FROM", " AS dst, l_quantity FROM"),
    "read_vertices_csv": "SELECT p_partkey AS id, p_size::INTEGER AS size, p_name AS name FROM part",
    "tagged_compare": f"WITH t AS ({TAGGED_SQL}) SELECT l_orderkey, l_linenumber, CASE a_tag WHEN 2 THEN 'int' WHEN 3 THEN 'long' WHEN 5 THEN 'double' ELSE 'string' END AS a_type, {SIGN} AS sign, coalesce({SIGN} = 0, false) AS same FROM t",
    "tagged_arith": _tagged_arith_sql(),
    "tagged_extract": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN l_partkey END AS as_long, CASE WHEN l_linenumber % 5 = 1 THEN l_linenumber END AS as_int, CASE WHEN l_linenumber % 5 = 2 THEN l_quantity END AS as_double, l_linenumber % 5 = 3 AS is_nan, CASE WHEN l_linenumber % 5 = 4 THEN l_returnflag END AS as_string FROM lineitem",
    "tagged_judge": "SELECT l_orderkey, l_linenumber, l_linenumber % 5 = 0 AND l_partkey > 100 AND l_partkey % 2 = 0 AS even_long, l_linenumber % 5 = 2 AND l_quantity BETWEEN 10 AND 30 AS middling, l_linenumber % 5 = 4 AND l_returnflag IN ('A', 'R') AS flagged FROM lineitem",
    "triplets_judge": "SELECT l_orderkey, l_linenumber, p_partkey AS id, l_quantity * p_retailprice > s_acctbal + 1000 AS worth FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 10 AND (p_size < 25 OR s_acctbal > 0)",
    "triplets_combine": "SELECT l_orderkey, l_linenumber, l_quantity + p_size AS total, p_partkey * 1000 + s_suppkey + (SELECT max(p_partkey) + 1 FROM part) AS pair, round(l_quantity * p_retailprice - s_acctbal, 4) AS margin FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey",
    "adjacency_blocks": f"WITH e AS ({SELF}), s AS ({SYM}), r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS nth FROM s) SELECT src AS id, (nth // 16)::BIGINT AS block, (nth // 16 * 16)::BIGINT AS start, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS nbrs FROM r GROUP BY 1, 2, 3",
    "placed_degrees": f"WITH e AS ({OP}), s AS ({SYM}), g AS (SELECT src, count(*) AS n FROM s GROUP BY 1) SELECT range AS id, coalesce(n, 0) AS n, coalesce(n, 0) AS deg FROM range({N}) LEFT JOIN g ON src = range",
    "placed_links": f"WITH e AS ({SELF}), s AS ({SYM}) SELECT src, count(*) AS n, sum(dst)::BIGINT AS dsts, count(*) AS deg FROM s GROUP BY 1",
    "placed_pagerank": pagerank_sql(PS, 100),
    "tree_reduce": "SELECT x.m AS m, x.c AS c FROM (SELECT list_reduce(list({'m': o_custkey % 1008 + 1, 'c': o_orderkey % 1009} ORDER BY o_orderkey), lambda a, b: {'m': a.m * b.m % 1009, 'c': (a.c * b.m + b.c) % 1009}) AS x FROM orders)",
    "all_gather": GATHER_SQL,
    "all_gather_dealt": GATHER_SQL,
    "first_chunk": f"WITH p AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders), c AS (SELECT *, position // {CHUNK_ROWS} AS chunk FROM p), w AS (SELECT chunk FROM c GROUP BY 1 HAVING sum(trunc(o_totalprice)::BIGINT * (o_custkey & 3)) > 45000000) SELECT * FROM c WHERE chunk = (SELECT min(chunk) FROM w)",
}
