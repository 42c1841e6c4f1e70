"""Headers and edge readers, with what they must refuse."""

import gzip

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from spindle.sources.edges import BatchPayload, ReadOptions, edges_from, load_edges, map_payload, read_edges, read_vertices, write_edges
from spindle.sources.schema import data_type, parse_header

HEADER = "from:uint,to:uint,i:int,f:f32,s:string"


def put(tmp_path, text, name="e.csv"):
    p = tmp_path / name
    (gzip.open(p, "wt") if name.endswith("gz") else open(p, "w")).write(text) if not name.endswith("gz") else p.write_bytes(gzip.compress(text.encode()))
    return str(p)


@pytest.mark.parametrize("token,want", [("", "void"), ("empty", "void"), ("int", "int"), ("i32", "int"), ("u32", "bigint"), ("long long", "bigint"), ("f32", "float"), ("float64", "double"), ("string", "string")])
def test_types(token, want):
    assert data_type(token).simpleString() == want


def test_bad_headers():
    for h in ("a:foo", "a", "from: uint", ""):
        with pytest.raises(ValueError):
            parse_header(h)


def test_read(spark, tmp_path):
    p = put(tmp_path, HEADER + '\n1,2,4,4.0,"4.00"\n2,3,5,5.0,"5.00"\n')
    want = [(1, 2, (4, 4.0, "4.00")), (2, 3, (5, 5.0, "5.00"))]
    o = ReadOptions(include_columns=("i", "f", "s"))
    assert [(r.src, r.dst, tuple(r.data)) for r in read_edges(spark, p, o).collect()] == want
    o = ReadOptions(include_columns=("s", "i"), header=HEADER)
    assert [tuple(r.data) for r in read_edges(spark, p, o).collect()] == [("4.00", 4), ("5.00", 5)]
    assert read_edges(spark, p).columns == ["src", "dst"]


def test_no_header_line_and_gzip(spark, tmp_path):
    p = put(tmp_path, "1,2\n3,4\n", "e.csv.gz")
    got = read_edges(spark, p, ReadOptions(has_header=False, header="to:u32,from:u32")).collect()
    assert [tuple(r) for r in got] == [(2, 1), (4, 3)]
    with pytest.raises(ValueError):
        read_edges(spark, p, ReadOptions(has_header=False))


@pytest.mark.parametrize("line", ["1,", ",1", "-1,2", "4294967296,2", "x,2", "1", "1,2,3"])
def test_bad_rows(spark, tmp_path, line):
    p = put(tmp_path, f"from:uint,to:uint\n1,2\n{line}\n")
    with pytest.raises(Exception):  # noqa: B017
        read_edges(spark, p).collect()


@pytest.mark.parametrize("header,cols", [("a:uint,to:uint", ()), ("from:int,to:uint", ()), ("from:uint,to:uint", ("x",))])
def test_bad_columns(spark, tmp_path, header, cols):
    with pytest.raises(ValueError):
        read_edges(spark, put(tmp_path, header + "\n1,2\n"), ReadOptions(include_columns=cols))


def test_vertices_other_names_and_write(spark, tmp_path):
    p = put(tmp_path, "id:u32,name:string\n3,c\n")
    assert [(r.id, r.data.name) for r in read_vertices(spark, p, ReadOptions(include_columns=("name",))).collect()] == [(3, "c")]
    p = put(tmp_path, "a:u32,b:u32\n3,4\n", "n.csv")
    assert read_edges(spark, p, ReadOptions(from_column="b", to_column="a")).first()[:] == (4, 3)
    e = edges_from(spark.createDataFrame([(1, 2, "q")], "a int, b int, t string"), "a", "b", "t")
    write_edges(e, str(tmp_path / "out"))
    back = read_edges(spark, str(tmp_path / "out"), ReadOptions(has_header=False, header="from:u32,to:u32,t:string", include_columns=("t",)))
    assert [(r.src, r.dst, r.data.t) for r in back.collect()] == [(1, 2, "q")]


@pytest.mark.parametrize("columns", [(), ("i",), ("t",), ("i", "t")])
@pytest.mark.parametrize("row", ["3,4", "3,4,7", "5,6,7,b,extra", "8,9,x,c", "8,9,,c", "8,,7,c", ",9,7,c"])
def test_bad_rows_fail_whatever_is_selected(spark, tmp_path, columns, row):
    path = tmp_path / "e.csv"
    path.write_text(f"from:uint,to:uint,i:int,t:string\n1,2,3,a\n{row}\n")
    edges = read_edges(spark, str(path), ReadOptions(include_columns=columns))
    with pytest.raises(Exception):  # noqa: B017
        edges.collect()
    with pytest.raises(Exception):  # noqa: B017
        edges.select("dst").collect()
    with pytest.raises(Exception):  # noqa: B017
        edges.count()


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, format):
    df = spark.createDataFrame([(1, 2, 0.5), (2, 3, 1.5)], "from long, to long, w double")
    path = f"{tmp_path}/e.{format}"
    df.write.format(format).save(path)
    options = ReadOptions(has_header=False, header="from:uint,to:uint,w:double" if format == "csv" else "", include_columns=("w",))
    got = load_edges(spark, path, options)
    assert sorted((r.src, r.dst, r.data.w) for r in got.collect()) == [(1, 2, 0.5), (2, 3, 1.5)]
    with pytest.raises(ValueError):
        load_edges(spark, path, ReadOptions(has_header=False, header=options.header, from_column="no"))


def test_wrong_ids_of_other_formats(spark, tmp_path):
    spark.createDataFrame([(-1, 2)], "from long, to long").write.parquet(f"{tmp_path}/e.parquet")
    with pytest.raises(Exception, match="out of range"):
        load_edges(spark, f"{tmp_path}/e.parquet").collect()


def folder(tmp_path, *files):
    for n, text in enumerate(files):
        (tmp_path / f"part-{n}.csv").write_text(text)
    return str(tmp_path)


def test_a_folder_of_equal_headers(spark, tmp_path):
    p = folder(tmp_path, "from:uint,to:uint,w:\n1,2,\n", "from:uint,to:uint,w:\n3,4,\n", "", "from:uint,to:uint,w:\n")
    assert sorted(tuple(r) for r in read_edges(spark, p).collect()) == [(1, 2), (3, 4)]


@pytest.mark.parametrize("other", ["to:uint,from:uint,i:int", "from:uint,to:uint,i:long", "from:uint,to:uint", "from:uint,to:uint,j:int", "from:uint,to:uint,i:int,s:string", "5,6,7"])
def test_a_file_with_another_header_fails(spark, tmp_path, other):
    """In any order of files, whatever is selected: its columns would be taken for those of the others."""
    row = ",".join("9" for _ in other.split(","))
    for at in range(3):
        files = ["from:uint,to:uint,i:int\n1,2,3\n"] * 2
        files.insert(at, f"{other}\n{row}\n")
        d = tmp_path / str(at)
        d.mkdir()
        with pytest.raises(Exception):  # noqa: B017
            read_edges(spark, folder(d, *files)).collect()
        with pytest.raises(Exception):  # noqa: B017
            read_edges(spark, folder(d, *files), ReadOptions(include_columns=("i",))).select("dst").count()


def test_a_given_header_skips_first_lines_unread(spark, tmp_path):
    p = folder(tmp_path, "anything\n1,2\n", "a:b,c\n3,4\n")
    assert sorted(tuple(r) for r in read_edges(spark, p, ReadOptions(header="from:uint,to:uint")).collect()) == [(1, 2), (3, 4)]


def payload(schema, make):
    return BatchPayload(schema, make)


def test_payload_by_batches(spark, tmp_path):
    p = put(tmp_path, HEADER + '\n1,2,4,4.0,"4.00"\n2,3,5,5.0,"5.00"\n')
    o = ReadOptions(include_columns=("s", "i"))

    def make(batch):
        assert batch.schema.names == ["s", "i"]
        return pa.RecordBatch.from_arrays([pc.multiply(batch.column("i"), pa.scalar(2, pa.int32())), pc.utf8_length(batch.column("s"))], ["twice", "n"])

    got = read_edges(spark, p, o, payload("n int, twice int", make))
    assert got.schema["data"].dataType.simpleString() == "struct<n:int,twice:int>"
    assert sorted((r.src, r.dst, tuple(r.data)) for r in got.collect()) == [(1, 2, (4, 8)), (2, 3, (4, 10))]
    v = read_vertices(spark, put(tmp_path, "id:uint,s:string\n7,abc\n", "v.csv"), ReadOptions(include_columns=("s",)))
    made = map_payload(v, payload("n int", lambda b: pa.StructArray.from_arrays([pc.utf8_length(b.column("s"))], ["n"])))
    assert [tuple(r.data) for r in made.collect()] == [(3,)]


@pytest.mark.parametrize(
    "make",
    [
        lambda b: pa.RecordBatch.from_arrays([pc.cast(b.column("i"), pa.int64())], ["n"]),
        lambda b: pa.RecordBatch.from_arrays([b.column("i")], ["m"]),
        lambda b: pa.RecordBatch.from_arrays([b.column("i"), b.column("i")], ["n", "m"]),
        lambda b: pa.RecordBatch.from_arrays([b.column("i").slice(1)], ["n"]),
        lambda b: b.column("i"),
        lambda b: None,
    ],
)
def test_wrong_payloads_fail(spark, tmp_path, make):
    p = put(tmp_path, HEADER + "\n1,2,4,4.0,x\n2,3,5,5.0,y\n")
    with pytest.raises(Exception):  # noqa: B017
        read_edges(spark, p, ReadOptions(include_columns=("i",)), payload("n int", make)).collect()


def test_payload_needs_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        read_edges(spark, put(tmp_path, HEADER + "\n1,2,4,4.0,x\n"), None, payload("n int", lambda b: b))


def test_files_of_gzip_follow_the_rows(spark, sf, monkeypatch):
    """A gzip file is one task's, so more edges give more files, not larger ones."""
    from spindle.plans import queries

    monkeypatch.setattr(queries, "FILE_EDGES", 500, raising=False)
    edges = queries.QUERIES["read_edges_gzip"](spark, sf)
    per_file = edges.groupBy(F.input_file_name()).count().collect()
    assert len(per_file) >= edges.count() // 500 > 5 and max(r["count"] for r in per_file) < 1000
    assert len(queries.QUERIES["read_edges_folder"](spark, sf).inputFiles()) > 5
