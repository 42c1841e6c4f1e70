"""Token ids in a compressed store: one shared zstandard dictionary, each document a frame of its own.

Format, below one path:

- ``dictionary``: one row ``(hash, bytes)``. The hash is the xxh3 hash of the dictionary's bytes, 0 for no dictionary.
- ``shards``: rows are blocks of documents in ascending order: ``shard, block, first_id, last_id, n_docs, n_ids,
  dictionary_hash, doc_ids, index, frames``. ``index`` has ``n_docs + 1`` unsigned 64-bit offsets into ``frames``, then
  ``n_docs`` id counts; each frame holds one document's little-endian unsigned 32-bit ids, compressed by itself.
- ``manifest``: ``(shard, start)``: ids in all shards before.

The container is Parquet through Spark's writers, so the store can be in any file system that Spark has, tasks can be
retried, and a filter on ``first_id`` and ``last_id`` finds the block of a document, of which one frame is unpacked.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.textscan import batches
from spindle.llm.tokens import BATCH_BYTES, BYTE_VOCABULARY, encoder, vocabulary
from spindle.session import small_batches

SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1500, 64 << 10, 112_640
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
END_ID, LEVEL = 2, 3
BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("dictionary_hash", pa.int64()), ("doc_ids", pa.binary()), ("index", pa.binary()), ("frames", pa.binary())])
_NULL_ID = -(2**63)


def _end(end_id: int | None) -> bytes:
    return b"" if end_id is None else np.array([end_id], "<u4").tobytes()


def dictionary_hash(d: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(d)).astype(np.int64)) if d else 0


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialised id arrays; empty where there are too few to train on."""
    samples = [s for s in samples if s]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _sample(texts: DataFrame, path: str, end_id: int | None) -> list[bytes]:
    """The ids of about ``SAMPLE_DOCS`` documents chosen by hash, those of up to ``SAMPLE_BYTES``."""
    n = texts.count()
    wanted = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(max(1, n // SAMPLE_DOCS))) == 0).select("text")

    def ids(source):
        e = encoder(path, True)
        for batch in batches(source, ["text"], BATCH_BYTES, keep_memos=True):
            got = [x + _end(end_id) for x in e.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x in got if len(x) <= SAMPLE_BYTES], pa.binary())], ["ids"])

    with small_batches(texts.sparkSession):
        rows = wanted.mapInArrow(ids, "ids binary").limit(2 * SAMPLE_DOCS).toArrow()
    return sorted(x.as_py() for x in rows.column("ids"))


def _write_task(path: str, end_id: int | None, shared):
    def run(source):
        e, d, shard, end = encoder(path, True), shared.value, TaskContext.get().partitionId(), _end(end_id)
        data = zstandard.ZstdCompressionDict(d) if d else None
        if data:
            data.precompute_compress(level=LEVEL)
        pack = zstandard.ZstdCompressor(dict_data=data) if data else zstandard.ZstdCompressor(level=LEVEL)
        ids, counts, frames, size, block = [], [], [], 0, 0

        def flush():
            index = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8").tobytes() + np.array(counts, "<u8").tobytes()
            row = [shard, block, ids[0], ids[-1], len(ids), sum(counts), dictionary_hash(d), np.array(ids, "<i8").tobytes(), index, b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)

        for batch in batches(source, ["text"], BATCH_BYTES, keep_memos=True):
            doc_ids = batch.column("doc_id").to_pylist()
            for doc, x in zip(doc_ids, e.encode(batch.column("text")), strict=True):
                x += end
                if frames and (len(frames) >= BLOCK_DOCS or size + len(x) > BLOCK_BYTES):
                    yield flush()
                    ids, counts, frames, size, block = [], [], [], 0, block + 1
                ids.append(_NULL_ID if doc is None else doc)
                counts.append(len(x) // 4)
                frames.append(pack.compress(x))
                size += len(x)
        if frames:
            yield flush()

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str = "", id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> None:
    """Encodes every whole text and writes the store at ``path``.

    Documents are in ascending order of id, null ids first, repeated ids by a hash of their texts. A null text is an
    empty one. The dictionary is trained on a bounded sample; every document is stored, whatever its length. Fewer than
    16 documents in the sample train no dictionary, and frames are compressed without one. No rows give a store of no
    documents. Other columns are ignored.
    """
    spark = docs.sparkSession
    path, tokenizer = path.rstrip("/"), tokenizer or vocabulary(BYTE_VOCABULARY)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = train(_sample(texts, tokenizer, end_id))
    spark.createDataFrame([(dictionary_hash(d), bytearray(d))], "hash long, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(d)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = texts.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = "shard int, block int, first_id long, last_id long, n_docs int, n_ids long, dictionary_hash long, doc_ids binary, index binary, frames binary"
    with small_batches(spark):
        dealt.mapInArrow(_write_task(tokenizer, end_id, shared), schema).write.option("compression", "none").parquet(f"{path}/shards")
    # One row a shard: as many as the write had tasks.
    totals = spark.read.parquet(f"{path}/shards").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    starts, at = [], 0
    for r in totals:
        starts.append((r["shard"], at))
        at += r["n"]
    spark.createDataFrame(starts, "shard int, start long").coalesce(1).write.parquet(f"{path}/manifest")


def dictionary(spark: SparkSession, path: str) -> tuple[int, bytes]:
    row = spark.read.parquet(f"{path.rstrip('/')}/dictionary").first()
    if dictionary_hash(bytes(row["bytes"])) != row["hash"]:
        raise ValueError(f"the dictionary in {path} does not have its hash")
    return row["hash"], bytes(row["bytes"])


def _unpacker(d: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d)) if d else zstandard.ZstdDecompressor()


def unpack_block(row: dict, unpack: zstandard.ZstdDecompressor, which: int | None = None):
    """``(doc_id, ids)`` of a block's documents, or of its document number ``which`` alone."""
    n = row["n_docs"]
    index = np.frombuffer(row["index"], "<u8")
    frames, doc_ids = memoryview(row["frames"]), np.frombuffer(row["doc_ids"], "<i8")
    for i in range(n) if which is None else (which,):
        x = unpack.decompress(frames[int(index[i]) : int(index[i + 1])], max_output_size=4 * int(index[n + 1 + i]) or 1)
        yield (None if doc_ids[i] == _NULL_ID else int(doc_ids[i])), x


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids, ids_crc32)`` of every stored document; ``ids`` are the serialised ids."""
    path = path.rstrip("/")
    key, d = dictionary(spark, path)
    shared = spark.sparkContext.broadcast((key, d))
    from pyspark.sql import Window

    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shards = spark.read.parquet(f"{path}/shards")
    starts = shards.select("shard", "block", "n_ids").withColumn("inner", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    starts = starts.join(spark.read.parquet(f"{path}/manifest"), "shard").select("shard", "block", (F.col("start") + F.col("inner")).alias("start"))
    blocks = shards.join(starts, ["shard", "block"]).select("start", "n_docs", "dictionary_hash", "doc_ids", "index", "frames")

    def run(source):
        key, d = shared.value
        unpack = _unpacker(d)
        for batch in source:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("start", "n_docs", "dictionary_hash", "doc_ids", "index", "frames")}
                if row["dictionary_hash"] != key:
                    raise ValueError("a block names another dictionary")
                ids, data = zip(*unpack_block(row, unpack), strict=True)
                n = np.array([len(x) // 4 for x in data], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(row["start"] + np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary()), pa.array([zlib.crc32(x) for x in data], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of one id: reads the blocks that can hold it and unpacks its frames alone."""
    _, d = dictionary(spark, path)
    unpack, out = _unpacker(d), []
    for row in spark.read.parquet(f"{path.rstrip('/')}/shards").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).toLocalIterator():
        for i in np.flatnonzero(np.frombuffer(bytes(row["doc_ids"]), "<i8") == doc_id):
            out += [np.frombuffer(x, "<u4").tolist() for _, x in unpack_block(row.asDict(), unpack, int(i))]
    return out
