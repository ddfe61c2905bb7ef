"""Op 3. Token ids in files of separately compressed documents with one shared dictionary."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import chunks, shuffle_partitions
from newsloom.llm.tokens import encoder

MAGIC = b"ZIDS1"
HEAD = struct.Struct("<5sB32sI")  # magic, bytes of an id, dictionary's SHA-256, documents
BLOCK_BYTES = 4 << 20


def train_dictionary(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                     end_id: int = 2, rows: int = 600, longest: int = 20_000,
                     size: int = 112_640) -> bytes:
    """A zstandard dictionary trained on the serialised ids of a sample of documents.

    The sample is bounded: about ``rows`` documents chosen by a hash of their id, of at most
    ``longest`` characters each, since the dictionary serves short documents. The data decide only
    how well the files compress. Where the sample is too small to train on, its bytes are the
    dictionary.
    """
    step = max(1, docs.count() // rows)
    sample = (docs.filter((F.pmod(F.xxhash64(doc_id), F.lit(step)) == 0)
                          & (F.length(text) <= longest))
              .select(text).limit(2 * rows).collect())
    model = encoder(tokenizer, True)
    ids, starts = model.encode([r[0] for r in sample])
    ids = ids.astype(_kind(model))
    samples = [np.append(part, ids.dtype.type(end_id)).tobytes()
               for part in np.split(ids, starts[1:-1])] if sample else []
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or bytes(8))[-size:].ljust(8, b"\0")


def _kind(model) -> np.dtype:
    return np.dtype("<u2" if model.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


def pack_block(arrays: Sequence[np.ndarray], raw_dictionary: bytes,
               compressor: zstandard.ZstdCompressor) -> bytes:
    """Head, then where each document's frame ends, each document's number of ids, the frames."""
    frames = [compressor.compress(a.tobytes()) for a in arrays]
    return b"".join([
        HEAD.pack(MAGIC, arrays[0].itemsize, hashlib.sha256(raw_dictionary).digest(), len(arrays)),
        np.cumsum([len(f) for f in frames]).astype("<u8").tobytes(),
        np.array([len(a) for a in arrays], "<u8").tobytes(), *frames])


class Block:
    """A block's index; ``ids(i)`` decompresses document ``i`` alone."""

    def __init__(self, payload: bytes, raw_dictionary: bytes):
        magic, width, digest, count = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        if digest != hashlib.sha256(raw_dictionary).digest():
            raise ValueError("the block was written with another dictionary")
        self.payload, self.kind, at = payload, np.dtype(f"<u{width}"), HEAD.size
        self.ends = np.frombuffer(payload, "<u8", count, at)
        self.lengths = np.frombuffer(payload, "<u8", count, at + 8 * count)
        self.first = at + 16 * count
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(raw_dictionary))

    def ids(self, i: int) -> np.ndarray:
        start = self.first + (int(self.ends[i - 1]) if i else 0)
        frame = self.payload[start:self.first + int(self.ends[i])]
        return np.frombuffer(self.decompressor.decompress(frame), self.kind).astype("<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id",
                      text: str = "text", end_id: int = 2,
                      block_bytes: int = BLOCK_BYTES) -> None:
    """Write the ids of each text and an end id, in ascending order of the document's id.

    ``folder/dictionary`` holds the shared dictionary, ``folder/blocks`` the blocks: (part, block,
    tokens_before, first, last, doc_ids, payload). A part is one range of ids, a block about
    ``block_bytes`` of frames of it; ``payload`` is the binary format of ``pack_block``. Parquet
    is only the envelope: Spark commits it whole, on any store, and finds a document's block by
    the footers' ``first`` and ``last``.

    The texts are shuffled once, by ranges of the id; a task holds about 8 MB of text and a block.
    A null or empty text is its end id alone. Null ids come first; rows of one id are ordered by
    text (null first) and stay apart. Other columns are not read. An empty table gives a
    dictionary and no blocks.
    """
    spark = docs.sparkSession
    raw = train_dictionary(docs, tokenizer, doc_id, text, end_id)
    spark.createDataFrame([(raw,)], "dictionary binary").coalesce(1).write.parquet(
        f"{folder}/dictionary")
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("tokens_before", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("first", kind), T.StructField("last", kind),
        T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("payload", T.BinaryType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = encoder(tokenizer, True), TaskContext.get().partitionId()
        width = _kind(model)
        dictionary = _dictionary(raw)
        dictionary.precompute_compress(level=3)
        compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary)
        block, before, arrow = 0, 0, None

        def row(keys, arrays):
            nonlocal block, before
            tokens = sum(len(a) for a in arrays)
            out = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([block], pa.int32()),
                pa.array([before], pa.int64()), pa.array([tokens], pa.int64()),
                pa.array(keys[:1], arrow), pa.array(keys[-1:], arrow),
                pa.array([keys], pa.list_(arrow)),
                pa.array([pack_block(arrays, raw, compressor)], pa.binary())],
                schema.fieldNames())
            block, before = block + 1, before + tokens
            return out

        def typed():
            nonlocal arrow
            for batch in batches:
                arrow = batch.schema.field(doc_id).type
                yield batch

        keys, arrays, size = [], [], 0
        for found, texts in chunks(typed(), [doc_id, text], text):
            ids, starts = model.encode(texts)
            ids = ids.astype(width)
            for k, key in enumerate(found):
                own = np.append(ids[starts[k]:starts[k + 1]], width.type(end_id))
                keys.append(key)
                arrays.append(own)
                size += own.nbytes
                if size >= block_bytes:
                    yield row(keys, arrays)
                    keys, arrays, size = [], [], 0
        if keys:
            yield row(keys, arrays)

    (docs.select(doc_id, text)
     .repartitionByRange(shuffle_partitions(spark, docs), F.col(doc_id).asc_nulls_first())
     .sortWithinPartitions(F.col(doc_id).asc_nulls_first(), F.col(text).asc_nulls_first())
     .mapInArrow(blocks, schema)
     .write.option("compression", "uncompressed").parquet(f"{folder}/blocks"))


def _read_dictionary(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first()[0])


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Every document of the files: (doc_id, start, n_tokens, ids_crc32[, ids]).

    ``start`` counts the ids of all documents before it. The parts' totals, one row for each range
    partition, are summed up by one window and joined to the blocks.
    """
    raw = _read_dictionary(spark, folder)
    table = spark.read.parquet(f"{folder}/blocks")
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    kind = table.schema["first"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("start", T.LongType()),
              T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    names = [f.name for f in fields]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                block = Block(batch.column(2)[r].as_py(), raw)
                keys = batch.column(1).slice(r, 1).flatten()
                lengths = block.lengths.astype(np.int64)
                starts = batch.column(0)[r].as_py() + np.cumsum(lengths) - lengths
                parts = [block.ids(i).tobytes() for i in range(len(lengths))]
                arrays = [keys, pa.array(starts), pa.array(lengths),
                          pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if with_ids:
                    arrays.append(pa.array(parts, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = table.join(F.broadcast(base), "part")  # one row for each range partition
    return rows.select((F.col("base") + F.col("tokens_before")).alias("at"), "doc_ids",
                       "payload").mapInArrow(documents, T.StructType(fields))


def read_documents(spark: SparkSession, folder: str, doc_ids: Sequence) -> DataFrame:
    """(doc_id, ids) of a few documents: their blocks by the footers, their frames by the index."""
    raw = _read_dictionary(spark, folder)
    table = spark.read.parquet(f"{folder}/blocks")
    wanted = set(doc_ids)
    near = F.lit(False)
    for key in wanted:
        near = near | ((F.col("first") <= F.lit(key)) & (F.col("last") >= F.lit(key)))
    kind = table.schema["first"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType())])

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrow = batch.schema.field("doc_ids").type.value_type
            for r in range(batch.num_rows):
                block = Block(batch.column(1)[r].as_py(), raw)
                hits = [(key, block.ids(i).tobytes())
                        for i, key in enumerate(batch.column(0)[r].as_py()) if key in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[0] for h in hits], arrow),
                     pa.array([h[1] for h in hits], pa.binary())], ["doc_id", "ids"])

    return table.filter(near).select("doc_ids", "payload").mapInArrow(frames, schema)
