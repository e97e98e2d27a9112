"""Token files: fixed-size id blocks, transposed into planes, each compressed by itself.

The ids of all documents, in ascending doc_id order, form one long stream, which is cut
into shards (ranges of doc_id) and these into chunks of fixed size. A chunk's bytes:

    b"TPL1" | u8 bytes per id | u8 kind (0 byte planes, 1 bit planes) | u32 ids
    | u32 size of each compressed plane ... | the planes

Chunks are the rows of a Parquet dataset, since only Spark's writers reach every store and
commit whole tasks; beside it lies a chunk index (shard, chunk, first id, ids, bytes) that
is read without touching a payload. A chunk also names the documents whose ids it holds.
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, small_batches, text_or_empty
from .tokens import encoder

MAGIC = b"TPL1"
#: Ids in a chunk.
CHUNK = 1 << 16
LEVEL = 3

CHUNKS = "shard int, chunk int, first long, n_ids int, payload binary, doc_id array<long>, doc_first array<long>, piece array<int>, doc_tokens array<long>"


def encode_block(ids: np.ndarray, bits: bool = False) -> bytes:
    """One chunk's bytes. Width is the fewest bytes that hold its largest id."""
    width = max(1, (int(ids.max()).bit_length() + 7) // 8) if len(ids) else 1
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T
    if bits:
        planes = np.packbits(np.unpackbits(planes[:, :, None], axis=2, bitorder="little").transpose(0, 2, 1).reshape(width * 8, -1), axis=1)
    z = zstandard.ZstdCompressor(level=LEVEL)
    packed = [z.compress(np.ascontiguousarray(x).tobytes()) for x in planes]
    return b"".join([MAGIC, struct.pack("<BBI", width, bits, len(ids)), struct.pack(f"<{len(packed)}I", *map(len, packed)), *packed])


def decode_block(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a token chunk")
    width, bits, n = struct.unpack_from("<BBI", data, 4)
    count = width * (8 if bits else 1)
    sizes = struct.unpack_from(f"<{count}I", data, 10)
    at, z, out = 10 + 4 * count, zstandard.ZstdDecompressor(), np.zeros((n, 4), np.uint8)
    planes = []
    for size in sizes:
        planes.append(np.frombuffer(z.decompress(data[at : at + size], max_output_size=max(n, 1)), np.uint8))
        at += size
    if bits:
        rows = np.stack([np.unpackbits(x)[:n] for x in planes]).reshape(width, 8, n)
        planes = list(np.packbits(rows.transpose(0, 2, 1), axis=2, bitorder="little").reshape(width, n))
    for k, x in enumerate(planes):
        out[:, k] = x
    return out.view("<u4").reshape(-1)


def _times(matrix: np.ndarray, vector: int) -> int:
    out = 0
    k = 0
    while vector:
        if vector & 1:
            out ^= int(matrix[k])
        vector >>= 1
        k += 1
    return out


def _zero_bytes_operators() -> list[np.ndarray]:
    """Operators over GF(2) that append 1, 2, 4, ... zero bytes to data with a given CRC-32."""
    one = np.array([0xEDB88320] + [1 << k for k in range(31)], dtype=np.uint64)  # one zero bit
    square = lambda m: np.array([_times(m, int(m[k])) for k in range(32)], dtype=np.uint64)
    out = [square(square(square(one)))]
    for _ in range(47):
        out.append(square(out[-1]))
    return out


_APPEND = _zero_bytes_operators()


def shifted_crc(crc: int, later: int) -> int:
    """What a piece adds, by exclusive or, to the CRC-32 of a whole in which `later` bytes follow it."""
    for k in range(later.bit_length()):
        if later >> k & 1:
            crc = _times(_APPEND[k], crc)
    return crc


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, chunk: int = CHUNK, bits: bool = False) -> None:
    """Encode every text, append `end_id`, and write `path`/chunks and `path`/index.

    Null text counts as empty (its end id alone); texts are taken whole, however long. Rows that
    repeat a doc_id are kept, in the order of a hash of their text; null ids come first. Equal rows
    are one after the other in any order, which shows nowhere. However many rows share an id, they
    are spread over partitions. Other columns, whatever their names, are not read. An empty table
    gives empty datasets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    arrow = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("payload", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("doc_first", pa.list_(pa.int64())), ("piece", pa.list_(pa.int32())), ("doc_tokens", pa.list_(pa.int64()))])

    def run(batches):
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        held: deque[tuple] = deque()  # doc_id, first in document, ids, document's ids
        size = number = first = 0

        def cut(n: int):
            nonlocal size, number, first
            taken, left = [], n
            while left:
                doc_id, at, ids, total = held.popleft()
                if len(ids) > left:
                    held.appendleft((doc_id, at + left, ids[left:], total))
                    ids = ids[:left]
                taken.append((doc_id, at, ids, total))
                left -= len(ids)
            row = [shard, number, first, n, encode_block(np.concatenate([x[2] for x in taken]), bits), [x[0] for x in taken], [x[1] for x in taken], [len(x[2]) for x in taken], [x[3] for x in taken]]
            size, number, first = size - n, number + 1, first + n
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids_, texts = (c.to_pylist() for c in b.slice(at, 256).columns)
                for doc_id, ids in zip(ids_, enc.ids(texts)):
                    ids = np.append(ids, np.uint32(end_id))
                    held.append((doc_id, 0, ids, len(ids)))
                    size += len(ids)
                while size >= chunk:
                    yield cut(chunk)
        if size:
            yield cut(size)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    placed = rows.repartitionByRange(partitions(spark), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    placed.mapInArrow(run, CHUNKS).write.parquet(f"{path}/chunks")
    spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("shard", "chunk", "first", "n_ids", F.length("payload").alias("bytes")).write.parquet(f"{path}/index")


def shard_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard: one number per shard, of which there are as many as shuffle partitions."""
    index = spark.read.schema("shard int, chunk int, first long, n_ids int, bytes int").parquet(f"{path}/index")
    sums = {r.shard: r.n for r in index.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    out, at = {}, 0
    for shard in sorted(sums):
        out[shard] = at
        at += sums[shard]
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. Chunks are decoded
    independently; a document that spans several has its checksum put together by exclusive or."""
    starts = shard_starts(spark, path)
    arrow = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n", "crc")])

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].as_py() for n in b.schema.names}
                ids, at, out = decode_block(row["payload"]), 0, []
                for doc_id, first, n, total in zip(row["doc_id"], row["doc_first"], row["piece"], row["doc_tokens"]):
                    crc = zlib.crc32(ids[at : at + n].tobytes())
                    out.append((doc_id, starts[row["shard"]] + row["first"] + at - first, n, shifted_crc(crc, 4 * (total - first - n))))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=arrow)

    pieces = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").mapInArrow(run, "doc_id long, start long, n long, crc long")
    return pieces.groupBy("doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Ids from place `start` to before `stop` of the whole stream, as (start, ids) by chunk. The index
    says which chunks hold them, and only these are read."""
    index = spark.read.schema("shard int, chunk int, first long, n_ids int, bytes int").parquet(f"{path}/index")
    starts = shard_starts(spark, path)
    shards = [s for s, at in starts.items() if at < stop]
    last = max((s for s in shards if starts[s] <= start), default=0)
    begins = F.create_map(*[F.lit(x) for s in shards if s >= last for x in (s, starts[s])]) if shards else F.create_map(F.lit(-1), F.lit(0))
    wanted = index.where(F.col("shard").isin([s for s in shards if s >= last])).withColumn("begin", F.element_at(begins, F.col("shard")) + F.col("first"))
    wanted = wanted.where((F.col("begin") < stop) & (F.col("begin") + F.col("n_ids") > start)).groupBy("shard").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).collect()
    if not wanted:
        return spark.createDataFrame([], "start long, ids array<long>")
    these = reduce(lambda a, b: a | b, [(F.col("shard") == w.shard) & F.col("chunk").between(w.low, w.high) for w in wanted])
    arrow = pa.schema([("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for s, f, x in zip(*(b.column(n).to_pylist() for n in ("shard", "first", "payload"))):
                ids, at = decode_block(x), starts[s] + f
                a, z = max(0, start - at), min(len(ids), stop - at)
                yield pa.RecordBatch.from_arrays([pa.array([at + a], pa.int64()), pa.array([ids[a:z].tolist()], arrow.field(1).type)], schema=arrow)

    return spark.read.schema(CHUNKS).parquet(f"{path}/chunks").where(these).select("shard", "first", "payload").mapInArrow(run, "start long, ids array<long>")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The id stream: shard, chunk, first id's place in the whole stream, ids."""
    starts = shard_starts(spark, path)
    arrow = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("start", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for s, c, f, x in zip(*(b.column(n).to_pylist() for n in ("shard", "chunk", "first", "payload"))):
                yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((s, c, starts[s] + f, decode_block(x).tolist()), arrow)], schema=arrow)

    return spark.read.schema(CHUNKS).parquet(f"{path}/chunks").mapInArrow(run, "shard int, chunk int, start long, ids array<long>")
