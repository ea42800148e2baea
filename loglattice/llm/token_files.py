"""Token ids in files: blocks of a fixed number of ids, shuffled into planes, each plane compressed.

File format. The documents are sorted by doc_id and dealt into shards, ranges of doc_id; the ids of a
shard, each document followed by the end id, are cut into blocks of `block_ids`. A shard is one Parquet
file with one row group and a row for each block, in order: shard, chunk (from 0), first_id (the block's
place in the shard), n_ids, continued (its first document began in the block before), doc_ids and
doc_sizes (the chunk index: the documents in the block and how many of their ids it holds), and the blob:

    bytes 0-3   "IDPL"
    byte  4     1: bit planes, 8: byte planes
    byte  5     number of planes
    4 each      compressed size of each plane, little-endian
    ...         the planes, each a zstandard frame, the lowest bits first

Bit plane k holds bit k of every id (packed, the first id in the lowest bit); byte plane k holds byte k.
Planes above the highest set bit or byte are left out. Files are written by Spark's committer, so a lost
executor leaves no half file behind.

Defined results: null texts count as empty and have the end id alone; an empty table gives no rows; very long texts
run on over as many blocks as they fill; ties of doc_id are ordered by text, and equal rows
by their places in the input, so that they may fill several shards; a null doc_id comes first; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import limit_batches
from .tokens import encoder

BLOCK_IDS = 1 << 16
_MAGIC = b"IDPL"
_SCHEMA = "shard int, chunk int, first_id long, n_ids int, continued boolean, doc_ids array<long>, doc_sizes array<int>, blob binary"


def shuffle_planes(ids: bytes, bits: bool = False, level: int = 1) -> bytes:
    """A block of little-endian 32-bit ids as a blob."""
    values = np.frombuffer(ids, "<u4")
    top = int(values.max()).bit_length() if len(values) else 0
    if bits:
        rows = np.unpackbits(values.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, : max(1, top)]
        planes = np.packbits(rows.T, axis=1, bitorder="little")
    else:
        planes = values.view(np.uint8).reshape(-1, 4).T[: max(1, (top + 7) // 8)]
    packer = zstandard.ZstdCompressor(level=level)
    packed = [packer.compress(p.tobytes()) for p in planes]
    head = _MAGIC + bytes([1 if bits else 8, len(packed)]) + np.array([len(p) for p in packed], "<u4").tobytes()
    return head + b"".join(packed)


def unshuffle_planes(blob: bytes, n_ids: int) -> bytes:
    """The ids of a blob, as shuffle_planes was given them."""
    if blob[:4] != _MAGIC or blob[4] not in (1, 8):
        raise ValueError("not a block of token ids")
    width, count = blob[4], blob[5]
    sizes = np.frombuffer(blob, "<u4", count, 6)
    at = 6 + 4 * count
    unpacker = zstandard.ZstdDecompressor()
    planes = []
    for size in sizes.tolist():
        planes.append(np.frombuffer(unpacker.decompress(blob[at : at + size]), np.uint8))
        at += size
    if width == 8:
        out = np.zeros((n_ids, 4), np.uint8)
        for k, plane in enumerate(planes):
            out[:, k] = plane
        return out.tobytes()
    rows = np.zeros((32, n_ids), np.uint8)
    for k, plane in enumerate(planes):
        rows[k] = np.unpackbits(plane, count=n_ids, bitorder="little")
    return np.packbits(rows.T, axis=1, bitorder="little").tobytes()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_ids: int = BLOCK_IDS, bits: bool = False, shard_bytes: int = 32 << 20) -> None:
    """Encodes `docs` (doc_id, text) and writes the shards to `path`, which Spark can write. There is a shard for about
    each `shard_bytes` of text, and one for each core at least, so a shard stays one row group however large the table."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        held, names, sizes = bytearray(), [], []
        chunk = 0
        continued = False
        out: list[tuple] = []

        def close(n: int) -> None:
            """The first n ids held become a block."""
            nonlocal chunk, continued
            taken, sizes_in = 0, []
            for size in sizes:
                part = min(size, n - taken)
                sizes_in.append(part)
                taken += part
                if taken == n:
                    break
            k = len(sizes_in)
            out.append((shard, chunk, chunk * block_ids, n, continued, names[:k], sizes_in, shuffle_planes(bytes(held[: 4 * n]), bits)))
            del held[: 4 * n]
            continued = sizes_in[-1] < sizes[k - 1]
            if continued:
                sizes[k - 1] -= sizes_in[-1]
            del names[: k - continued], sizes[: k - continued]
            chunk += 1

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            fields = ["shard", "chunk", "first_id", "n_ids", "continued", "doc_ids", "doc_sizes", "blob"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py())
                held += ids
                held += end
                names.append(name)
                sizes.append(len(ids) // 4 + 1)
                while len(held) >= 4 * block_ids:
                    close(block_ids)
                if len(out) >= 8:
                    yield rows()
        if held:
            close(len(held) // 4)
        if out:
            yield rows()

    limit_batches(docs.sparkSession)
    order = F.xxhash64(F.coalesce("text", F.lit("")))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(math.ceil(total / shard_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    # by their places equal rows can be parted, too
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place"))
    ranged = placed.repartitionByRange(shards, "doc_id", order, "place").sortWithinPartitions("doc_id", order, "place").drop("place")
    ranged.mapInArrow(blocks, _SCHEMA).write.option("compression", "none").option("parquet.block.size", 1 << 30).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Reads the shards back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(_SCHEMA).parquet(path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a document is open until its last block is over, which only the next block tells
        open_doc = None
        shard, next_chunk = -1, 0
        for batch in batches:
            done: list[tuple] = []
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    if row["chunk"]:
                        raise ValueError(f"shard {row['shard']} does not begin with its first block")
                    shard, next_chunk = row["shard"], 0
                if row["chunk"] != next_chunk:
                    raise ValueError(f"shard {shard}: block {row['chunk']} where {next_chunk} is due")
                next_chunk += 1
                ids = unshuffle_planes(row["blob"], row["n_ids"])
                at = 0
                for k, (name, size) in enumerate(zip(row["doc_ids"], row["doc_sizes"], strict=True)):
                    part = ids[4 * at : 4 * (at + size)]
                    if k == 0 and row["continued"]:
                        _, _, start, n, crc = open_doc
                        open_doc = (name, shard, start, n + size, zlib.crc32(part, crc))
                    else:
                        if open_doc:
                            done.append(open_doc)
                        open_doc = (name, shard, row["first_id"] + at, size, zlib.crc32(part))
                    at += size
            yield _documents(done)
        if open_doc:
            yield _documents([open_doc])

    found = files.mapInArrow(documents, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long")
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return found.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "shard", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
