"""Best-fit packing with certificates: dual-feasible functions bound each partition's number of bins from
below; partitions that miss their bound exchange documents and pack again.

Documents longer than a sequence are cut into full pieces (the first piece may be shorter); the pieces are
dealt evenly over partitions of bounded size, `PARTITIONS` at least, each packed best-fit decreasing. A partition
whose number of bins equals its bound is certified: its bins stay, all but its emptiest. A partition with a gap gives
up all bins that are not nearly full. What is given up is dealt over half as many partitions, or as few as hold it, and
packed again, so that documents of several partitions meet, until it is packed in one partition or there are no more
rounds. If all bins together are then still more than the bound of all pieces, those of all partitions that are not
full to the last token exchange documents once more, and the better packing of the two counts. Each piece comes with the round it was packed
in last, and the bins and the bound of its partition there; `certificate` tells the bound of all pieces, and the gap.

Defined results: null texts count as empty and have the end id alone; repeated documents are packed once for
each row; very long texts are pieces of one document, encoded as one text; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, materialise
from .tokens import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document with their place in it, length and crc32 of their ids."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    limit_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest of the bounds that dual-feasible functions give: the sum of f(size) over all items, where
    f maps every set that fits one bin to at most 1. Two families are tried: for a threshold t, sizes above
    capacity - t count whole and those below t not at all; for k, (k+1)-ths of a bin are rounded down and
    weighed 1/k, but exact multiples keep their size. All in whole numbers."""
    return _bound(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity)


def _bound(count: np.ndarray, capacity: int) -> int:
    """The bound for count[s] items of each size s."""
    if not count.sum():
        return 0
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    number, volume = np.cumsum(count), np.cumsum(count * size)
    for t in range(1, capacity // 2 + 1):
        high = int(number[-1] - number[capacity - t])
        middle = int(volume[capacity - t] - volume[t - 1])
        best = max(best, high - (-middle // capacity))
    for k in range(1, 64):
        weight = np.where((k + 1) * size % capacity == 0, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * weight).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and the bins' fill."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with room r is open
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[item], offsets[item] = b, fill[b]
        fill[b] += size
        if left := room - size:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, fill


def bound_of(items: DataFrame, capacity: int) -> int:
    """The lower bound for all `items` (length) together, from how often each length is there."""
    counts = items.groupBy("length").agg(F.count("*").alias("n")).collect()
    count = np.zeros(capacity + 1, np.int64)
    for r in counts:
        count[r.length] = r.n
    return _bound(count, capacity)


def certificate(packed: DataFrame, capacity: int) -> DataFrame:
    """One row on packed items (length, sequence_id): sequences, bound (no packing has fewer), gap."""
    bound = bound_of(packed, capacity)
    return packed.agg(F.count_distinct("sequence_id").alias("sequences")).select("sequences", F.lit(bound).cast("long").alias("bound"), (F.col("sequences") - bound).alias("gap"))


#: Partitions of the first round, at least, however few pieces there are.
PARTITIONS = 2


def _packer(capacity: int, turn: int, last: bool, nearly_full: float):
    def pack_partition(key: tuple[pa.Scalar], part: pa.Table) -> pa.Table:
        sizes = part.column("length").to_numpy().astype(np.int64)
        bins, offsets, fill = best_fit_decreasing(sizes, capacity)
        full, bound = np.array(fill, np.int64), lower_bound(sizes, capacity)
        if last:
            keep = np.ones(len(full), bool)
        elif len(full) > bound:
            keep = full >= nearly_full * capacity
        else:
            keep = np.arange(len(full)) != full.argmin()
        base = (turn << 58) + (key[0].as_py() << 32)
        told = {"round": np.full(len(sizes), turn, np.int32), "partition_bins": np.full(len(sizes), len(full)), "partition_bound": np.full(len(sizes), bound)}
        for name, column in {"sequence_id": base + bins, "offset": offsets, "settled": keep[bins], **told}.items():
            part = part.append_column(name, pa.array(column))
        return part.drop_columns(["partition"])

    return pack_partition


_PACKED = "sequence_id long, offset long, settled boolean, round int, partition_bins long, partition_bound long"


def pack(items: DataFrame, capacity: int, partition_items: int = 100_000, rounds: int = 5, nearly_full: float = 0.99) -> DataFrame:
    """Adds sequence_id, offset, round, partition_bins and partition_bound to `items` (with a column length from 1 to
    capacity). `partition_items` bounds what one task packs."""
    rest = materialise(items)
    names = rest.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + f", {_PACKED}"
    bound = bound_of(rest, capacity)
    settled: list[DataFrame] = []
    bins, partitions = 0, 0

    def packed_in(part: DataFrame, partitions: int, turn: int, last: bool) -> DataFrame:
        # ids of rows in a written table: even, and the same when a task runs again
        dealt = part.withColumn("partition", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(partitions)))
        return materialise(dealt.groupBy("partition").applyInArrow(_packer(capacity, turn, last, nearly_full), schema))

    for turn in range(rounds):
        partitions = max(partitions // 2 if turn else PARTITIONS, math.ceil(rest.count() / partition_items), 1)
        last = turn == rounds - 1 or partitions == 1
        packed = packed_in(rest, partitions, turn, last)
        kept = packed if last else packed.where("settled")
        settled.append(kept)
        bins += kept.agg(F.count_distinct("sequence_id")).first()[0]
        if last:
            break
        rest = materialise(packed.where("not settled").select(*names))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    if bins > bound:
        fill = out.groupBy("sequence_id").agg(F.sum("length").alias("fill")).where(F.col("fill") < capacity).select("sequence_id")
        pool = materialise(out.join(fill, "sequence_id", "left_semi").select(*names, "sequence_id"))
        before, count = pool.agg(F.count_distinct("sequence_id"), F.count("*")).first()
        again = packed_in(pool.select(*names), max(1, math.ceil(count / partition_items)), rounds, True)
        if again.agg(F.count_distinct("sequence_id")).first()[0] < before:
            out = out.join(fill, "sequence_id", "left_anti").select(*again.columns).unionByName(again)
    return out.select(*names, "sequence_id", "offset", "round", "partition_bins", "partition_bound")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, partition_items: int = 100_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, round, partition_bins, partition_bound for every piece of
    every document."""
    return pack(pieces(docs, tokenizer, end_id, capacity), capacity, partition_items)
