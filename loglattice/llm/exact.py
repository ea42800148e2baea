"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. The first reading of the texts leaves a fingerprint of 48 bits and a size for each row. Rows are dealt to
   blocks by a hash of their doc_id and fingerprint, so copies of one text are spread over all blocks.
2. A block sorts its different fingerprints and codes their gaps by Golomb's code with a power of two. Blocks
   report to districts; a district sends each owner (a range of fingerprints) one coded list. There are as many
   districts as owners, about the square root of what pairs of blocks and owners would be, so lists stay long.
3. An owner answers each list with a bitmap: which fingerprints another district holds too. A district adds
   those that two of its blocks hold, or one block twice, and sends each block its suspects.
4. The second reading deals the texts to the same blocks. Texts that are not suspects end there. Suspects are
   grouped by their bytes, first within the task, then over all: equal fingerprints alone decide nothing. A
   text with very many copies sends one row for each thousand of them at most.

Defined results: of equal texts the row with the largest doc_id stays; of several rows with that doc_id one
of them; a null doc_id is smaller than all others (a group of such rows keeps one, its keep_id is null). A null
text counts as empty and stays null. An empty table gives no rows. Texts are read a slice at a time, a very long
one by itself. Other columns are carried along in the struct `row`, whatever their names.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, materialise, text_slices

#: Bits of a fingerprint that are exchanged; a false suspect costs a comparison and nothing else.
BITS = 48
_HEAD = struct.Struct("<IBI")


def golomb_encode(values: np.ndarray, span: int = 1 << BITS) -> bytes:
    """Sorted different numbers below `span`: quotients of the gaps in unary, then their remainders."""
    if not len(values):
        return _HEAD.pack(0, 0, 0)
    gaps = np.diff(values, prepend=np.int64(-1)) - 1
    low = max(0, int(math.log2(max(1.0, span / len(values) * math.log(2)))))
    quotients = gaps >> low
    unary = np.zeros(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(low - 1, -1, -1) & 1).astype(np.uint8)
    return _HEAD.pack(len(values), low, len(unary)) + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(coded: bytes) -> np.ndarray:
    n, low, size = _HEAD.unpack_from(coded)
    if not n:
        return np.empty(0, np.int64)
    body = np.frombuffer(coded, np.uint8, offset=_HEAD.size)
    cut = -(-size // 8)
    gaps = (np.diff(np.flatnonzero(np.unpackbits(body[:cut], count=size)), prepend=-1) - 1) << low
    if low:
        rest = np.unpackbits(body[cut:], count=n * low).reshape(n, low)
        gaps += rest @ (np.int64(1) << np.arange(low - 1, -1, -1, dtype=np.int64))
    return np.cumsum(gaps + 1) - 1


def _bitmap(marks: np.ndarray) -> bytes:
    return np.packbits(marks).tobytes()


def _marks(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)


def _held_twice(parts: list[np.ndarray]) -> np.ndarray:
    """The numbers that two lists hold."""
    every = np.sort(np.concatenate(parts))
    return np.unique(every[1:][every[1:] == every[:-1]])


def _among(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


_REPORT = "district long, block long, prints binary, repeated binary"
_LIST = "owner long, district long, prints binary"
_ANSWER = "district long, owner long, held binary"
_SUSPECTS = "block long, prints binary"


def _rows(names: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split() for f in names.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary()}
    return pa.table([pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _report(districts: int, bits: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def report(key: tuple[pa.Scalar], part: pa.Table) -> pa.Table:
        block = key[0].as_py()
        prints, n = part.column("fp").to_numpy(), part.column("n").to_numpy()
        order = np.argsort(prints)
        return _rows(_REPORT, [(block % districts, block, golomb_encode(prints[order], 1 << bits), _bitmap(n[order] > 1))])

    return report


def _district(part: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The lists of a district's blocks, and all their different fingerprints."""
    lists = [golomb_decode(p) for p in part.column("prints").to_pylist()]
    return lists, np.unique(np.concatenate(lists))


def _owners(prints: np.ndarray, owners: int, bits: int) -> list[tuple[int, int, int]]:
    """Each owner with its stretch of the sorted fingerprints."""
    edges = np.searchsorted(prints, [(k << bits) // owners for k in range(owners + 1)])
    return [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]


def _send(owners: int, bits: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def send(key: tuple[pa.Scalar], part: pa.Table) -> pa.Table:
        _, prints = _district(part)
        return _rows(_LIST, [(k, key[0].as_py(), golomb_encode(prints[a:b] - (k << bits) // owners, (1 << bits) // owners)) for k, a, b in _owners(prints, owners, bits)])

    return send


def _meet(key: tuple[pa.Scalar], part: pa.Table) -> pa.Table:
    lists = [golomb_decode(p) for p in part.column("prints").to_pylist()]
    twice = _held_twice(lists)
    answers = [(district, key[0].as_py(), held) for district, own in zip(part.column("district").to_pylist(), lists, strict=True) if (held := _among(own, twice)).any()]
    return _rows(_ANSWER, [(district, owner, _bitmap(held)) for district, owner, held in answers])


def _suspects(owners: int, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def suspects(part: pa.Table, answers: pa.Table) -> pa.Table:
        lists, prints = _district(part)
        told = dict(zip(answers.column("owner").to_pylist(), answers.column("held").to_pylist(), strict=True))
        held = [prints[a:b][_marks(told[k], b - a)] for k, a, b in _owners(prints, owners, bits) if k in told]
        repeated = [own[_marks(bits, len(own))] for own, bits in zip(lists, part.column("repeated").to_pylist(), strict=True)]
        shared = np.unique(np.concatenate([*held, *repeated, _held_twice(lists)]))
        found = [(block, own[_among(own, shared)]) for block, own in zip(part.column("block").to_pylist(), lists, strict=True)]
        return _rows(_SUSPECTS, [(block, golomb_encode(own, 1 << bits)) for block, own in found if len(own)])

    return suspects


def _split(texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in the order of their blocks, the suspects of a block before its texts: one row for each text that is no
    suspect, and for each different suspect of a batch."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, suspects, count = -1, np.empty(0, np.int64), 0
        for batch in text_slices(batches):
            blocks = batch.column("block").to_numpy()
            for a, b in _stretches(blocks):
                part = batch.slice(a, b - a)
                if blocks[a] != block:
                    block, suspects, count = int(blocks[a]), np.empty(0, np.int64), 0
                told = part.column("prints").drop_null()
                if len(told):
                    suspects = golomb_decode(told[0].as_py())
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                out = _grouped(part, suspects, block, count, texts)
                count += out.num_rows
                yield out

    return split


def _stretches(blocks: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1))
    yield from zip(edges.tolist(), [*edges[1:].tolist(), len(blocks)], strict=True)


def _grouped(part: pa.RecordBatch, suspects: np.ndarray, block: int, count: int, texts: bool) -> pa.RecordBatch:
    """The rows of one block in a batch, those of equal suspects together, the largest doc_id first."""
    prints = part.column("fp").to_numpy()
    suspect = _among(prints, suspects)
    groups: dict[tuple, list[int]] = {}
    text = part.column("text").cast(pa.binary())
    for k in range(part.num_rows):
        groups.setdefault((int(prints[k]), text[k].as_py()) if suspect[k] else (k,), []).append(k)
    docs = part.column("item").field("row").field("doc_id").to_pylist() if len(groups) < part.num_rows else []
    order: list[int] = []
    offsets = [0]
    for rows in groups.values():
        if len(rows) > 1:
            rows.sort(key=lambda k: (True, docs[k]) if docs[k] is not None else (False,), reverse=True)
        order += rows
        offsets.append(len(order))
    first = pa.array([rows[0] for rows in groups.values()], pa.int64())
    doubtful = pa.array(suspect[first.to_numpy()])
    kept = part.column("text").take(first)
    columns = {
        "home": pa.array((block << 32) + count + np.arange(len(groups))),
        "fp": part.column("fp").take(first),
        "sha": part.column("sha").take(first),
        "suspect": doubtful,
        "items": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), part.column("item").take(pa.array(order, pa.int64()))),
        "text": kept if texts else pa.array([t if s else None for t, s in zip(kept.to_pylist(), doubtful.to_pylist(), strict=True)], pa.string()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def exact_groups(docs: DataFrame, texts: bool = False, block_bytes: int = 16 << 20, block_rows: int = 1 << 18, owner_rows: int = 1 << 21, bits: int = BITS) -> DataFrame:
    """`docs` (doc_id, text, ...) as row (struct of all columns but text), keep_id, group_size, kept and text_sha256; with
    `texts` also text, null where it was null. Blocks hold about `block_bytes` of text and `block_rows` rows, owners and
    districts about `owner_rows` fingerprints of `bits` bits."""
    spark = docs.sparkSession
    limit_batches(spark)
    text = F.coalesce("text", F.lit(""))
    fp = F.xxhash64(text).bitwiseAND(F.lit((1 << bits) - 1))
    item = F.struct(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), F.col("text").isNull().alias("absent"))
    read = docs.select(F.xxhash64("doc_id", fp).alias("deal"), fp.alias("fp"), text.alias("text"), item.alias("item"))
    prints = materialise(read.select("deal", "fp", F.octet_length("text").alias("size")))
    size, count = prints.agg(F.sum("size"), F.count("*")).first()
    blocks = max(1, math.ceil((size or 0) / block_bytes), math.ceil(count / block_rows))
    owners = max(8, math.ceil(count / owner_rows))
    block = F.pmod("deal", F.lit(blocks)).alias("block")

    # the exchange of fingerprints
    distinct = prints.select(block, "fp").groupBy("block", "fp").agg(F.count("*").alias("n"))
    reports = distinct.groupBy("block").applyInArrow(_report(owners, bits), _REPORT).groupBy("district")
    answers = reports.applyInArrow(_send(owners, bits), _LIST).groupBy("owner").applyInArrow(_meet, _ANSWER)
    suspects = reports.cogroup(answers.groupBy("district")).applyInArrow(_suspects(owners, bits), _SUSPECTS)

    # the texts, each block behind its suspects
    dealt = read.select(block, F.lit(None).cast("binary").alias("prints"), "fp", F.sha2("text", 256).alias("sha"), "text", "item")
    told = suspects.select("block", "prints", *[F.lit(None).cast(dealt.schema[c].dataType).alias(c) for c in dealt.columns[2:]])
    ordered = dealt.unionByName(told).repartition("block").sortWithinPartitions("block", F.col("prints").isNull())
    kind = dealt.schema["item"].dataType.simpleString()
    found = materialise(ordered.mapInArrow(_split(texts), f"home long, fp long, sha string, suspect boolean, items array<{kind}>, text string"))

    # suspects by their bytes
    largest = F.expr("array_max(transform(items, x -> x.row.doc_id))")
    held = found.where("suspect").select("fp", "text", "home", largest.alias("largest"), F.size("items").alias("n"))
    # equal texts have equal digests, which bring the answer back
    groups = held.groupBy("fp", "text").agg(F.max("largest").alias("keep_id"), F.coalesce(F.max_by("home", "largest"), F.min("home")).alias("keeper"), F.sum("n").alias("group_size"))
    groups = materialise(groups.select("fp", F.sha2("text", 256).alias("sha"), "keep_id", "keeper", "group_size"))

    def result(df: DataFrame, at: Column, keep: Column, size: Column, kept: Column) -> DataFrame:
        own = [F.when(~at["absent"], F.col("text")).alias("text")] if texts else []
        return df.select(at["row"].alias("row"), keep.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"), *own)

    carried = ["text"] if texts else []
    alone = found.where("not suspect").select(F.col("items")[0].alias("item"), "sha", *carried)
    many = found.where("suspect").join(groups, ["fp", "sha"]).select("*", F.posexplode("items").alias("pos", "item"))
    item = F.col("item")
    return result(alone, item, item["row"]["doc_id"], F.lit(1), F.lit(True)).unionByName(
        result(many, item, F.col("keep_id"), F.col("group_size"), (F.col("home") == F.col("keeper")) & (F.col("pos") == 0))
    )


def remove_exact_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of equal texts, that with the largest doc_id."""
    kept = exact_groups(docs, texts=True).where("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
