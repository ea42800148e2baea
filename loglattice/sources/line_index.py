"""Stored lines with an index of trigrams, so that a search by regular expression reads few of them.

Lines are stored in blocks of consecutive ones, a folder each. The index has a row for each block and each three bytes
in a row that occur in it (A-Z as a-z), sorted by these. Of a regular expression the texts that every match contains
are worked out, for each of its alternatives; blocks that lack a trigram of all alternatives are not read.
An expression of which nothing is known is sought in all blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 64 << 20
_MOST = 64


def write_indexed(lines: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> None:
    """Stores lines (file_name, line_no, content) in blocks of about `block_bytes`, with their index."""
    size = lines.agg(F.sum(F.octet_length("content") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    ranged = lines.select("file_name", F.col("line_no").cast("long").alias("line_no"), "content").repartitionByRange(blocks, "file_name", "line_no").sortWithinPartitions("file_name", "line_no")
    ranged.withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(f"{path}/lines")
    stored = lines.sparkSession.read.parquet(f"{path}/lines").select("block", "content")
    found = stored.mapInArrow(_trigrams, "block int, trigram int").distinct()
    found.repartitionByRange("trigram").sortWithinPartitions("trigram", "block").write.parquet(f"{path}/trigrams")


def _numbers(text: bytes) -> np.ndarray:
    """The different trigrams of a text as numbers."""
    data = np.frombuffer(text.lower(), np.uint8).astype(np.int32)
    return np.unique(data[:-2] << 16 | data[1:-1] << 8 | data[2:]) if len(data) > 2 else np.empty(0, np.int32)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's different trigrams, once a batch; a line feed ends a line, and no trigram of an expression has one."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for block in np.unique(blocks).tolist():
            held = batch.column("content").filter(pa.array(blocks == block)).cast(pa.binary()).to_pylist()
            found = _numbers(b"\n".join(x for x in held if x))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block, np.int32)), pa.array(found)], ["block", "trigram"])


def required_texts(pattern: str) -> list[set[str]]:
    """For each alternative of a regular expression the texts that all of its matches contain; [set()] if nothing is known.
    What may differ between notations of regular expressions counts as unknown."""
    if "\\0" in pattern:
        return [set()]
    try:
        parsed = _parser.parse(pattern)
    except (_parser.error, OverflowError, RecursionError):
        return [set()]
    return [set()] if parsed.state.flags & _parser.SRE_FLAG_VERBOSE else _texts(parsed)


def _texts(parsed) -> list[set[str]]:  # noqa: ANN001
    ways, run = [set()], ""

    def also(more: list[set[str]]) -> None:
        nonlocal ways
        if len(ways) * len(more) <= _MOST:
            ways = [a | b for a in ways for b in more]

    for kind, value in parsed:
        if kind is op.LITERAL and value != 10:
            run += chr(value)
            continue
        also([{run}] if run else [set()])
        run = ""
        if kind is op.SUBPATTERN:
            also(_texts(value[3]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            also(_texts(value[2]))
        elif kind is op.ATOMIC_GROUP:
            also(_texts(value))
        elif kind is op.BRANCH:
            also([way for part in value[1] for way in _texts(part)])
    also([{run}] if run else [set()])
    return ways


def candidate_blocks(spark: SparkSession, path: str, pattern: str) -> list[int] | None:
    """The blocks that may have a match, or None for all. One number for each block of text comes to the driver."""
    ways = [sorted({n for text in way for n in _numbers(text.encode()).tolist()}) for way in required_texts(pattern)]
    if any(not way for way in ways):
        return None
    asked = sorted({n for way in ways for n in way})
    index = spark.read.parquet(f"{path}/trigrams").where(F.col("trigram").isin(asked))
    held = index.groupBy("block").agg(F.collect_set("trigram").alias("held"))
    enough = F.lit(False)
    for way in ways:
        enough = enough | (F.size(F.array_intersect("held", F.array(*map(F.lit, way)))) == len(way))
    return sorted(r.block for r in held.where(enough).select("block").collect())


def grep_indexed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Stored lines (file_name, line_no, content) that a regular expression finds something in; folders of other blocks than
    the candidates are not listed."""
    lines = spark.read.parquet(f"{path}/lines")
    blocks = candidate_blocks(spark, path, pattern)
    chosen = lines if blocks is None else lines.where(F.col("block").isin(blocks))
    return chosen.where(F.col("content").rlike(pattern)).select("file_name", "line_no", "content")
