"""What the training-data operators share: tables, shared storage, slices of text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.plans.stages import materialise, shared_dir, step

__all__ = ["BATCH_ROWS", "SLICE_BYTES", "crc_bucket", "limit_batches", "materialise", "pack_array", "shared_dir", "step", "table", "text_slices", "unpack_array", "utf8"]

#: Text bytes that a Python worker holds in its own arrays at a time; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def limit_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch, so that batches of whole texts stay small on both sides."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; of a null id: -1, which no fold uses."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice holds about `limit` bytes of `column`, and one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        groups = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.diff(groups, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True):
            yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pack_array(values: np.ndarray) -> bytes:
    """An array with its bytes in planes, compressed: high bytes of small numbers are zero."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_array(packed: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
