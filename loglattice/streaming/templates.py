"""Template discovery fed by a stream: only new lines are read, their shapes are merged into those of all lines before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loglattice.sources import store


def feed_stream(lines: DataFrame, path: str, checkpoint: str, delimiters: str = "|=,", **trigger) -> StreamingQuery:
    """Starts to feed a stream of lines (content, ...) to the shapes under `path`; each line counts once, also after a
    restart from `checkpoint`. Templates come from discover_from_shapes(read_shapes(...)) at any time."""

    def feed(batch: DataFrame, batch_id: int) -> None:
        store.feed_lines(batch.sparkSession, path, batch.select("content"), batch_id, delimiters)

    return lines.writeStream.foreachBatch(feed).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
