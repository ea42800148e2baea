"""Log entries from a stream of physical lines, with the lines of one open entry for each file as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loglattice.operators.multiline import MAX_ENTRY_BYTES, with_new_entry

_OUT = "file_name string, start_line long, end_line long, content string, late boolean, error string"
_OPEN = "start_line long, end_line long, bytes long, ever boolean, failed boolean"
_NAMES = ["file_name", "start_line", "end_line", "content", "late", "error"]


class _Merge(StatefulProcessor):
    """The lines of the open entry are a list that micro-batches add to; they are read once, when the entry ends."""

    def __init__(self, max_entry_bytes: int, idle_timeout: int | None, ordered: bool):
        self.most, self.idle, self.ordered = max_entry_bytes, idle_timeout, ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", "content string")
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, end, size, ever, failed = self._state()
        held: list[str] = []
        frames = rows if self.ordered else iter([pd.concat(list(rows)).sort_values("line_no", kind="stable")])
        for frame in frames:
            out: list[tuple] = []
            for number, text, is_new, ended, error in zip(*(frame[c].tolist() for c in ("line_no", "content", "is_new", "ended", "error")), strict=True):
                if failed:
                    continue
                if error is not None:
                    # nothing comes after an error, and the open entry is not complete
                    out.append((key[0], None, None, None, False, error))
                    failed, start, held = True, -1, []
                    self.lines.clear()
                    continue
                if ended:
                    if start >= 0:
                        out.append(self._closed(key, start, end, held))
                    # a file that goes on after its end begins anew
                    start, end, held, ever = -1, -1, [], False
                    continue
                if number <= end:
                    out.append((key[0], number, number, text, True, None))
                    continue
                ever = ever or is_new
                text = "" if text is None else text
                length = len(text.encode())
                if start >= 0 and (is_new or not ever or size + 1 + length > self.most):
                    out.append(self._closed(key, start, end, held))
                    start, held = -1, []
                size = length if start < 0 else size + 1 + length
                start = number if start < 0 else start
                held.append(text)
                end = number
            yield pd.DataFrame(out, columns=_NAMES)
        if held:
            self.lines.appendList([(x,) for x in held])
        self.open.update((start, end, size, ever, failed))
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if start >= 0:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, end, _, ever, failed = self._state()
        yield pd.DataFrame([self._closed(key, start, end, [])] if start >= 0 else [], columns=_NAMES)
        self.open.update((-1, end, 0, ever, failed))

    def close(self) -> None:
        pass

    def _state(self) -> tuple[int, int, int, bool, bool]:
        return tuple(self.open.get()) if self.open.exists() else (-1, -1, 0, False, False)

    def _closed(self, key: tuple, start: int, end: int, held: list[str]) -> tuple:
        before = [row[0] for row in self.lines.get()]
        if before:
            self.lines.clear()
        return key[0], start, end, "\n".join([*before, *held]), False, None


def stream_merge_multiline(stream: DataFrame, idle_timeout: int | None = 10_000, max_entry_bytes: int = MAX_ENTRY_BYTES, ordered: bool = False, **detector) -> DataFrame:
    """Entries of a stream of lines (file_name, line_no, content), as merge_multiline gives them, with `late` and `error`.

    A file's last entry stays open until a new line, a row with `ended` or an idle time of `idle_timeout` ms closes it; for
    such rows `ended` and `error` are columns of the stream where it has them (as tail_logs gives them; an end has a
    line number over all others). A row with `error` comes out as one, and nothing of its file after it; the
    entry that was open is not complete and does not come. A line at or below the last one seen of its file
    comes out alone, with late true.

    Lines of a micro-batch are put in order, so a task holds a file's lines of one micro-batch; with `ordered` (of each
    file lines come in order from one task, as from tail_logs) it holds those of the open entry only. State
    is kept by RocksDB, to which this sets the session's state store."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    extra = {"ended": F.lit(False), "error": F.lit(None).cast("string")}
    lines = stream.select("file_name", "line_no", "content", *[F.col(c) if c in stream.columns else value.alias(c) for c, value in extra.items()])
    marked = with_new_entry(lines, **detector)
    merge = _Merge(max_entry_bytes, idle_timeout, ordered)
    return marked.groupBy("file_name").transformWithStateInPandas(merge, outputStructType=_OUT, outputMode="Append", timeMode="None" if idle_timeout is None else "ProcessingTime")
