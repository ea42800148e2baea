"""Files that grow, as a stream: lines that are appended come once, with their numbers, also after a restart.

The stream's offsets hold the bytes read of each file. How many lines these bytes have, and where the last one that is
not ended begins, stands in a line log beside the checkpoint: the task that reads a file up to some byte writes an
entry for that byte, and the task that goes on from there reads it. A task that runs again writes the same entry.

A micro-batch has one task for each file that has grown; it reads the new bytes a block at a time and gives lines in
their order. The driver only lists files. A line comes out when its end is there; with `final` the files are
taken to be complete: a last line without an end comes too, and then a row with `ended`.

A file that becomes shorter, or can't be read, gives one row with `error` and no more lines; other files go on.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_SCHEMA = "file_name string, line_no long, content string, ended boolean, error string"
_BLOCK = 8 << 20


@dataclass
class _Range(InputPartition):
    """The bytes of a file from `start` to `end`; `end` is -1 if the file has become shorter."""

    path: str
    start: int
    end: int
    ended: bool


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Tail(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.log = options["path"], options["log"]
        self.final = options.get("final", "false").lower() == "true"
        self.most = int(options.get("maxbytesperfile") or options.get("maxBytesPerFile") or 1 << 62)
        self.known: dict[str, dict] | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if not self.known:
            # after a restart: at most one micro-batch behind
            self.known = self._read(f"{_files(self.log)[1]}/offsets.json") or {}
        files, folder = _files(self.path)
        sizes = {f.base_name: f.size for f in files.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.is_file and not f.base_name.startswith((".", "_"))}
        for name, size in sizes.items():
            at = self.known.get(name, {"at": 0, "ended": False})
            if at["ended"]:
                continue
            end = min(size, at["at"] + self.most)
            self.known[name] = {"at": -1, "ended": True} if size < at["at"] else {"at": end, "ended": self.final and end == size}
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        found = []
        self.known = self.known or {}
        for name, to in sorted(end.items()):
            since = start.get(name, {"at": 0, "ended": False})
            # what was planned before a restart is known, too
            if to["at"] > self.known.get(name, {"at": 0})["at"] >= 0:
                self.known[name] = to
            if since != to and since["at"] >= 0:
                found.append(_Range(name, since["at"], to["at"] if to["at"] >= since["at"] else -1, to["ended"]))
        return found

    def commit(self, end: dict) -> None:
        """Entries of the line log before the committed one are needed no more."""
        files, log = _files(self.log)
        self._write(log, "offsets", end)
        for name, to in end.items():
            folder = f"{log}/{_key(name)}"
            for entry in files.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
                if entry.base_name.removesuffix(".json").isdigit() and int(entry.base_name.removesuffix(".json")) < to["at"]:
                    files.delete_file(entry.path)

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        files, folder = _files(self.path)
        name, start, end = partition.path, partition.start, partition.end
        if end < 0:
            yield _rows(name, 0, [], error=f"{name} is shorter than the {start} bytes read of it")
            return
        entry = self._entry(name, start)
        if entry is None:
            return  # it could not be read before
        lines, at = entry["lines"], entry["open"]
        try:
            with files.open_input_file(f"{folder}/{name}") as file:
                file.seek(at)
                rest = b""
                while at < end:
                    block = file.read(min(_BLOCK, end - at))
                    if not block:
                        raise OSError(f"{name} ends at byte {at} and not at {end}")
                    at += len(block)
                    *whole, rest = (rest + block).split(b"\n")
                    if whole:
                        yield _rows(name, lines + 1, whole)
                        lines += len(whole)
        except OSError as e:
            yield _rows(name, 0, [], error=str(e))
            return
        if partition.ended:
            if rest:
                lines += 1
                yield _rows(name, lines, [rest])
            yield _rows(name, lines + 1, [], ended=True)
        self._write(f"{_files(self.log)[1]}/{_key(name)}", str(end), {"lines": lines, "open": end - len(rest)})

    def _entry(self, name: str, at: int) -> dict | None:
        if not at:
            return {"lines": 0, "open": 0}
        return self._read(f"{_files(self.log)[1]}/{_key(name)}/{at}.json")

    def _read(self, path: str) -> dict | None:
        try:
            with _files(self.log)[0].open_input_stream(path) as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return None

    def _write(self, folder: str, name: str, entry: dict) -> None:
        """A whole file or none: written beside, then moved."""
        files = _files(self.log)[0]
        files.create_dir(folder, recursive=True)
        own = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(own) as file:
            file.write(json.dumps(entry).encode())
        files.move(own, f"{folder}/{name}.json")


def _key(name: str) -> str:
    return hashlib.sha1(name.encode()).hexdigest()


def _rows(name: str, first: int, lines: list[bytes], ended: bool = False, error: str | None = None) -> pa.RecordBatch:
    n = len(lines) if lines else 1
    content = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines] if lines else [None]
    columns = [pa.array([name] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(content, pa.string()), pa.array([ended] * n), pa.array([error] * n, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["file_name", "line_no", "content", "ended", "error"])


class LogTail(DataSource):
    """Options: path (folder), log (folder of the line log), final, maxBytesPerFile (for each micro-batch)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> _Tail:  # noqa: ANN001
        return _Tail(dict(self.options))


def tail_logs(spark: SparkSession, path: str, log: str, final: bool = False, max_bytes_per_file: int | None = None) -> DataFrame:
    """A stream of lines (file_name, line_no, content, ended, error) of the files in the folder `path`, from their first
    line on, as they grow. `log` is a folder for the line log, one for each query, beside its checkpoint. With `final` the
    files are complete, and their ends come as rows. `max_bytes_per_file` bounds a micro-batch (not with availableNow,
    which takes all that is there)."""
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format("log_tail").option("path", path).option("log", log).option("final", str(final).lower())
    if max_bytes_per_file:
        reader = reader.option("maxBytesPerFile", str(max_bytes_per_file))
    return reader.load()
