"""Entries against a sequential loop, on a table and on a stream."""

import random

import pytest
from pyspark.sql import functions as F

from loglattice.operators import multiline
from loglattice.sources.tail import tail_logs
from loglattice.streaming.multiline import stream_merge_multiline

STAMP = "2024-03-28 13:45:30 INFO"


def sequential(lines: list[str], cap: int) -> list[tuple[int, int, str]]:
    out, held, start, size, ever = [], [], 0, 0, False
    for k, line in enumerate(lines, 1):
        new = line.startswith("2024")
        ever = ever or new
        n = len(line.encode())
        if held and (not ever or new or size + 1 + n > cap):
            out.append((start, k - 1, "\n".join(held)))
            held = []
        if not held:
            start, size = k, n
        else:
            size += 1 + n
        held.append(line)
    return [*out, (start, len(lines), "\n".join(held))] if held else out


def files(seed: int) -> dict[str, list[str]]:
    random.seed(seed)
    make = lambda p: [f"{STAMP} {k}" if random.random() < p else random.choice(["", "  at é", "x" * random.randint(1, 60)]) for k in range(400)]
    return {"often": make(0.5), "seldom": make(0.02), "never": make(0.0), "one": [STAMP]}


def frame(spark, found: dict[str, list[str]]):
    rows = [(name, k, line) for name, lines in found.items() for k, line in enumerate(lines, 1)]
    random.shuffle(rows)
    return spark.createDataFrame(rows, "file_name string, line_no long, content string")


def check(spark, cap: int, seed: int):
    found = files(seed)
    got: dict[str, list] = {name: [] for name in found}
    for r in multiline.merge_multiline(frame(spark, found), max_entry_bytes=cap).collect():
        got[r.file_name].append((r.start_line, r.end_line, r.content))
    for name, lines in found.items():
        assert sorted(got[name]) == sequential(lines, cap), (name, cap)


def test_merge_equals_a_loop(spark, monkeypatch):
    check(spark, 65_536, 1)
    monkeypatch.setattr(multiline, "BUCKET_LINES", 64)
    check(spark, 65_536, 2)
    check(spark, 120, 3)


@pytest.mark.parametrize("cap", [0, 7, 60, 300])
def test_long_entries_in_small_blocks(spark, monkeypatch, cap):
    """Blocks of 100 bytes, buckets of 7 lines: chains of pieces cross many of both, and some lines are longer than blocks."""
    monkeypatch.setattr(multiline, "BLOCK_BYTES", 100)
    monkeypatch.setattr(multiline, "BUCKET_LINES", 7)
    random.seed(cap)
    found = {name: [STAMP, *("y" * random.choice([0, 0, 1, 3, 9, 30, 31, 700 if k == 40 else 2]) for k in range(n))] for name, n in (("a", 400), ("b", 57), ("c", 0))}
    got: dict[str, list] = {name: [] for name in found}
    for r in multiline.merge_multiline(frame(spark, found), max_entry_bytes=cap).collect():
        got[r.file_name].append((r.start_line, r.end_line, r.content))
    for name, lines in found.items():
        assert sorted(got[name]) == sequential(lines, cap), name


def test_cap_equal_and_one_over(spark):
    lines = {"f": [STAMP, "a" * 10, "b"]}
    cap = len(STAMP) + 11
    got = multiline.merge_multiline(frame(spark, lines), max_entry_bytes=cap).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in got] == [(1, 2), (3, 3)]
    assert multiline.merge_multiline(frame(spark, lines), max_entry_bytes=cap + 2).count() == 1


def test_empty_table(spark):
    assert multiline.merge_multiline(spark.createDataFrame([], "file_name string, line_no long, content string")).count() == 0


@pytest.mark.parametrize("ends", [True, False])
def test_stream_equals_table(spark, tmp_path, ends):
    """Three micro-batches; files with an end give their last entries too."""
    found = files(5)
    df = frame(spark, found).select("*", F.lit(False).alias("ended"))
    for part, rule in enumerate(("line_no <= 150", "line_no > 150 and line_no <= 300", "line_no > 300")):
        df.where(rule).coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
    if ends:
        marks = df.groupBy("file_name").agg((F.max("line_no") + 1).alias("line_no")).select("file_name", "line_no", F.lit(None).cast("string").alias("content"), F.lit(True).alias("ended"))
        marks.coalesce(1).write.parquet(f"{tmp_path}/in/part=3")
    stream = spark.readStream.schema("file_name string, line_no long, content string, ended boolean").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    merged = stream_merge_multiline(stream, idle_timeout=None)
    query = merged.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").where("not late").collect()
    want = {(name, *entry) for name, lines in found.items() for entry in (sequential(lines, 65_536) if ends else sequential(lines, 65_536)[:-1])}
    assert {(r.file_name, r.start_line, r.end_line, r.content) for r in rows} == want and len(rows) == len(want)


def _through(spark, stream, path, trigger=None):
    """What a query writes with all that is there now, going on from its checkpoint."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(**(trigger or {"availableNow": True})).start(f"{path}/out")
    if trigger:
        query.processAllAvailable()
        query.stop()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").collect()


def _append(path, data):
    path.parent.mkdir(exist_ok=True)
    with path.open("ab") as file:
        file.write(data)


def test_appended_lines_come_once(spark, tmp_path):
    a, b = tmp_path / "in" / "a.log", tmp_path / "in" / "b.log"
    lines = lambda final=False: tail_logs(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/log", final)
    _append(a, b"one\r\n\nthr")
    first = _through(spark, lines(), tmp_path)
    assert {(r.file_name, r.line_no, r.content) for r in first} == {("a.log", 1, "one"), ("a.log", 2, "")}
    _append(a, "ee é\nfour\n".encode())
    _append(b, b"other")
    second = _through(spark, lines(), tmp_path)
    assert sorted((r.line_no, r.content) for r in second) == [(1, "one"), (2, ""), (3, "three é"), (4, "four")]
    assert len(_through(spark, lines(), tmp_path)) == 4
    _append(a, b"five\n")
    third = _through(spark, lines(final=True), tmp_path)
    assert {(r.file_name, r.line_no, r.content, r.ended) for r in third if r.line_no > 4 or r.file_name == "b.log" or r.ended} == {
        ("a.log", 5, "five", False), ("a.log", 6, None, True), ("b.log", 1, "other", False), ("b.log", 2, None, True),
    }
    assert len(third) == 8 and not any(r.error for r in third)


def test_micro_batches_of_a_few_bytes(spark, tmp_path):
    want = {"a.log": [f"line {k} {'x' * (k % 7)}" for k in range(12)], "b.log": ["short"]}
    for name, held in want.items():
        _append(tmp_path / "in" / name, "\n".join(held).encode() + b"\n")
    stream = tail_logs(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/log", max_bytes_per_file=40)
    got = _through(spark, stream, tmp_path, {"processingTime": "0 seconds"})
    assert sorted((r.file_name, r.line_no, r.content) for r in got) == [(name, k + 1, x) for name, held in want.items() for k, x in enumerate(held)]
    _append(tmp_path / "in" / "b.log", b"and more than forty bytes that come after a restart\n")
    again = _through(spark, tail_logs(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/log", max_bytes_per_file=40), tmp_path, {"processingTime": "0 seconds"})
    assert sorted(r.line_no for r in again if r.file_name == "b.log") == [1, 2] and len(again) == len(got) + 1


def test_read_errors_end_their_file_alone(spark, tmp_path):
    a, b = tmp_path / "in" / "a.log", tmp_path / "in" / "b.log"

    def entries(final=False):
        lines = tail_logs(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/log", final)
        return _through(spark, stream_merge_multiline(lines, idle_timeout=None, ordered=True), tmp_path)

    _append(a, f"{STAMP} a\n more\n{STAMP} b\n".encode())
    _append(b, f"{STAMP} c\n".encode())
    entries()
    a.write_bytes(b"new")
    _append(b, b" d")
    got = entries(final=True)
    assert [(r.start_line, r.content) for r in got if r.file_name == "a.log" and not r.error] == [(1, f"{STAMP} a\n more")]
    assert [(r.start_line, r.end_line, r.content) for r in got if r.file_name == "b.log"] == [(1, 2, f"{STAMP} c\n d")]
    assert [r.file_name for r in got if r.error] == ["a.log"] and len(got) == 3
