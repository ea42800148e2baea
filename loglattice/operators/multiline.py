"""Log entries from physical lines: an entry begins at a line with a timestamp and holds the lines up to the next."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglattice.functions.boundary import is_new_entry
from loglattice.plans.stages import materialise

#: Lines of a file that one window holds; a longer file is many windows.
BUCKET_LINES = 100_000
MAX_ENTRY_BYTES = 65_536


def with_new_entry(df: DataFrame, first_line_regex: str | None = None, max_scan_bytes: int = 60, threshold: float = 0.5) -> DataFrame:
    """Adds is_new to lines (file_name, line_no, content)."""
    return df.withColumn("is_new", is_new_entry(F.col("content"), first_line_regex, max_scan_bytes, threshold))


def entry_starts(marked: DataFrame) -> DataFrame:
    """Adds entry_start to lines with is_new: the last new line up to each; lines before a file's first are their own.

    A file is cut into buckets of lines. Only each bucket's last new line is looked up from earlier buckets, so no
    window holds a whole file."""
    held = marked.withColumn("bucket", F.expr(f"line_no div {BUCKET_LINES}"))
    new_line = F.when(F.col("is_new"), F.col("line_no"))
    buckets = held.groupBy("file_name", "bucket").agg(F.max(new_line).alias("last_new"))
    before = Window.partitionBy("file_name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("file_name", "bucket", F.max("last_new").over(before).alias("carry"))
    within = Window.partitionBy("file_name", "bucket").orderBy("line_no")
    local = F.max(new_line).over(within)
    return held.withColumn("local", local).join(carried, ["file_name", "bucket"]).withColumn("entry_start", F.coalesce("local", "carry", "line_no")).drop("bucket", "local", "carry")


#: Bytes of a long entry that one task holds the numbers of, at least.
BLOCK_BYTES = 16 << 20
_ENTRY = ["file_name", "entry_start"]


def _with_offsets(lines: DataFrame) -> DataFrame:
    """Adds at, the bytes of an entry before each of its lines (each with a line feed). Sums of buckets of lines are added
    up, so no window holds an entry."""
    held = lines.withColumn("bucket", F.expr(f"line_no div {BUCKET_LINES}"))
    size = F.col("bytes") + 1
    before = Window.partitionBy(*_ENTRY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(*_ENTRY, "bucket").agg(F.sum(size).alias("size")).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    within = Window.partitionBy(*_ENTRY, "bucket").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumn("local", F.coalesce(F.sum(size).over(within), F.lit(0)))
    joined = local.join(sums.drop("size"), [*_ENTRY, "bucket"])
    return joined.select(*_ENTRY, "line_no", "bytes", (F.col("before") + F.col("local")).alias("at"))


def _breaks(part: pa.Table, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines of a block in order: their numbers, where they are, and where the piece ends that begins at each: with
    the last line whose end is no more than `limit` bytes on, or with its first."""
    part = part.sort_by("line_no")
    at = part.column("at").to_numpy()
    ends = at + part.column("bytes").to_numpy() + 1
    last = np.maximum(np.searchsorted(ends, at + limit, side="right") - 1, np.arange(len(at)))
    return part.column("line_no").to_numpy(), at, ends[last]


def _jumps(limit: int, block_bytes: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Where a chain of pieces that comes into a block at a line leaves it, for every line that a piece of an earlier block
    can end at."""

    def jump(key: tuple, part: pa.Table) -> pa.Table:
        own = pc.equal(part.column("block"), part.column("of"))
        begin = key[2].as_py() * block_bytes
        n = pc.sum(own).as_py() or 0
        _, at, ends = _breaks(part, limit)
        at, ends = at[:n], ends[:n]
        leave, to = ends, np.searchsorted(at, ends)
        while (inside := to < n).any():
            # every piece takes the way of the piece that follows it
            leave, to = np.where(inside, leave[np.minimum(to, n - 1)], leave), np.where(inside, to[np.minimum(to, n - 1)], to)
        into = np.flatnonzero((at - begin <= limit) | (np.arange(n) == 0))
        return pa.table([pa.array([key[0].as_py()] * len(into), pa.string()), pa.array([key[1].as_py()] * len(into), pa.int64()), pa.array(at[into], pa.int64()), pa.array(leave[into], pa.int64())], [*_ENTRY, "at", "leave"])

    return jump


def _starts(limit: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The lines of a block that pieces begin at, from the line that the chain comes in at."""

    def starts(key: tuple, part: pa.Table, into: pa.Table) -> pa.Table:
        found: list[int] = []
        if part.num_rows and into.num_rows:
            own = pc.sum(pc.equal(part.column("block"), part.column("of"))).as_py() or 0
            lines, at, ends = _breaks(part, limit)
            # the end of an entry may lie in its last block, too
            k = int(np.searchsorted(at[:own], pc.min(into.column("at")).as_py()))
            while k < own:
                found.append(int(lines[k]))
                k = int(np.searchsorted(at[:own], ends[k]))
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.string()), pa.array([key[1].as_py()] * len(found), pa.int64()), pa.array(found, pa.int64())], [*_ENTRY, "line_no"])

    return starts


def _cut_long(lines: DataFrame, max_entry_bytes: int) -> DataFrame:
    """Adds piece_start to the lines of entries over the limit: a line that would pass it begins a piece.

    Where a piece ends follows from the sums of bytes. Entries are cut into blocks of bytes; each block tells for
    every line that it can be entered at where the chain of pieces leaves it. The lines at which the blocks are entered
    are found by doubling these ways: two blocks at a time, four and so on, on a table of few rows a block. Then every
    block walks its own pieces."""
    limit = max_entry_bytes + 1
    block_bytes = max(BLOCK_BYTES, 2 * limit)
    block = lambda at: F.expr(f"{at} div {block_bytes}")
    placed = materialise(_with_offsets(lines.withColumn("line_no", F.col("line_no").cast("long"))).withColumn("of", block("at")))
    # a block also sees the lines that pieces of its own may reach
    reach = F.when(F.col("at") - F.col("of") * block_bytes <= 2 * limit, F.array("of", F.col("of") - 1)).otherwise(F.array("of"))
    seen = placed.withColumn("block", F.explode(reach)).where("block >= 0").repartition(*_ENTRY, "block")
    ways = materialise(seen.groupBy(*_ENTRY, "block").applyInArrow(_jumps(limit, block_bytes), "file_name string, entry_start long, at long, leave long"))
    steps = [ways]
    most = placed.agg(F.max("of")).first()[0] or 0
    while 1 << len(steps) <= most + 1:
        on = steps[-1].select(*_ENTRY, F.col("at").alias("leave"), F.col("leave").alias("on"))
        steps.append(materialise(steps[-1].join(on, [*_ENTRY, "leave"]).select(*_ENTRY, "at", F.col("on").alias("leave"))))
    entered = placed.select(*_ENTRY).distinct().withColumn("at", F.lit(0).cast("long"))
    for way in reversed(steps):
        further = entered.join(way, [*_ENTRY, "at"]).select(*_ENTRY, F.col("leave").alias("at"))
        entered = materialise(entered.unionByName(further))
    into = entered.withColumn("block", block("at"))
    starts = seen.groupBy(*_ENTRY, "block").cogroup(into.groupBy(*_ENTRY, "block")).applyInArrow(_starts(limit), "file_name string, entry_start long, line_no long")
    marked = placed.join(starts.withColumn("start", F.col("line_no")), [*_ENTRY, "line_no"], "left").withColumn("bucket", F.expr(f"line_no div {BUCKET_LINES}"))
    # the last start up to each line, bucket by bucket
    before = Window.partitionBy(*_ENTRY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(*_ENTRY, "bucket").agg(F.max("start").alias("last")).withColumn("carry", F.max("last").over(before)).drop("last")
    within = Window.partitionBy(*_ENTRY, "bucket").orderBy("line_no")
    found = marked.withColumn("local", F.max("start").over(within)).join(carried, [*_ENTRY, "bucket"])
    return found.select(*_ENTRY, "line_no", "bytes", F.coalesce("local", "carry").alias("piece_start"))


def merge_multiline(df: DataFrame, max_entry_bytes: int = MAX_ENTRY_BYTES, **detector) -> DataFrame:
    """Entries (file_name, start_line, end_line, content) of lines (file_name, line_no, content).

    Where entries begin is found on a table of numbers, without the text. The text is dealt by bucket of lines once, and
    grouped where it then is; only entries that reach into another bucket are gathered from several."""
    lines = df.select("file_name", F.col("line_no").cast("long").alias("line_no"), "content")
    marked = with_new_entry(lines, **detector).select("file_name", "line_no", "is_new", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("bytes"))
    pieces = piece_starts(materialise(marked), max_entry_bytes).groupBy("file_name", F.col("piece_start").alias("start")).agg(F.max("line_no").alias("end"))
    return _joined(lines, materialise(pieces))


def piece_starts(marked: DataFrame, max_entry_bytes: int = MAX_ENTRY_BYTES) -> DataFrame:
    """file_name, line_no and piece_start (the first line of its entry, or of its part of a long one) of lines
    (file_name, line_no, is_new, bytes)."""
    columns = ["file_name", "entry_start", "line_no", "bytes"]
    started = materialise(entry_starts(marked).select(*columns))
    sizes = started.groupBy("file_name", "entry_start").agg((F.sum(F.col("bytes") + 1) - 1).alias("total"))
    over = materialise(sizes.where(F.col("total") > max_entry_bytes).select("file_name", "entry_start"))
    if over.isEmpty():
        return started.select("file_name", "line_no", F.col("entry_start").alias("piece_start"))
    long = _cut_long(started.join(over, ["file_name", "entry_start"], "left_semi").select(*columns), max_entry_bytes)
    short = started.join(over, ["file_name", "entry_start"], "left_anti").select(*columns, F.col("entry_start").alias("piece_start"))
    return short.unionByName(long).select("file_name", "line_no", "piece_start")


def _joined(lines: DataFrame, pieces: DataFrame) -> DataFrame:
    """The lines of each piece (file_name, start, end) as one row."""
    bucket = lambda c: F.expr(f"{c} div {BUCKET_LINES}")
    # a piece is announced in every bucket that it has lines in, before the first of them
    told = pieces.withColumn("bucket", F.explode(F.sequence(bucket("start"), bucket("end"))))
    at = F.greatest(F.col("start"), F.col("bucket") * BUCKET_LINES - 1)
    piece = F.struct("start", "end", (bucket("start") != bucket("end")).alias("crosses"))
    told = told.select("file_name", "bucket", at.alias("line_no"), F.lit(None).cast("string").alias("content"), piece.alias("piece"))
    rows = lines.select("file_name", bucket("line_no").alias("bucket"), "line_no", "content", F.lit(None).cast(told.schema["piece"].dataType).alias("piece")).unionByName(told)
    before = Window.partitionBy("file_name", "bucket").orderBy("line_no", F.col("piece").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = rows.withColumn("of", F.last("piece", ignorenulls=True).over(before)).where("piece is null").select("file_name", "bucket", "line_no", "content", "of.*")

    def grouped(part: DataFrame, *keys: str) -> DataFrame:
        texts = F.array_sort(F.collect_list(F.struct("line_no", "content")))
        found = part.groupBy("file_name", *keys, "start", "end").agg(texts.alias("lines"))
        text = F.array_join(F.transform("lines", lambda x: x["content"]), "\n")
        return found.select("file_name", F.col("start").alias("start_line"), F.col("end").alias("end_line"), text.alias("content"))

    whole = grouped(held.where("not crosses"), "bucket")
    return whole if pieces.where(bucket("start") != bucket("end")).isEmpty() else whole.unionByName(grouped(held.where("crosses")))
