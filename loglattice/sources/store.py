"""The stored tables: log entries (append) and patterns (upsert), as Parquet under one folder.

Entries are stored by day, and their pattern is a column too, so a search reads the days it asks for and the scan
filters by pattern. Patterns, the next free id and the shapes of lines fed to template discovery are kept in versions
(see versions.py): an upsert that is broken off leaves the version before it, and writers at once lose nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.operators import templates
from loglattice.plans.stages import materialise
from loglattice.sources import versions

ENTRIES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("line_number", T.LongType()),
    T.StructField("end_line_number", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("raw", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
])
#: Worked out from the entry, for searches: what its label `pattern` is, and the day (the folder it is in).
_SEARCHED = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("day", T.DateType())])
BOUNDS = T.StructType([T.StructField("file", T.StringType()), T.StructField("day", T.DateType()), T.StructField("pattern", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("low", "high", "n"))])
PATTERN_COLUMNS = ("pattern_id", "pattern_type", "raw_pattern", "semantic_id", "description")
PATTERNS = T.StructType([T.StructField(c, T.StringType()) for c in PATTERN_COLUMNS])


def _patterns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PATTERNS).parquet(versions.latest(spark, f"{path}/patterns"))


def init_tables(spark: SparkSession, path: str) -> None:
    """Makes both tables where they are missing; what is there stays."""
    if not versions.exists(spark, f"{path}/log_entries"):
        spark.createDataFrame([], ENTRIES).write.mode("append").parquet(f"{path}/log_entries")

    def empty(last: str | None, staging: str) -> None:
        if last is None:
            spark.createDataFrame([], PATTERNS).write.parquet(staging)

    versions.commit(spark, f"{path}/patterns", empty)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Stored entries, with pattern and day."""
    return spark.read.schema(T.StructType(ENTRIES.fields + _SEARCHED.fields)).parquet(f"{path}/log_entries")


def with_ids(rows: DataFrame, first: int) -> DataFrame:
    """Adds id from `first` without gaps, partition after partition: only the partitions' counts are added up."""
    held = rows.withColumn("__part", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    counts = held.groupBy("__part").agg(F.count("*").alias("n"), F.min("__mid").alias("low"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__part", "low", F.coalesce(before, F.lit(0)).alias("before"))
    return held.join(starts, "__part").withColumn("id", F.col("__mid") - F.col("low") + F.col("before") + first).drop("__part", "__mid", "low", "before")


def _reserved(spark: SparkSession, path: str, count: int) -> int:
    """The first of `count` ids that no other writer gets."""
    first = 0

    def take(last: str | None, staging: str) -> str:
        nonlocal first
        first = int(versions.note_of(spark, last)) if last else (read_entries(spark, path).agg(F.max("id")).first()[0] or 0) + 1
        return str(first + count)

    versions.commit(spark, f"{path}/ids", take)
    return first


def append_logs(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Appends entries (line_number, end_line_number, timestamp, raw, labels), one or many. Their ids are reserved first, as
    one range, and follow those reserved before; an append that fails leaves a gap. `rows` must give the same rows each
    time it is read, as a table does."""
    first = _reserved(spark, path, rows.count())
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    named = with_ids(rows, first).select(*[labels.alias("labels") if f.name == "labels" else F.col(f.name).cast(f.dataType).alias(f.name) for f in ENTRIES])
    stored = named.withColumn("pattern", F.col("labels")["pattern"]).withColumn("day", F.to_date("timestamp"))
    # each file holds few days and patterns; jobs that write into one folder would clear each other's files
    staging = f"{path}/log_entries/_staging-{uuid.uuid4().hex}"
    stored.repartitionByRange("day", "pattern", "id").write.partitionBy("day").parquet(staging)
    # which lines and patterns each file holds, for searches that want the first lines only; files without it are read
    added = spark.read.schema(T.StructType(ENTRIES.fields + _SEARCHED.fields)).parquet(staging)
    bounds = added.groupBy(F.col("_metadata.file_name").alias("file"), "day", "pattern").agg(F.min("line_number").alias("low"), F.max("line_number").alias("high"), F.count("*").alias("n"))
    bounds = materialise(bounds)
    versions.move_files(spark, staging, f"{path}/log_entries")

    def add(last: str | None, staged: str) -> None:
        (spark.read.schema(BOUNDS).parquet(last).unionByName(bounds) if last else bounds).write.parquet(staged)

    versions.commit(spark, f"{path}/bounds", add)


def top_entries(spark: SparkSession, path: str, limit: int, pattern: str | None = None, from_day: str | None = None, to_day: str | None = None) -> DataFrame:
    """The first `limit` stored entries by line_number, then id, of a pattern and of days (both ends belong), if given.

    Only files that can hold one of them are opened: when groups of a file's lines with their greatest line number up to
    some line have `limit` lines together, files that begin after that line have none of the first."""
    wanted = F.lit(True)
    for bound, keep in ((pattern, F.col("pattern") == pattern), (from_day, F.col("day") >= F.lit(from_day).cast("date")), (to_day, F.col("day") <= F.lit(to_day).cast("date"))):
        wanted = wanted & keep if bound is not None else wanted
    stored = read_entries(spark, path)
    ordered = lambda df: df.where(wanted).orderBy("line_number", "id").limit(limit)
    last = versions.latest(spark, f"{path}/bounds")
    if last is None:
        return ordered(stored)
    bounds = spark.read.schema(BOUNDS).parquet(last)
    groups = bounds.where(wanted)
    # each group has a line at least, so `limit` groups are enough
    highs, held, reach = groups.orderBy("high").limit(limit).select("high", "n").collect(), 0, None
    for high, n in sorted(map(tuple, highs)):
        held += n
        if held >= limit:
            reach = high
            break
    if reach is None:
        return ordered(stored)
    beyond = {r.file for r in bounds.select("file").distinct().join(groups.where(F.col("low") <= reach).select("file").distinct(), "file", "left_anti").collect()}
    files = [f for f in stored.inputFiles() if f.rsplit("/", 1)[1] not in beyond]
    if not files:
        return ordered(stored)
    return ordered(spark.read.schema(stored.schema).option("basePath", f"{path}/log_entries").parquet(*files))


def upserted(patterns: DataFrame, batch: DataFrame, order_col: str) -> DataFrame:
    """Patterns with those of the batch over them; of a pattern's rows in the batch the last by `order_col` counts."""
    row = F.struct(*PATTERN_COLUMNS)
    newer = batch.groupBy("pattern_id").agg(F.max_by(row, order_col).alias("row")).select("row.*")
    return patterns.join(newer.select("pattern_id"), "pattern_id", "left_anti").select(*PATTERN_COLUMNS).unionByName(newer)


def upsert_patterns(spark: SparkSession, path: str, batch: DataFrame, order_col: str) -> None:
    """Writes the merged table as the next version. Where another writer was first, the batch goes over its version."""

    def merge(last: str | None, staging: str) -> None:
        upserted(spark.read.schema(PATTERNS).parquet(last), batch, order_col).write.parquet(staging)

    versions.commit(spark, f"{path}/patterns", merge)


def feed_lines(spark: SparkSession, path: str, lines: DataFrame, batch_id: int | None = None, delimiters: str = "|=,") -> None:
    """Adds lines (content) to the shapes kept under `path`; only these lines are read. A micro-batch that is fed again
    (`batch_id` not above the last one) changes nothing."""

    def merge(last: str | None, staging: str) -> str | None:
        before = versions.note_of(spark, last) if last else ""
        if batch_id is not None and before and int(before) >= batch_id:
            return None
        fresh = templates.line_shapes(lines, delimiters)
        merged = templates.merge_shapes(spark.read.schema(templates.SHAPES).parquet(last), fresh) if last else fresh
        merged.write.parquet(staging)
        return before if batch_id is None else str(batch_id)

    versions.commit(spark, f"{path}/shapes", merge)


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """The shapes of all lines fed so far, for discover_from_shapes."""
    return spark.read.schema(templates.SHAPES).parquet(versions.latest(spark, f"{path}/shapes"))


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """All patterns in the order of their ids; missing names and descriptions are empty texts."""
    return patterns_in_order(_patterns(spark, path))


def patterns_in_order(patterns: DataFrame) -> DataFrame:
    empty = F.lit("")
    return patterns.select("pattern_id", "pattern_type", "raw_pattern", F.coalesce("semantic_id", empty).alias("semantic_id"), F.coalesce("description", empty).alias("description")).orderBy("pattern_id")


def register_views(spark: SparkSession, path: str) -> None:
    """log_entries and patterns for SQL."""
    read_entries(spark, path).createOrReplaceTempView("log_entries")
    _patterns(spark, path).createOrReplaceTempView("patterns")
