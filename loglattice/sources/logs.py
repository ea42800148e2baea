"""Log files, ground truth and fixtures as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.functions.events import EVENT_SCHEMA, validate_events


def read_logs(spark: SparkSession, path: str, trim_trailing_blank: bool = True) -> DataFrame:
    """Lines (file_name, line_no, content) of a file or of the files in a folder, numbered from 1 in each file.

    Every split numbers its own lines; the counts of a file's earlier splits, a small table, are added, and the last line
    of a file that is not blank comes from the same table. The text is read for that table and for the lines; both readings
    see the same splits because nothing stands between them and the scan. Blank lines at the end of a file go."""
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"
    )
    filled = F.col("value").rlike(r"(?U)\S")
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max(F.when(filled, F.col("id"))).alias("filled"))
    of_file = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("n").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("before", before).withColumn("last", F.max(F.col("filled") - F.col("first") + F.col("before") + 1).over(Window.partitionBy("file")))
    line_no = (F.col("id") - F.col("first") + F.col("before") + 1).alias("line_no")
    numbered = lines.join(starts.select("file", "block", "first", "before", "last"), ["file", "block"]).select("file_name", line_no, F.regexp_replace("value", "\r\\z", "").alias("content"), "last")
    return (numbered.where(F.col("line_no") <= F.col("last")) if trim_trailing_blank else numbered).drop("last")


def stream_logs(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of lines (file_name, line_no, content) of the files that come into a folder, numbered from 1 in each file.
    A file is one record here, so this is for files that are rotated while they are small; it is read once, whole.
    Files that grow are for tail.tail_logs."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True)
    text = F.regexp_replace("value", r"(?U)\n\s*\z", "")
    lines = files.where(text.rlike(r"(?U)\S")).select(F.col("_metadata.file_name").alias("file_name"), F.posexplode(F.split(text, "\n", -1)).alias("at", "content"))
    return lines.select("file_name", (F.col("at") + 1).cast("long").alias("line_no"), F.regexp_replace("content", "\r\\z", "").alias("content"))


def list_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes of the files in a folder; sub-folders don't count."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes")).orderBy("file_name")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Content, EventTemplate and EventId of a CSV file with a header, whatever the order of its columns."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="FAILFAST")
    wanted = ["Content", "EventTemplate", "EventId"]
    if missing := [c for c in wanted if c not in rows.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows.select(*wanted)


FIXTURE_SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("source_format", T.StringType()), T.StructField("description", T.StringType()), T.StructField("event", EVENT_SCHEMA)])


def read_fixtures(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Event fixtures of the *.json files in a folder with their violations: one object a file, or without `whole_files`
    one a line."""
    rows = spark.read.option("multiLine", whole_files).option("pathGlobFilter", "*.json").schema(FIXTURE_SCHEMA).json(path)
    return validate_events(rows)
