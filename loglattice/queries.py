"""One query for each operator, over log lines that are derived from the given tables by expressions.

`events` become single lines in five formats (file app-k.log for user_id % 7 = k, line number event_id + 1);
`documents` become multi-line entries: a header line with a timestamp and the lines of the text, one file a source.
ORACLES holds DuckDB SQL for the same results, written from the tables and not from the lines wherever the
expected result is known from them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglattice.functions import boundary, events, text
from loglattice.operators import labels, multiline, reports, search, templates
from loglattice.plans.stages import materialise, shared_dir, spread
from loglattice.plans.workspace import KEYS, Workspace, build_workspace
from loglattice.sources import store
from loglattice.sources.line_index import grep_indexed, write_indexed
from loglattice.sources.logs import list_inputs, read_fixtures, read_ground_truth, read_logs
from loglattice.sources.tail import tail_logs
from loglattice.streaming.multiline import stream_merge_multiline
from loglattice.streaming.templates import feed_stream

_LINE = """
    CASE event_id % 5
    WHEN 0 THEN concat('{"ts":"', day, 'T', clock, 'Z","level":"', level, '","service":"svc-', user_id % 5, '","n":', event_id, ',"ok":true,"message":"user ', user_id, ' ', event_type, '","gone":null}')
    WHEN 1 THEN concat('ts=', day, 'T', clock, 'Z level=', level, ' service_name=svc-', user_id % 5, ' n=', event_id, ' msg="user ', user_id, ' did ~"', event_type, '~""')
    WHEN 2 THEN concat('timestamp=', day, 'T', clock, ' severity=', level, ' service_name=svc-', user_id % 5, ' environment=PROD n=', event_id, ' event=', event_type)
    WHEN 3 THEN concat(day, ' ', clock, CASE WHEN event_id % 2 = 0 THEN ' [' ELSE ',123 ' END, level, CASE WHEN event_id % 2 = 0 THEN ']' ELSE '' END, ' user ', user_id, ' did ', event_type, ' in ', event_id % 97, ' ms')
    ELSE CASE event_id % 3 WHEN 0 THEN concat(level, ': worker ', user_id, ' saw ', event_type) WHEN 1 THEN concat('a=1 user ', user_id, ' saw ', event_type, ' timeout') ELSE concat('note="', event_type, ' by ', user_id) END
    END
"""
_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'info' WHEN 'view' THEN 'WARNING' WHEN 'click' THEN 'debug' ELSE 'notice' END"


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_name, line_no, content, and the event's ts as timestamp."""
    rows = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    named = rows.select("event_id", "user_id", "event_type", "ts", day.alias("day"), clock.alias("clock"), F.expr(_LEVEL).alias("level"))
    return named.select(F.expr("concat('app-', user_id % 7, '.log')").alias("file_name"), (F.col("event_id") + 1).alias("line_no"), F.expr(_LINE.replace("~", "\\\\")).alias("content"), "ts", "user_id", "event_id")


_SQL_LINES = f"""
    WITH e AS (SELECT event_id, user_id, event_type, ts, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS clock, {_LEVEL} AS level FROM events),
    lines AS (SELECT concat('app-', user_id % 7, '.log') AS file_name, event_id + 1 AS line_no, {_LINE.replace("~", chr(92))} AS content, ts, user_id, event_id, event_type, level FROM e)
"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents after a header each: file_name (the source), line_no, content, doc_id. A document owns a
    stretch of 1,000,000 line numbers, which is more lines than a document has; its text ends at no blank line."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("text", F.coalesce("text", F.lit("")))
    header = F.concat(F.lit("2024-01-01 00:00:00 INFO doc "), F.col("doc_id").cast("string"))
    lines = docs.select("doc_id", "source", F.posexplode(F.concat(F.array(header), F.split("text", "\n", -1))).alias("k", "content"))
    return lines.select(F.col("source").alias("file_name"), (F.col("doc_id") * 1_000_000 + F.col("k") + 1).alias("line_no"), "content", "doc_id")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select("file_name", F.col("line_no").alias("start_line"), "content", "ts")


def _workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    # some templates have no label, so that their lines count as unmatched
    entries = materialise(_entries(spark, sf_dir).select("file_name", "start_line", "content"))
    found = materialise(templates.discover_templates(entries, absorb=False))
    given = labels.default_labels(found).where("semantic_id not like '%timeout%'")
    labelled = materialise(labels.apply_labels(found, given))
    return Workspace(entries, found, labelled, materialise(templates.match_templates(entries, found, KEYS)))


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries as stored, and their patterns: every event type is one, but for `signup`, which has no pattern row."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    named = F.create_map(F.lit("pattern"), F.concat(F.lit("user <*> did "), kind), F.lit("pattern_id"), F.concat(F.lit("p-"), kind))
    entries = rows.select(
        (F.col("event_id") + 1).alias("id"), (F.col("event_id") % 1000 + 1).alias("line_number"), (F.col("event_id") % 1000 + 1).alias("end_line_number"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("user "), "user_id", F.lit(" did "), kind).alias("raw"), F.when(F.col("event_id") % 10 == 9, F.create_map().cast("map<string,string>")).otherwise(named).alias("labels"),
    )
    patterns = rows.where("event_type <> 'signup'").select(kind).distinct().select(
        F.concat(F.lit("p-"), kind).alias("pattern_id"), F.lit("drain").alias("pattern_type"), F.concat(F.lit("user <*> did "), kind).alias("raw_pattern"), F.when(kind != "view", kind).alias("semantic_id"), F.lit(None).cast("string").alias("description")
    )
    return entries, patterns


_SQL_STORED = """
    WITH entries AS (SELECT event_id + 1 AS id, event_id % 1000 + 1 AS line_number, ts, concat('user ', user_id, ' did ', event_type) AS raw,
        CASE WHEN event_id % 10 <> 9 THEN concat('user <*> did ', event_type) END AS pattern, CASE WHEN event_id % 10 <> 9 THEN concat('p-', event_type) END AS pattern_id FROM events),
    patterns AS (SELECT DISTINCT concat('p-', event_type) AS pattern_id, 'drain' AS pattern_type, concat('user <*> did ', event_type) AS raw_pattern,
        CASE WHEN event_type <> 'view' THEN event_type END AS semantic_id, CAST(NULL AS VARCHAR) AS description FROM events WHERE event_type <> 'signup')
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


# Scans, numbering, order.


def _written_lines(spark: SparkSession, sf_dir: str, suffix: str = "") -> str:
    """The event lines, each after its event_id and a tab, as text files in the shared folder, one file a task, in the
    order of event_id; their folder."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines = event_lines(spark, sf_dir).sortWithinPartitions("event_id")
    lines.select(F.concat(F.col("event_id").cast("string"), F.lit("\t"), "content", F.lit(suffix)).alias("value")).write.text(path)
    return path


@query("o01_line_numbers", _SQL_LINES + " SELECT event_id, content, true AS numbered FROM lines")
def o01_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line, and whether its number is its place in its file, which the ids that the lines begin with tell."""
    lines = read_logs(spark, _written_lines(spark, sf_dir, "\r"))
    event_id = F.split("content", "\t", 2)[0].cast("long")
    place = F.row_number().over(Window.partitionBy("file_name").orderBy("event_id"))
    held = lines.select("file_name", "line_no", event_id.alias("event_id"), F.split("content", "\t", 2)[1].alias("content"))
    return held.select("event_id", "content", (F.col("line_no") == place).alias("numbered"))


def _streamed(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """What a query has written when it has gone on from its checkpoint through all that is there."""
    running = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start(f"{path}/out")
    running.awaitTermination()
    return spark.read.parquet(f"{path}/out")


#: Lines of each file that a query writes by itself.
_FILE_LINES = 2000


def _write_growing(lines: DataFrame, path: str, share: float) -> None:
    """Files app-k.log of the lines (event_id, content) of 2,000 ids each, in their order: the first `share` of a file's
    bytes, cut in any line's middle; a larger share makes the files longer, as if lines were appended."""

    def write(part: pa.Table) -> pa.Table:
        held = part.sort_by("event_id")
        text = b"".join(x + b"\n" for x in held.column("content").cast(pa.binary()).to_pylist())
        files, folder = pafs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/app-{held.column('event_id')[0].as_py() // _FILE_LINES}.log") as file:
            # the last line has no end
            file.write(text[: int(len(text) * share)] if share < 1 else text[:-1])
        return pa.table({"n": pa.array([len(text)], pa.int64())})

    lines.groupBy(F.expr(f"event_id div {_FILE_LINES}")).applyInArrow(write, "n long").agg(F.sum("n")).collect()


@query("o01_tail", _SQL_LINES + " SELECT event_id, content, true AS numbered FROM lines")
def o01_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event lines in files that grow between the runs of a stream, which goes on from its checkpoint each time; whether
    each line came with its place in its file as its number."""
    path = f"{shared_dir(spark)}/tail-{uuid.uuid4().hex}"
    lines = materialise(event_lines(spark, sf_dir).select("event_id", F.concat(F.col("event_id").cast("string"), F.lit("\t"), "content").alias("content")))
    for share in (0.4, 0.8, 1.0):
        _write_growing(lines, f"{path}/in", share)
        read = _streamed(spark, tail_logs(spark, f"{path}/in", f"{path}/log", final=share == 1.0), path)
    held = read.where("not ended").select("file_name", "line_no", F.split("content", "\t", 2).alias("x")).select("file_name", "line_no", F.col("x")[0].cast("long").alias("event_id"), F.col("x")[1].alias("content"))
    place = F.row_number().over(Window.partitionBy("file_name").orderBy("event_id"))
    return held.select("event_id", "content", (F.col("line_no") == place).alias("numbered"))


@query("o02_multi_file_scan", _SQL_LINES + " SELECT concat(event_id, chr(9), content) AS content, count(*) AS n FROM lines GROUP BY ALL")
def o02_multi_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_logs(spark, _written_lines(spark, sf_dir)).groupBy("content").agg(F.count("*").alias("n"))


@query("o03_list_inputs", _SQL_LINES + f" SELECT concat('app-', event_id // {_FILE_LINES}, '.log') AS file_name, CAST(sum(strlen(content) + 1) - 1 AS BIGINT) AS bytes FROM lines GROUP BY 1")
def o03_list_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/inputs-{uuid.uuid4().hex}"
    _write_growing(event_lines(spark, sf_dir).select("event_id", "content"), path, 1.0)
    return list_inputs(spark, path)


@query("o04_entry_order", _SQL_LINES + " SELECT file_name, min(line_no) AS first_line, max(line_no) AS last_line, arg_min(content, line_no) AS first_content FROM lines GROUP BY file_name")
def o04_entry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir)
    return lines.groupBy("file_name").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.min_by("content", "line_no").alias("first_content"))


@query("o05_ground_truth", "SELECT concat('user ', user_id, ' said \"', event_type, '\", twice') AS Content, concat('user <*> said ', event_type) AS EventTemplate, concat('E', event_id) AS EventId FROM events")
def o05_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/truth-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows.select(
        F.concat(F.lit("E"), "event_id").alias("EventId"), "user_id", F.concat(F.lit("user <*> said "), "event_type").alias("EventTemplate"), F.concat(F.lit("user "), "user_id", F.lit(' said "'), "event_type", F.lit('", twice')).alias("Content")
    ).write.csv(path, header=True, escape='"')
    return read_ground_truth(spark, path)


# Of views the truth tells users apart, and templates don't; clicks have one true template, and lines of two lengths.
@query("o05_template_accuracy", "SELECT count(*) AS entries, count(*) FILTER (event_type NOT IN ('view', 'click')) AS correct FROM events")
def o05_template_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates discovered from the contents of the ground truth, held against its own: some groups are split by it, some
    joined, and the others the same."""
    number = F.substring("EventId", 2, 20).cast("long")
    view, click = F.col("EventTemplate").endswith("view"), F.col("EventTemplate").endswith("click")
    told = F.when(view, F.concat("EventTemplate", (number % 2).cast("string"))).otherwise(F.col("EventTemplate"))
    content = F.when(click & (number % 2 == 0), F.concat("Content", F.lit(" and more"))).otherwise(F.col("Content"))
    truth = materialise(o05_ground_truth(spark, sf_dir).select("EventId", told.alias("EventTemplate"), content.alias("content")))
    found = materialise(templates.discover_templates(truth))
    return templates.template_accuracy(templates.match_templates(truth, found, ["EventId"])).select("entries", "correct")


@query("o06_fixtures", "SELECT concat('f-', event_id) AS name, CASE WHEN event_id % 4 = 0 THEN 'source_format is not supported' ELSE '' END AS violations, event_type AS text, epoch_us(ts) AS ts_us FROM events")
def o06_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/fixtures-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    # JSON takes time stamps of microseconds as text
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    event = F.struct(stamp.alias("ts"), F.col("event_type").alias("text"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("attrs"), F.struct(F.lit("").alias("pattern"), F.lit("").alias("entity")).alias("inferred"))
    rows.select(F.concat(F.lit("f-"), "event_id").alias("name"), F.when(F.col("event_id") % 4 == 0, "grok").otherwise("json").alias("source_format"), F.lit("made").alias("description"), event.alias("event")).write.json(path)
    checked = read_fixtures(spark, path, whole_files=False)
    return checked.select("name", F.array_join("violations", "|").alias("violations"), F.col("event.text").alias("text"), F.unix_micros("event.ts").alias("ts_us"))


def _stored_entries(spark: SparkSession, sf_dir: str, *parts: Column) -> str:
    """The folder of tables with the entries, one append for each part. The text of an entry ends in its event's id, as
    the store gives ids of its own."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    entries, _ = _stored(spark, sf_dir)
    store.init_tables(spark, path)
    for part in parts or (F.lit(True),):
        store.append_logs(spark, path, entries.where(part).withColumn("raw", F.concat("raw", F.lit(" #"), "id")).drop("id"))
    return path


def _stored_tables(spark: SparkSession, sf_dir: str) -> str:
    """Tables made, filled by two appends and two upserts; their folder."""
    half = F.col("id") % 2 == 0
    path = _stored_entries(spark, sf_dir, half, ~half)
    patterns = _stored(spark, sf_dir)[1]
    store.upsert_patterns(spark, path, patterns.withColumn("semantic_id", F.lit("old")).withColumn("at", F.lit(1)), "at")
    twice = patterns.withColumn("raw_pattern", F.lit("early")).withColumn("at", F.lit(1)).unionByName(patterns.withColumn("at", F.lit(2)))
    store.upsert_patterns(spark, path, twice, "at")
    return path


@query("o07_append", "SELECT count(*) AS n, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id, count(*) AS ids, CAST(sum(event_id % 1000 + 1) AS BIGINT) AS line_sum FROM events")
def o07_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store.read_entries(spark, _stored_tables(spark, sf_dir))
    return stored.agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_distinct("id").alias("ids"), F.sum("line_number").alias("line_sum"))


@query("o09_read_patterns", _SQL_STORED + " SELECT pattern_id, pattern_type, raw_pattern, coalesce(semantic_id, '') AS semantic_id, coalesce(description, '') AS description FROM patterns")
def o09_read_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_patterns(spark, _stored_tables(spark, sf_dir))


@query("o12_store_sql", _SQL_STORED + " SELECT p.raw_pattern, count(*) AS n, max(e.line_number) AS high FROM entries e JOIN patterns p USING (pattern_id) GROUP BY p.raw_pattern")
def o12_store_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    store.register_views(spark, _stored_tables(spark, sf_dir))
    return spark.sql("SELECT p.raw_pattern, count(*) AS n, max(e.line_number) AS high FROM log_entries e JOIN patterns p ON e.labels['pattern_id'] = p.pattern_id GROUP BY p.raw_pattern")


# Multi-line entries.


# Notations, and the classes that their runs have.
_NOTATIONS = (
    ("yyyy-MM-dd HH:mm:ss", "D4|-|D2|-|D2| |D2|:|D2|:|D2"), ("dd/MMM/yyyy:HH:mm:ss", "D2|/|MTH|/|D4|:|D2|:|D2|:|D2"), ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "D4|-|D2|-|D2|T|D2|:|D2|:|D2|.|D6|ZONE"),
    ("EEE, dd MMM yyyy HH:mm:ss", "DAY|,| |D2| |MTH| |D4| |D2|:|D2|:|D2"), ("yyyy/MM/dd'*'HH:mm:ss", "D4|/|D2|/|D2|*|D2|:|D2|:|D2"), ("yyyy-MM-dd hh:mm:ss a 'seen by' ", "D4|-|D2|-|D2| |D2|:|D2|:|D2| |APM| |C4| |C2| "),
)


@query("o13_boundary_tokens", "SELECT event_id, CASE event_id % 6 " + " ".join(f"WHEN {k} THEN '{classes}'" for k, (_, classes) in enumerate(_NOTATIONS)) + " END AS classes FROM events")
def o13_boundary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    written = F.coalesce(*[F.when(F.col("event_id") % 6 == k, F.date_format("ts", notation)) for k, (notation, _) in enumerate(_NOTATIONS)])
    return rows.select("event_id", F.array_join(boundary.token_classes(written), "|").alias("classes"))


# JSON lines have their timestamp behind a key; plain lines have none; the others begin with one or show one early.
@query("o15_new_entries", _SQL_LINES + " SELECT file_name, line_no, event_id % 5 <> 4 AS is_new FROM lines")
def o15_new_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiline.with_new_entry(event_lines(spark, sf_dir)).select("file_name", "line_no", "is_new")


# Two timestamps with marks between them: all of their 10 pairs are known, none of the j others. Up to 9 of these the best
# stretch is the whole, with 20 of 20 + j pairs less j; beyond that it is the first timestamp alone.
@query("o14_likeness", """
    WITH e AS (SELECT event_id, event_id % 12 + 2 AS j FROM events)
    SELECT event_id, CASE WHEN j < 10 THEN (20.0::DOUBLE - j) / (20 + j) ELSE 1.0::DOUBLE END AS likeness, j < 7 OR j > 9 AS is_new FROM e
""")  # fmt: skip
def o14_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on both sides of the threshold of a half."""
    stamp, marks = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.substring(F.repeat(F.lit("=~"), F.lit(7)), F.lit(1), (F.col("event_id") % 12 + 1).cast("int"))
    lines = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).select("event_id", F.concat(stamp, marks, stamp).alias("content"))
    return lines.select("event_id", boundary.timestamp_likeness(boundary.token_codes(F.col("content"))).alias("likeness"), boundary.is_new_entry(F.col("content")).alias("is_new"))


@query("o16_merge", """
    SELECT source AS file_name, doc_id * 1000000 + 1 AS start_line, doc_id * 1000000 + 1 + len(string_split(text, chr(10))) AS end_line,
        md5(concat('2024-01-01 00:00:00 INFO doc ', doc_id, chr(10), text)) AS content_md5 FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)
""")  # fmt: skip
def o16_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = multiline.merge_multiline(document_lines(spark, sf_dir), max_entry_bytes=1 << 30)
    return merged.select("file_name", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query("o17_entry_cap", """
    WITH RECURSIVE l AS (
        SELECT doc_id, source, string_split(concat('2024-01-01 00:00:00 INFO doc ', doc_id, chr(10), coalesce(text, '')), chr(10)) AS x FROM documents
    ), f AS (
        SELECT doc_id, source, x, 1 AS k, 1 AS piece, strlen(x[1]) AS held FROM l
        UNION ALL
        SELECT doc_id, source, x, k + 1, CASE WHEN held + 1 + strlen(x[k + 1]) > 2000 THEN k + 1 ELSE piece END,
            CASE WHEN held + 1 + strlen(x[k + 1]) > 2000 THEN strlen(x[k + 1]) ELSE held + 1 + strlen(x[k + 1]) END FROM f WHERE k < len(x)
    ) SELECT source AS file_name, doc_id * 1000000 + piece AS start_line, max(doc_id * 1000000 + k) AS end_line, max(held) AS bytes FROM f GROUP BY source, doc_id, piece
""")  # fmt: skip
def o17_entry_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = multiline.merge_multiline(document_lines(spark, sf_dir), max_entry_bytes=2000)
    return merged.select("file_name", "start_line", "end_line", F.octet_length("content").cast("long").alias("bytes"))


@query("o18_stream_merge", """
    SELECT source AS file_name, doc_id * 1000000 + 1 AS start_line, false AS late, md5(concat('2024-01-01 00:00:00 INFO doc ', doc_id, chr(10), coalesce(text, ''))) AS content_md5 FROM documents
""")  # fmt: skip
def o18_stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of the document lines with an end for each file, in several micro-batches."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    lines = document_lines(spark, sf_dir).select("file_name", "line_no", "content", F.lit(False).alias("ended"))
    ends = lines.groupBy("file_name").agg(F.max("line_no").alias("last")).select("file_name", (F.col("last") + 1).alias("line_no"), F.lit(None).cast("string").alias("content"), F.lit(True).alias("ended"))
    # one after the other, as a stream takes files by their time
    thirds = F.ntile(3).over(Window.orderBy("doc_id"))
    cuts = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", thirds.alias("part")).groupBy("part").agg(F.max("doc_id").alias("doc_id")).orderBy("part").collect()]
    for k, top in enumerate(cuts):
        low = F.lit(True) if k == 0 else F.col("line_no") >= (cuts[k - 1] + 1) * 1_000_000
        lines.where(low & (F.col("line_no") < (top + 1) * 1_000_000)).write.mode("append").parquet(f"{path}/in")
    ends.write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/in")
    return _streamed(spark, stream_merge_multiline(stream, idle_timeout=None, max_entry_bytes=1 << 30), path).select("file_name", "start_line", "late", F.md5("content").alias("content_md5"))


# Events. The expected fields are written down from the table, not from the lines.

_KNOWN = "CASE level WHEN 'ERROR' THEN 'error' WHEN 'info' THEN 'info' WHEN 'WARNING' THEN 'warn' WHEN 'debug' THEN 'debug' END"


@query("o19_events", _SQL_LINES + f"""
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'logfmt' WHEN 2 THEN 'key_value' ELSE 'plain_text' END AS source_format,
        CASE WHEN event_id % 5 <> 4 THEN epoch_us(date_trunc('second', ts)) ELSE -1 END AS ts_us,
        CASE WHEN event_id % 5 < 3 THEN coalesce({_KNOWN}, CASE WHEN event_id % 5 < 2 THEN 'notice' END) WHEN event_id % 5 = 3 THEN CASE WHEN event_id % 2 = 0 THEN {_KNOWN} END
            WHEN event_id % 3 = 0 THEN {_KNOWN} END AS level,
        CASE WHEN event_id % 5 = 2 AND level = 'notice' THEN 'notice' END AS severity,
        CASE WHEN event_id % 5 < 3 THEN concat('svc-', user_id % 5) END AS service, CASE WHEN event_id % 5 = 2 THEN 'prod' END AS env,
        CASE WHEN event_id % 5 < 3 THEN CAST(event_id AS VARCHAR) END AS n, CASE WHEN event_id % 5 = 0 THEN 'true' END AS ok,
        CASE event_id % 5 WHEN 0 THEN concat('user ', user_id, ' ', event_type) WHEN 1 THEN concat('user ', user_id, ' did "', event_type, '"') END AS message FROM lines
""")  # fmt: skip
def o19_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = events.parse_events(event_lines(spark, sf_dir).drop("ts"))
    attr = lambda k: F.col("attrs")[k].alias(k)
    return parsed.select("event_id", "source_format", F.coalesce(F.unix_micros("ts"), F.lit(-1)).alias("ts_us"), attr("level"), attr("severity"), attr("service"), attr("env"), attr("n"), attr("ok"), F.coalesce(F.col("attrs")["message"], F.col("attrs")["msg"]).alias("message"))


@query("o20_json_fields", "SELECT event_id, 'c' AS a, concat('{\"b\":[1,2],\"k\":', regexp_extract(props, '[0-9]+'), '}') AS o, CAST(event_id AS VARCHAR) AS n, CAST(NULL AS VARCHAR) AS gone FROM events")
def o20_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat(F.lit('{"a":"b","a":"c","gone":null,"n":'), F.col("event_id").cast("string"), F.lit('.0,"o":{"k":'), F.regexp_extract("props", "[0-9]+", 0), F.lit(',"b":[1,2]}}'))
    parsed = events.parse_events(rows.select("event_id", line.alias("content")))
    return parsed.select("event_id", *[F.col("attrs")[k].alias(k) for k in ("a", "o", "n", "gone")])


@query("o26_timestamps", """
    SELECT event_id, epoch_us(date_trunc('second', ts)) - CASE WHEN event_id % 3 = 0 THEN 7200000000 ELSE 0 END + CASE WHEN event_id % 3 = 1 THEN 250000 ELSE 0 END AS ts_us, CAST(-1 AS BIGINT) AS bad_us FROM events
""")  # fmt: skip
def o26_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id") % 3
    stamp = F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd"), F.when(k == 2, " ").otherwise("T"), F.date_format("ts", "HH:mm:ss"), F.when(k == 0, "+02:00").when(k == 1, ",25").otherwise("Z"))
    return rows.select("event_id", F.unix_micros(events.parse_timestamp(stamp)).alias("ts_us"), F.coalesce(F.unix_micros(events.parse_timestamp(F.concat(F.lit("2024-02-30 "), F.date_format("ts", "HH:mm:ss")))), F.lit(-1)).alias("bad_us"))


@query("o28_ingest", _SQL_LINES + " SELECT event_id, content AS raw, line_no AS line_number, CASE WHEN event_id % 7 = 0 THEN 'ValueError: no' END AS parse_error, CASE WHEN event_id % 7 = 1 THEN 'x' END AS label FROM lines")
def o28_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = events.ingest_lines(event_lines(spark, sf_dir).drop("ts").withColumn("content", F.concat(F.col("event_id").cast("string"), F.lit("\t"), "content")), _seventh)
    return got.select("event_id", F.regexp_replace("raw", "^[0-9]+\t", "").alias("raw"), "line_number", "parse_error", F.col("labels")["k"].alias("label"))


def _seventh(raw: str) -> dict | None:
    number = int(raw.split("\t")[0])
    if number % 7 == 0:
        raise ValueError("no")
    return {"labels": {"k": "x"}} if number % 7 == 1 else None


# Templates. SQL does the same grouping with lists.

_SQL_TOKENS = _SQL_LINES + """,
    t AS (SELECT *, string_split(trim(translate(content, '|=,', '   ')), ' ') AS tokens FROM lines),
    p AS (SELECT *, len(tokens) AS n, list_transform(tokens[1:greatest(least(len(tokens) - 1, 27), 0)], lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS path FROM t),
    u AS (SELECT n, path, pos, min(tokens[pos]) AS low, max(tokens[pos]) AS high FROM (SELECT n, path, tokens, unnest(range(1, n + 1)) AS pos FROM p) GROUP BY n, path, pos),
    w AS (SELECT n, path, string_agg(CASE WHEN low = high THEN low ELSE '<*>' END, ' ' ORDER BY pos) AS raw_pattern FROM u GROUP BY n, path),
    found AS (SELECT n, raw_pattern, sum(c) AS c FROM w JOIN (SELECT n, path, count(*) AS c FROM p GROUP BY n, path) USING (n, path) GROUP BY n, raw_pattern),
    templates AS (SELECT sha256(raw_pattern) AS pattern_id, raw_pattern, n, CAST(c AS BIGINT) AS count, string_split(raw_pattern, ' ') AS tt FROM found WHERE c >= 2),
    ranked AS (SELECT *, len(list_filter(tt, lambda x: x <> '<*>')) AS literals FROM templates),
    matches AS (SELECT t.file_name, t.line_no, t.content, r.pattern_id, r.raw_pattern, row_number() OVER (PARTITION BY t.file_name, t.line_no ORDER BY r.literals DESC, r.raw_pattern) AS k
        FROM t JOIN ranked r ON len(t.tokens) = r.n AND len(list_filter(list_zip(t.tokens, r.tt), lambda z: z[2] <> '<*>' AND z[1] <> z[2])) = 0),
    matched AS (SELECT t.file_name, t.line_no AS start_line, t.content, m.pattern_id, m.raw_pattern FROM t LEFT JOIN (SELECT * FROM matches WHERE k = 1) m USING (file_name, line_no)),
    labelled AS (SELECT * FROM (SELECT *, rtrim(left(array_to_string(list_filter(string_split(lower(regexp_replace(raw_pattern, '[^A-Za-z]+', ' ', 'g')), ' '), lambda x: x <> ''), '-'), 30), '-') AS semantic_id
        FROM templates) WHERE semantic_id NOT LIKE '%timeout%')
"""


@query("o30_template_tokens", _SQL_TOKENS + " SELECT file_name, line_no, len(tokens) AS n, tokens[1] AS first_token, array_to_string(tokens, '~') AS joined FROM t")
def o30_template_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = templates.with_tokens(event_lines(spark, sf_dir))
    return tokens.select("file_name", "line_no", F.col("n").cast("long").alias("n"), F.get("tokens", F.lit(0)).alias("first_token"), F.array_join("tokens", "~").alias("joined"))


@query("o32_discover", _SQL_TOKENS + " SELECT pattern_id, raw_pattern, n, count FROM templates")
def o32_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.discover_templates(_entries(spark, sf_dir), absorb=False)
    return found.select("pattern_id", "raw_pattern", F.col("n").cast("long").alias("n"), "count")


@query("o32_feed", _SQL_TOKENS + " SELECT pattern_id, raw_pattern, n, count FROM templates")
def o32_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines fed in three parts, the last one as micro-batches of a stream: the templates of all of them."""
    path = f"{shared_dir(spark)}/shapes-{uuid.uuid4().hex}"
    lines, third = materialise(event_lines(spark, sf_dir).select("line_no", "content")), F.col("line_no") % 3
    for part in (0, 1):
        store.feed_lines(spark, path, lines.where(third == part))
    lines.where(third == 2).repartition(4).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    feed_stream(stream, path, f"{path}/state", availableNow=True).awaitTermination()
    found = templates.discover_from_shapes(store.read_shapes(spark, path), absorb=False)
    return found.select("pattern_id", "raw_pattern", F.col("n").cast("long").alias("n"), "count")


@query("o32_discover_absorbed", _SQL_TOKENS + """,
    s AS (SELECT n, raw_pattern, c, string_split(raw_pattern, ' ') AS x FROM found),
    pairs AS (SELECT a.n, a.raw_pattern, b.raw_pattern AS wide, len(list_filter(b.x, lambda z: z <> '<*>')) AS shared FROM s a JOIN s b ON a.n = b.n AND a.raw_pattern <> b.raw_pattern
        AND len(list_filter(list_zip(a.x, b.x), lambda z: z[2] <> '<*>' AND z[1] <> z[2])) = 0 WHERE len(list_filter(b.x, lambda z: z <> '<*>')) >= 0.4 * a.n),
    best AS (SELECT raw_pattern, wide FROM pairs WHERE wide NOT IN (SELECT raw_pattern FROM pairs) QUALIFY row_number() OVER (PARTITION BY raw_pattern ORDER BY shared DESC, wide) = 1)
    SELECT coalesce(best.wide, s.raw_pattern) AS raw_pattern, CAST(sum(s.c) AS BIGINT) AS count FROM s LEFT JOIN best USING (raw_pattern) GROUP BY 1 HAVING sum(s.c) >= 1
""")  # fmt: skip
def o32_discover_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.discover_templates(_entries(spark, sf_dir), min_count=1).select("raw_pattern", "count")


@query("o33_frequent_templates", _SQL_TOKENS + " SELECT raw_pattern, CAST(c AS BIGINT) AS count FROM found WHERE c >= 50")
def o33_frequent_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.discover_templates(_entries(spark, sf_dir), absorb=False, min_count=50).select("raw_pattern", "count")


@query("o34_match", _SQL_TOKENS + " SELECT file_name, start_line, pattern_id, raw_pattern FROM matched")
def o34_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).matched.select(*KEYS, "pattern_id", "raw_pattern")


@query("o35_labelled_rows", _SQL_TOKENS + " SELECT file_name, start_line, raw_pattern AS pattern, CASE WHEN pattern_id IS NULL THEN 0 ELSE 2 END AS n_labels FROM matched")
def o35_labelled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = templates.with_labels(_workspace(spark, sf_dir).matched)
    return rows.select(*KEYS, F.col("labels")["pattern"].alias("pattern"), F.size("labels").alias("n_labels"))


@query("o36_samples", _SQL_TOKENS + " SELECT pattern_id, CAST(k AS INTEGER) AS rank, content FROM (SELECT pattern_id, content, row_number() OVER (PARTITION BY pattern_id ORDER BY file_name, line_no) AS k FROM matches) WHERE k <= 3")
def o36_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = materialise(_entries(spark, sf_dir))
    found = materialise(templates.discover_templates(entries, absorb=False))
    return templates.template_samples(entries, found, KEYS, k=3).select("pattern_id", "rank", "content")


@query("o37_label_requests", _SQL_TOKENS + """,
    s AS (SELECT pattern_id, string_agg('  - ' || content, chr(10) ORDER BY k) AS lines FROM (SELECT pattern_id, content, row_number() OVER (PARTITION BY pattern_id ORDER BY file_name, line_no) AS k FROM matches) WHERE k <= 3 GROUP BY pattern_id)
    SELECT pattern_id, concat('Pattern ', pattern_id, ': "', replace(replace(raw_pattern, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), '"', chr(10), 'Samples:', chr(10), lines) AS request FROM templates JOIN s USING (pattern_id)
""")  # fmt: skip
def o37_label_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = materialise(_entries(spark, sf_dir))
    found = materialise(templates.discover_templates(entries, absorb=False))
    return labels.label_requests(found, templates.template_samples(entries, found, KEYS, k=3))


@query("o38_label_responses", "SELECT concat('p', event_id) AS pattern_id, event_type AS semantic_id, concat('about ', user_id) AS description FROM events WHERE event_id % 3 = 0")
def o38_label_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    one = F.to_json(F.array(F.struct(F.concat(F.lit("p"), "event_id").alias("pattern_id"), F.col("event_type").alias("semantic_id"), F.concat(F.lit("about "), "user_id").alias("description"))))
    k = F.col("event_id") % 3
    texts = rows.select(F.when(k == 0, F.concat(F.lit(" "), one, F.lit("\n"))).when(k == 1, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).otherwise(F.lit("no labels")).alias("response"))
    return labels.parse_label_responses(texts)[0]


@query("o39_apply_labels", _SQL_TOKENS + " SELECT pattern_id, raw_pattern, count, semantic_id FROM labelled")
def o39_apply_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _workspace(spark, sf_dir).labelled.select("pattern_id", "raw_pattern", "count", "semantic_id")


@query("o31_upsert", _SQL_STORED + " SELECT pattern_id, raw_pattern, semantic_id FROM patterns WHERE pattern_id <> 'p-view' UNION ALL SELECT 'p-view', 'new', 'seen'")
def o31_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, patterns = _stored(spark, sf_dir)
    view = patterns.where("pattern_id = 'p-view'")
    batch = view.withColumn("raw_pattern", F.lit("old")).withColumn("at", F.lit(1)).unionByName(view.withColumn("raw_pattern", F.lit("new")).withColumn("semantic_id", F.lit("seen")).withColumn("at", F.lit(2)))
    return store.upserted(patterns, batch, "at").select("pattern_id", "raw_pattern", "semantic_id")


# The store's questions.


@query("o40_by_pattern", _SQL_STORED + " SELECT line_number, concat(raw, ' #', id) AS raw FROM entries WHERE pattern = 'user <*> did click'")
def o40_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store.read_entries(spark, _stored_entries(spark, sf_dir))
    return search.query_by_pattern(stored, "user <*> did click").select("line_number", "raw")


@query("o41_search", _SQL_STORED + " SELECT line_number, concat(raw, ' #', id) AS raw FROM entries WHERE pattern = 'user <*> did view' AND ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts <= TIMESTAMP '2024-01-05 12:00:00'")
def o41_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days outside the range are not listed, and the pattern is a filter of the scan."""
    stored = store.read_entries(spark, _stored_entries(spark, sf_dir))
    found = search.query_logs(stored, "user <*> did view", F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-05 12:00:00").cast("timestamp_ntz"))
    return found.select("line_number", "raw")


@query("o42_top_lines", _SQL_STORED + " SELECT id, line_number, raw FROM entries ORDER BY line_number, id LIMIT 100")
def o42_top_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.query_logs(_stored(spark, sf_dir)[0], limit=100).select("id", "line_number", "raw")


@query("o42_top_stored", "SELECT event_id + 1 AS line_number, concat('user ', user_id, ' did ', event_type) AS raw FROM events WHERE event_type = 'view' AND event_id % 10 <> 9 ORDER BY event_id LIMIT 100")
def o42_top_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of a pattern from a store that was filled in four parts, of which few files are opened."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    entries = _stored(spark, sf_dir)[0].withColumn("line_number", F.col("id")).withColumn("end_line_number", F.col("id"))
    store.init_tables(spark, path)
    for part in range(4):
        store.append_logs(spark, path, entries.where(F.expr(f"(id div 500) % 4 = {part}")).drop("id"))
    return store.top_entries(spark, path, 100, pattern="user <*> did view").select("line_number", "raw")


@query("o43_pattern_summaries", _SQL_STORED + " SELECT pattern_id, pattern_type, raw_pattern, coalesce(semantic_id, '') AS semantic_id, coalesce(description, '') AS description, count(*) AS count FROM entries e JOIN patterns p USING (pattern_id) GROUP BY ALL".replace("SELECT pattern_id, pattern_type", "SELECT p.pattern_id, p.pattern_type").replace("USING (pattern_id)", "ON e.pattern_id = p.pattern_id"))
def o43_pattern_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pattern_summaries(*_stored(spark, sf_dir))


@query("o44_pattern_counts", _SQL_STORED + " SELECT pattern, count(*) AS count FROM entries WHERE pattern IS NOT NULL AND pattern <> '' GROUP BY pattern")
def o44_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pattern_counts(_stored(spark, sf_dir)[0])


# Reports.

_SQL_STATS = _SQL_TOKENS + """,
    known AS (SELECT m.* FROM matched m JOIN labelled USING (pattern_id)),
    lost AS (SELECT * FROM matched WHERE pattern_id IS NULL OR pattern_id NOT IN (SELECT pattern_id FROM labelled)),
    stats AS (SELECT l.pattern_id, l.raw_pattern, l.semantic_id, count(k.content) AS c, min(struct_pack(f := k.file_name, l := k.start_line)) FILTER (k.content IS NOT NULL) AS a,
        max(struct_pack(f := k.file_name, l := k.start_line)) FILTER (k.content IS NOT NULL) AS z FROM labelled l LEFT JOIN known k USING (pattern_id) GROUP BY ALL)
"""  # fmt: skip


@query("o45_pattern_stats", _SQL_STATS + " SELECT pattern_id, semantic_id, c AS count, a.f AS first_file, coalesce(a.l, -1) AS first_line, z.f AS last_file, coalesce(z.l, -1) AS last_line FROM stats")
def o45_pattern_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workspace(spark, sf_dir)
    return reports.pattern_stats(w.matched, w.labelled).select("pattern_id", "semantic_id", "count", "first_file", F.coalesce("first_line", F.lit(-1)).alias("first_line"), "last_file", F.coalesce("last_line", F.lit(-1)).alias("last_line"))


@query("o46_line_refs", _SQL_STATS + " SELECT pattern_id, file_name, start_line FROM known")
def o46_line_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workspace(spark, sf_dir)
    return reports.line_refs(w.matched, w.labelled)


@query("o47_pattern_samples", _SQL_STATS + " SELECT pattern_id, CAST(k AS INTEGER) AS rank, content FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY file_name, start_line) AS k FROM known) WHERE k <= 20")
def o47_pattern_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workspace(spark, sf_dir)
    return reports.pattern_samples(w.matched, w.labelled).select("pattern_id", "rank", "content")


@query("o48_by_frequency", _SQL_STATS + " SELECT CAST(row_number() OVER (ORDER BY c DESC, pattern_id) AS INTEGER) AS rank, pattern_id, c AS count FROM stats")
def o48_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workspace(spark, sf_dir)
    return reports.pattern_stats(w.matched, w.labelled).select(F.row_number().over(Window.orderBy(F.desc("count"), "pattern_id")).alias("rank"), "pattern_id", "count")


@query("o49_unmatched", _SQL_STATS + " SELECT file_name, start_line, content FROM lost")
def o49_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workspace(spark, sf_dir)
    return reports.unmatched_lines(w.matched, w.labelled)


@query("o50_summary", _SQL_STATS + " SELECT CAST(count(DISTINCT file_name) AS INTEGER) AS file_count, string_agg(DISTINCT file_name, ',' ORDER BY file_name) AS files, count(*) AS total_lines, (SELECT count(*) FROM labelled) AS pattern_count, (SELECT count(*) FROM lost) AS unmatched_count FROM matched")
def o50_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workspace(spark, sf_dir)
    files = reports.log_files(w.matched).agg(F.array_join(F.sort_array(F.collect_list("file_name")), ",").alias("files"))
    return reports.corpus_summary(w.matched, w.labelled).join(files).select("file_count", "files", "total_lines", "pattern_count", "unmatched_count")


_SQL_ERROR = "'(?i)(error|warn|fatal|panic|exception|failed|timeout)'"


@query("o51_error_patterns", _SQL_STATS + f" SELECT pattern_id, raw_pattern, c AS count FROM stats WHERE regexp_matches(raw_pattern, {_SQL_ERROR}) OR regexp_matches(semantic_id, {_SQL_ERROR})")
def o51_error_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workspace(spark, sf_dir)
    return reports.error_patterns(reports.pattern_stats(w.matched, w.labelled)).select("pattern_id", "raw_pattern", "count")


@query("o52_unmatched_errors", _SQL_STATS + f" SELECT file_name, start_line, content FROM lost WHERE regexp_matches(content, {_SQL_ERROR}) ORDER BY file_name, start_line LIMIT 50")
def o52_unmatched_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workspace(spark, sf_dir)
    return reports.unmatched_errors(w.matched, w.labelled)


_SQL_NAME = "CASE WHEN trim(regexp_replace(lower(c_name), '[^a-z0-9-]', '-', 'g'), '-') = '' THEN 'unknown' ELSE trim(regexp_replace(lower(c_name), '[^a-z0-9-]', '-', 'g'), '-') END"


@query("o53_dir_names", f"SELECT c_custkey, {_SQL_NAME} AS dir_name FROM customer")
def o53_dir_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.dir_name(F.col("c_name")).alias("dir_name"))


@query("o54_unique_dir_names", "SELECT c_custkey, CASE WHEN k = 1 THEN base ELSE concat(base, '-', k) END AS dir_name FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY c_custkey) AS k FROM (SELECT c_custkey, concat('n', c_nationkey) AS base FROM customer))")
def o54_unique_dir_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("N"), "c_nationkey").alias("semantic_id"))
    return labels.with_dir_names(rows, F.struct("c_custkey")).select("c_custkey", "dir_name")


@query("o55_topic_slugs", "SELECT c_custkey, nullif(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-'), '') AS slug FROM customer")
def o55_topic_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.topic_slug(F.col("c_name")).alias("slug"))


@query("o57_template_quality", _SQL_TOKENS + " SELECT (SELECT count(*) FROM lines) AS entries, count(*) AS templates, CAST(sum(count) AS BIGINT) AS covered, count(*) >= 1 AND count(*) < (SELECT count(*) FROM lines) AS good FROM templates")
def o57_template_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workspace(spark, sf_dir)
    return templates.template_quality(w.entries, w.templates).select("entries", "templates", "covered", "good")


@query("o58_grep", _SQL_LINES + " SELECT file_name, line_no, content FROM lines WHERE regexp_matches(content, 'ERROR.*click|timeout')")
def o58_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep_logs(event_lines(spark, sf_dir), "ERROR.*click|timeout").select("file_name", "line_no", "content")


@query("o58_indexed_grep", _SQL_LINES + r" SELECT file_name, line_no, content FROM lines WHERE regexp_matches(content, '(?i)user 1[0-9] (did|saw) (click|view).*(timeout|\[warning\])')")
def o58_indexed_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines stored in small blocks with their trigrams, and searched by these."""
    path = f"{shared_dir(spark)}/indexed-{uuid.uuid4().hex}"
    write_indexed(event_lines(spark, sf_dir), path, block_bytes=1 << 17)
    return grep_indexed(spark, path, r"(?i)user 1[0-9] (did|saw) (click|view).*(timeout|\[warning\])")


@query("o11_template_results", _SQL_TOKENS + " SELECT 'events' AS dataset, 'drain' AS test_path, CAST(sum(count) OVER () AS BIGINT) AS total_entries, count(*) OVER () AS template_count, row_number() OVER (ORDER BY count DESC, pattern_id) AS place, pattern_id, raw_pattern AS pattern, count FROM templates")
def o11_template_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result file written and read back: its totals, and its templates in their order."""
    found = templates.discover_templates(_entries(spark, sf_dir), absorb=False)
    path = f"{shared_dir(spark)}/results-{uuid.uuid4().hex}"
    reports.template_results(found.withColumn("dataset", F.lit("events")).withColumn("test_path", F.lit("drain"))).write.json(path)
    rows = spark.read.schema("dataset string, test_path string, total_entries long, template_count long, templates array<struct<pattern_id:string,pattern:string,count:long>>").json(path)
    each = rows.select("dataset", "test_path", "total_entries", "template_count", F.posexplode("templates").alias("k", "t"))
    return each.select("dataset", "test_path", "total_entries", "template_count", (F.col("k") + 1).cast("long").alias("place"), "t.*")


@query("o10_report_files", _SQL_STATS + f"""
    , named AS (SELECT *, trim(regexp_replace(lower(semantic_id), '[^a-z0-9-]', '-', 'g'), '-') AS base FROM stats),
    placed AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN base ELSE concat(base, '-', row_number() OVER w) END AS dir_name FROM named WINDOW w AS (PARTITION BY base ORDER BY c DESC, raw_pattern)),
    refs AS (SELECT p.dir_name, k.file_name, k.start_line, k.content, row_number() OVER (PARTITION BY p.pattern_id ORDER BY k.file_name, k.start_line) AS r FROM known k JOIN placed p USING (pattern_id)),
    errors AS (SELECT * FROM lost WHERE regexp_matches(content, {_SQL_ERROR}) ORDER BY file_name, start_line LIMIT 50)
    SELECT 'pattern' AS report, dir_name, count(*) AS n, md5(string_agg(concat('- `', file_name, '`:', start_line), chr(10) ORDER BY r)) AS listed FROM refs GROUP BY dir_name
    UNION ALL SELECT 'samples', dir_name, count(*), md5(string_agg(content, chr(10) ORDER BY r)) FROM refs WHERE r <= 20 GROUP BY dir_name
    UNION ALL SELECT 'samples', 'unmatched', count(*), md5(string_agg(content, chr(10) ORDER BY file_name, start_line)) FROM lost HAVING count(*) > 0
    UNION ALL SELECT 'errors', 'notes', count(*), md5(string_agg(content, chr(10) ORDER BY file_name, start_line)) FROM errors HAVING count(*) > 0
    UNION ALL SELECT 'summary', 'notes', count(*), md5(string_agg(concat('### ', semantic_id, ' (', c, ' matches)'), chr(10) ORDER BY c DESC, pattern_id)) FROM stats HAVING count(*) > 0
""")  # fmt: skip
def o10_report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written twice over the same workspace, and read back: the lists of every report in their order."""
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    w = _workspace(spark, sf_dir)
    for _ in range(2):
        reports.write_reports(w.matched, w.labelled, path, "events")
    back = reports.read_reports(spark, path, "events")
    # of the errors, what stands between the fences
    fence = F.sum(F.when((F.col("report") == "errors") & (F.col("value") == "```"), 1).otherwise(0)).over(Window.partitionBy("report", "dir_name").orderBy("file", "place"))
    listed = back.withColumn("fence", fence).where(
        ((F.col("report") == "pattern") & F.col("value").startswith("- `")) | (F.col("report") == "samples") | ((F.col("report") == "errors") & (F.col("fence") == 1) & (F.col("value") != "```")) | ((F.col("report") == "summary") & F.col("value").startswith("### "))
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("file", "place", "value"))), lambda x: x["value"])
    return listed.groupBy("report", "dir_name").agg(F.count("*").alias("n"), F.md5(F.array_join(lines, "\n")).alias("listed"))


@query("o56_rebuild", _SQL_TOKENS.replace(" WHERE semantic_id NOT LIKE '%timeout%'", "") + _SQL_STATS[len(_SQL_TOKENS):] + """
    , named AS (SELECT *, trim(regexp_replace(lower(semantic_id), '[^a-z0-9-]', '-', 'g'), '-') AS base FROM stats)
    SELECT pattern_id, semantic_id, CASE WHEN row_number() OVER w = 1 THEN base ELSE concat(base, '-', row_number() OVER w) END AS dir_name, raw_pattern, c AS count,
        a.f AS first_file, a.l AS first_line, z.f AS last_file, z.l AS last_line FROM named WINDOW w AS (PARTITION BY base ORDER BY c DESC, raw_pattern)
""")  # fmt: skip
def o56_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps from the lines on, with absorption and rule-based labels, and the reports of the workspace put in place of
    an earlier run's: the flagship."""
    path = f"{shared_dir(spark)}/workspaces-{uuid.uuid4().hex}"
    w = build_workspace(event_lines(spark, sf_dir).select("file_name", "line_no", "content"), path, "Events", merge=False)
    return reports.pattern_stats(w.matched, w.labelled).select("pattern_id", "semantic_id", "dir_name", "raw_pattern", "count", "first_file", "first_line", "last_file", "last_line")


# The single steps of event extraction, and the tables' set-up.


def _from_events(spark: SparkSession, sf_dir: str, line) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", "event_type", F.expr(line).alias("content") if isinstance(line, str) else line.alias("content"))


@query("o08_init_tables", _SQL_STORED + " SELECT (SELECT count(*) FROM entries) AS n_entries, (SELECT count(*) FROM patterns) AS n_patterns")
def o08_init_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Making the tables again leaves what is in them."""
    path = _stored_tables(spark, sf_dir)
    store.init_tables(spark, path)
    entries = store.read_entries(spark, path).agg(F.count("*").alias("n_entries"))
    return entries.join(store.read_patterns(spark, path).agg(F.count("*").alias("n_patterns")))


# Of every event a number of each kind, and the plain digits that it has; exponents from -324 to 300.
_TINY, _HUGE = "event_id % 300 + 1", "event_id % 290 + 10"


@query("o21_json_values", f"""
    SELECT event_id, concat(event_id, '.5') AS half, concat(event_id + 1, '000') AS big, 'false' AS flag, '1.0' AS quoted, concat('[', event_id, ',"x"]') AS list,
        concat('-0.', repeat('0', CAST({_TINY} - 1 AS INTEGER)), 125 + event_id % 5 * 2) AS tiny, concat(12 + event_id % 7 * 10, '3', repeat('0', CAST({_HUGE} - 2 AS INTEGER))) AS huge,
        concat('0.', repeat('0', 323), '5') AS least, concat('1', repeat('0', 300)) AS most, concat('2', repeat('0', 23)) AS rounded, '0.12345678901234568' AS fraction FROM events
""")  # fmt: skip
def o21_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = f"""concat('{{"half":', event_id, '.50,"big":', event_id + 1, 'e3,"flag":false,"quoted":"1.0","list":[', event_id, ', "x"],"tiny":-', 125 + event_id % 5 * 2, 'e-', {_TINY} + 2,
        ',"huge":', (12 + event_id % 7 * 10) * 10 + 3, 'e', {_HUGE} - 2, ',"least":5e-324,"most":1e300,"rounded":2e23,"fraction":0.12345678901234567890123}}')"""
    parsed = events.parse_events(_from_events(spark, sf_dir, line))
    return parsed.select("event_id", *[F.col("attrs")[k].alias(k) for k in ("half", "big", "flag", "quoted", "list", "tiny", "huge", "least", "most", "rounded", "fraction")])


@query("o22_assignments", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'logfmt' WHEN 1 THEN 'key_value' ELSE 'plain_text' END AS source_format, CASE WHEN event_id % 3 < 2 THEN CAST(event_id AS VARCHAR) END AS k, CASE WHEN event_id % 3 = 0 THEN concat('a \"', event_type) END AS q FROM events")
def o22_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(' q="a \\"'), "event_type", F.lit('"'))).when(F.col("event_id") % 3 == 1, "").otherwise(F.concat(F.lit(" "), "event_type"))
    parsed = events.parse_events(_from_events(spark, sf_dir, F.concat(F.lit("k="), F.col("event_id").cast("string"), quote, F.lit(" e="))))
    return parsed.select("event_id", "source_format", F.col("attrs")["k"].alias("k"), F.col("attrs")["q"].alias("q"))


@query("o23_prefixes", _SQL_LINES + f" SELECT event_id, CASE WHEN event_id % 3 < 2 THEN epoch_us(date_trunc('second', ts)) END AS ts_us, CASE WHEN event_id % 3 = 1 THEN NULL ELSE {_KNOWN} END AS level FROM lines")
def o23_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timestamp and a level, a timestamp alone, or a level alone before a text."""
    rows = spread(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("level", F.expr(_LEVEL))
    stamp, k = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_id") % 3
    line = F.when(k == 0, F.concat(F.lit(" "), stamp, F.lit(" ["), "level", F.lit("] up"))).when(k == 1, F.concat(stamp, F.lit(" "), "user_id")).otherwise(F.concat("level", F.lit(": down")))
    parsed = events.parse_events(rows.select("event_id", line.alias("content")))
    return parsed.select("event_id", F.unix_micros("ts").alias("ts_us"), F.col("attrs")["level"].alias("level"))


@query("o24_canonical_fields", "SELECT event_id, 'error' AS level, 'loud' AS lvl, event_type AS service, 'qa' AS env, 4 AS n_attrs FROM events")
def o24_canonical_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = """concat('{" Severity ":"[ERR]","Lvl":"loud","service_name":"old","service.name":" ', event_type, ' ","Environment":" QA ","x":""," ":"y","time":"never"}')"""
    parsed = events.parse_events(_from_events(spark, sf_dir, line))
    return parsed.select("event_id", F.col("attrs")["level"].alias("level"), F.col("attrs")["Lvl"].alias("lvl"), F.col("attrs")["service"].alias("service"), F.col("attrs")["env"].alias("env"), F.size("attrs").alias("n_attrs"))


@query("o25_validation", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'source_format is not supported' ELSE 'name is required|event.text is required' END AS violations FROM events")
def o25_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    text_of = F.when(k == 2, F.lit("  ")).otherwise(F.col("event_type"))
    event = F.struct(F.lit(None).cast("timestamp").alias("ts"), text_of.alias("text"), F.create_map(F.lit("a"), F.lit("b")).alias("attrs"), F.struct(F.lit("").alias("pattern"), F.lit("").alias("entity")).alias("inferred"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(k == 2, " ").otherwise("n").alias("name"), F.when(k == 1, "grok").otherwise("json").alias("source_format"), F.lit("d").alias("description"), event.alias("event"))
    return events.validate_events(rows).select("event_id", F.array_join("violations", "|").alias("violations"))


@query("o27_levels", _SQL_LINES + f" SELECT event_id, {_KNOWN} AS level FROM lines")
def o27_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", events.canonical_level(F.concat(F.lit(" ["), F.upper(F.expr(_LEVEL)), F.lit("] "))).alias("level"))


@query("o29_own_parser", _SQL_LINES + " SELECT event_id, content AS raw, upper(left(content, 5)) AS head FROM lines")
def o29_own_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser given as a function of the column."""

    def head(line):
        empty = F.lit(None).cast("struct<pattern:string,entity:string>")
        return F.struct(F.lit(None).cast("timestamp").alias("ts"), F.create_map(F.lit("head"), F.upper(F.substring(line, 1, 5))).alias("attrs"), empty.alias("inferred"), F.lit(None).cast("map<string,string>").alias("labels"))

    got = events.ingest_lines(event_lines(spark, sf_dir).drop("ts"), head, native=True)
    return got.select("event_id", "raw", F.col("attrs")["head"].alias("head"))


@query("o29_batch_parser", _SQL_LINES + " SELECT event_id, content AS raw, CASE WHEN event_id % 7 > 0 THEN upper(event_type) END AS kind, CASE WHEN event_id % 7 = 0 THEN 'ValueError: no' END AS parse_error FROM lines")
def o29_batch_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parser for Arrow batches that raises on some lines: only these have errors."""
    lines = event_lines(spark, sf_dir).select("event_id", "line_no", F.concat(F.col("event_id").cast("string"), F.lit("\t"), "content").alias("content"))
    got = events.ingest_batches(lines, _kinds)
    return got.select("event_id", F.regexp_replace("raw", "^[0-9]+\t", "").alias("raw"), F.col("attrs")["kind"].alias("kind"), "parse_error")


def _kinds(lines: pa.Array) -> dict[str, pa.Array]:
    if any(int(x.split("\t")[0]) % 7 == 0 for x in lines.to_pylist()):
        raise ValueError("no")
    kind = pc.struct_field(pc.extract_regex(lines, "(?P<kind>view|click|purchase|signup|error)"), "kind")
    return {"attrs": pa.array([[("kind", k.upper())] for k in kind.to_pylist()], pa.map_(pa.string(), pa.string()))}


@query("o29_table_function", _SQL_LINES + " SELECT event_id, content AS raw, CASE WHEN event_id % 7 = 0 THEN 'ValueError: no' END AS parse_error, CASE WHEN event_id % 7 = 1 THEN 'x' END AS label FROM lines")
def o29_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser as a table function in SQL."""
    events.register_line_parser(spark, "parse_seventh", _seventh)
    event_lines(spark, sf_dir).select("event_id", F.concat(F.col("event_id").cast("string"), F.lit("\t"), "content").alias("content")).createOrReplaceTempView("lines_to_parse")
    return spark.sql("SELECT event_id, regexp_replace(p.text, '^[0-9]+\t', '') AS raw, p.parse_error, p.labels['k'] AS label FROM lines_to_parse, LATERAL parse_seventh(content) AS p")
