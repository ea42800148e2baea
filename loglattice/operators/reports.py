"""Reports over matched entries: statistics, samples, references, errors, and their files.

`matched` is entries (file_name, start_line, content, pattern_id); `labelled` is templates with labels (pattern_id,
raw_pattern, semantic_id, description, dir_name). Entries are ordered by (file_name, start_line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglattice.operators.templates import first_lines
from loglattice.sources import versions

# Fixed value: what makes an error.
ERROR_PATTERN = "(?i)(error|warn|fatal|panic|exception|failed|timeout)"
ORDER = ("file_name", "start_line")


def _known(matched: DataFrame, labelled: DataFrame) -> DataFrame:
    return matched.join(labelled.select("pattern_id"), "pattern_id")


def pattern_stats(matched: DataFrame, labelled: DataFrame) -> DataFrame:
    """Every labelled pattern with count, first_file, first_line, last_file, last_line, the most frequent first; patterns
    without entries have count 0."""
    # numbers by file first, in hash tables: bounds of names would have every task sort all of its lines
    by_file = matched.where("pattern_id is not null").groupBy("pattern_id", "file_name").agg(F.count("*").alias("count"), F.min("start_line").alias("low"), F.max("start_line").alias("high"))
    place = lambda line: F.struct("file_name", F.col(line).alias("start_line"))
    stats = by_file.groupBy("pattern_id").agg(F.sum("count").alias("count"), F.min(place("low")).alias("first"), F.max(place("high")).alias("last"))
    joined = labelled.select("pattern_id", "raw_pattern", "semantic_id", "description", "dir_name").join(stats, "pattern_id", "left")
    return joined.select(
        "pattern_id", "semantic_id", "dir_name", "raw_pattern", "description", F.coalesce("count", F.lit(0)).alias("count"),
        F.col("first.file_name").alias("first_file"), F.col("first.start_line").alias("first_line"), F.col("last.file_name").alias("last_file"), F.col("last.start_line").alias("last_line"),
    ).orderBy(F.desc("count"), "pattern_id")


def pattern_samples(matched: DataFrame, labelled: DataFrame, k: int = 20) -> DataFrame:
    """The first k entries of each pattern: pattern_id, rank, file_name, start_line, content."""
    return first_lines(_known(matched, labelled), list(ORDER), k).select("pattern_id", "rank", *ORDER, "content")


def line_refs(matched: DataFrame, labelled: DataFrame) -> DataFrame:
    """pattern_id, file_name, start_line of all matched entries."""
    return _known(matched, labelled).select("pattern_id", *ORDER)


def unmatched_lines(matched: DataFrame, labelled: DataFrame) -> DataFrame:
    """Entries without a template, or with one that has no label."""
    return matched.join(labelled.select("pattern_id"), "pattern_id", "left_anti").select(*ORDER, "content")


def log_files(matched: DataFrame) -> DataFrame:
    """file_name of every log file."""
    return matched.select("file_name").distinct()


def corpus_summary(matched: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: file_count, total_lines, pattern_count, unmatched_count. The names of the files are a table, log_files."""
    marked = matched.join(labelled.select("pattern_id", F.lit(True).alias("known")), "pattern_id", "left")
    # entries are counted by file first, so the count of different names is that of rows
    by_file = marked.groupBy("file_name").agg(F.count("*").alias("lines"), F.count_if(F.col("known").isNull()).alias("lost"))
    none = F.lit(0).cast("long")
    totals = by_file.agg(F.count("*").cast("int").alias("file_count"), F.coalesce(F.sum("lines"), none).alias("total_lines"), F.coalesce(F.sum("lost"), none).alias("unmatched_count"))
    patterns = labelled.agg(F.count("*").alias("pattern_count"))
    return totals.join(patterns).select("file_count", "total_lines", "pattern_count", "unmatched_count")


def error_patterns(stats: DataFrame) -> DataFrame:
    """Patterns whose template or name speaks of an error."""
    return stats.where(F.col("raw_pattern").rlike(ERROR_PATTERN) | F.col("semantic_id").rlike(ERROR_PATTERN))


def unmatched_errors(matched: DataFrame, labelled: DataFrame, k: int = 50) -> DataFrame:
    """The first k unmatched entries that speak of an error."""
    return unmatched_lines(matched, labelled).where(F.col("content").rlike(ERROR_PATTERN)).orderBy(*ORDER).limit(k)


#: What orders the lines of a report file: its parts, a number (of templates: their counts, the largest first), then a
#: name and a line.
_FILE_ORDER = ("part", "rank", "name", "line")


def _where(name: str, line: str) -> Column:
    return F.concat(F.lit("`"), F.coalesce(F.col(name), F.lit("")), F.lit("` line "), F.coalesce(F.col(line), F.lit(0)).cast("string"))


def _lines(df: DataFrame, report: str, part: int, value: Column, rank: str | None = None, name: str | None = None, line: str | None = None, dir_name: str | None = None) -> DataFrame:
    """Rows of `df` as lines of a report."""
    zero = F.lit(0).cast("long")
    return df.select(
        F.lit(report).alias("report"), F.lit(dir_name).alias("dir_name") if dir_name else F.col("dir_name"), F.lit(part).alias("part"),
        (F.col(rank).cast("long") if rank else zero).alias("rank"), (F.col(name) if name else F.lit("")).alias("name"), (F.col(line).cast("long") if line else zero).alias("line"), value.alias("value"),
    )


# The headings of the report files.


def _pattern_head() -> Column:
    return F.concat(
        F.lit("# "), "semantic_id", F.lit("\n\n"), "description", F.lit("\n\n## Template\n\n```\n"), "raw_pattern", F.lit("\n```\n\n## Statistics\n\n- **Matches:** "), F.col("count").cast("string"),
        F.lit("\n- **First seen:** "), _where("first_file", "first_line"), F.lit("\n- **Last seen:** "), _where("last_file", "last_line"), F.lit("\n\n## Line References\n"),
    )


def _summary_head() -> Column:
    return F.concat(F.lit("# Log Summary\n\n- **Log files:** "), F.col("file_count").cast("string"))


def _summary_counts() -> Column:
    none = F.when(F.col("pattern_count") == 0, "\nNo patterns discovered.").otherwise("")
    return F.concat(
        F.lit("- **Total lines:** "), F.col("total_lines").cast("string"), F.lit("\n- **Patterns discovered:** "), F.col("pattern_count").cast("string"),
        F.lit("\n- **Unmatched lines:** "), F.col("unmatched_count").cast("string"), F.lit("\n\n## Patterns by Frequency\n"), none,
    )


def report_lines(matched: DataFrame, labelled: DataFrame) -> DataFrame:
    """The report files as rows (report, dir_name, part, rank, name, line, value): sorted by all but the last, the
    values of a (report, dir_name) are its text."""
    stats = pattern_stats(matched, labelled).withColumn("rank", -F.col("count"))
    named = labelled.select("pattern_id", "dir_name")
    refs = line_refs(matched, labelled).join(named, "pattern_id")
    entry = F.concat(F.lit("### "), "semantic_id", F.lit(" ("), F.col("count").cast("string"), F.lit(" matches)\n\n"), "description", F.lit("\n\nTemplate: `"), "raw_pattern", F.lit("`\n"))
    bad = F.concat(F.lit("## "), F.substring(entry, F.lit(5), F.length(entry)), F.lit("\nFirst seen: "), _where("first_file", "first_line"), F.lit("\n"))
    summary = corpus_summary(matched, labelled)
    lost = unmatched_errors(matched, labelled)
    some = lost.agg(F.count("*").alias("n")).where("n > 0")
    any_bad = error_patterns(stats).select(F.lit(1).alias("x")).unionByName(lost.select(F.lit(1).alias("x"))).agg(F.count("*").alias("n"))
    none_bad = F.concat(F.lit("# Error and Warning Patterns\n"), F.when(F.col("n") == 0, "\nNo error or warning patterns detected.").otherwise(""))
    parts = [
        _lines(stats, "pattern", 0, _pattern_head()),
        _lines(refs, "pattern", 1, F.concat(F.lit("- `"), "file_name", F.lit("`:"), F.col("start_line").cast("string")), name="file_name", line="start_line"),
        _lines(pattern_samples(matched, labelled).join(named, "pattern_id"), "samples", 0, F.col("content"), rank="rank"),
        _lines(unmatched_lines(matched, labelled), "samples", 0, F.col("content"), name="file_name", line="start_line", dir_name="unmatched"),
        _lines(summary, "summary", 0, _summary_head(), dir_name="notes"),
        _lines(log_files(matched), "summary", 1, F.concat(F.lit("  - `"), "file_name", F.lit("`")), name="file_name", dir_name="notes"),
        _lines(summary, "summary", 2, _summary_counts(), dir_name="notes"),
        _lines(stats, "summary", 3, entry, rank="rank", name="pattern_id", dir_name="notes"),
        _lines(any_bad, "errors", 0, none_bad, dir_name="notes"),
        _lines(error_patterns(stats), "errors", 1, bad, rank="rank", name="pattern_id", dir_name="notes"),
        _lines(some, "errors", 2, F.lit("## Unmatched Error Lines\n\n```"), dir_name="notes"),
        _lines(lost, "errors", 3, F.col("content"), name="file_name", line="start_line", dir_name="notes"),
        _lines(some, "errors", 4, F.lit("```"), dir_name="notes"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_reports(matched: DataFrame, labelled: DataFrame, path: str, workspace: str) -> None:
    """Report texts, one folder for each (report, dir_name), in place of those of an earlier run of the workspace. A long
    report is cut into several files, in the order of their names: rows are ranged by their place, not by report.
    The new reports take the place of the old ones at once, when they are whole."""
    order = ["report", "dir_name", *_FILE_ORDER]

    def write(last: str | None, staging: str) -> None:
        rows = report_lines(matched, labelled).repartitionByRange(*order).sortWithinPartitions(*order)
        rows.select("report", "dir_name", "value").write.partitionBy("report", "dir_name").text(staging)

    versions.commit(matched.sparkSession, f"{path}/workspace={workspace}", write, keep=1)


def read_reports(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    """The lines of written reports: report, dir_name, file (in the order of a report's files), place (in a file), value."""
    back = spark.read.text(versions.latest(spark, f"{path}/workspace={workspace}"))
    return back.select("report", "dir_name", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place"), "value")


def template_results(templates: DataFrame, dataset: str = "dataset", test_path: str = "test_path") -> DataFrame:
    """One row for each dataset: total_entries, template_count and templates (pattern_id, pattern, count)."""
    one = F.struct((-F.col("count")).alias("o"), "pattern_id", F.col("raw_pattern").alias("pattern"), "count")
    grouped = templates.groupBy(dataset, test_path).agg(F.sum("count").alias("total_entries"), F.count("*").alias("template_count"), F.array_sort(F.collect_list(one)).alias("found"))
    kept = F.transform("found", lambda t: F.struct(t["pattern_id"].alias("pattern_id"), t["pattern"].alias("pattern"), t["count"].alias("count")))
    return grouped.select(dataset, test_path, "total_entries", "template_count", kept.alias("templates"))
