"""Questions to the stored entries (id, line_number, end_line_number, timestamp, raw, labels) and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_by_pattern(entries: DataFrame, pattern: str) -> DataFrame:
    """Entries whose label `pattern` it is; stored entries have it as a column, which the scan can filter by."""
    return entries.where((F.col("pattern") if "pattern" in entries.columns else F.col("labels")["pattern"]) == pattern)


def query_logs(entries: DataFrame, pattern: str | None = None, from_ts=None, to_ts=None, limit: int = 0) -> DataFrame:
    """Entries by pattern and time (both ends belong), in the order of lines; a limit of 0 is none."""
    if pattern:
        entries = query_by_pattern(entries, pattern)
    by_day = "day" in entries.columns  # of stored entries: whole folders are left out
    if from_ts is not None:
        entries = entries.where(F.col("timestamp") >= F.lit(from_ts))
        entries = entries.where(F.col("day") >= F.to_date(F.lit(from_ts))) if by_day else entries
    if to_ts is not None:
        entries = entries.where(F.col("timestamp") <= F.lit(to_ts))
        entries = entries.where(F.col("day") <= F.to_date(F.lit(to_ts))) if by_day else entries
    ties = [c for c in ("file_name", "id") if c in entries.columns]
    ordered = entries.orderBy("line_number", *ties)
    return ordered.limit(limit) if limit > 0 else ordered


def pattern_summaries(entries: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every pattern that entries have, with their count, the most frequent first. Entries are counted by pattern_id
    before the join; those of unknown patterns drop out."""
    counts = entries.groupBy(F.col("labels")["pattern_id"].alias("pattern_id")).agg(F.count("*").alias("count"))
    joined = patterns.join(counts, "pattern_id")
    empty = F.lit("")
    return joined.select("pattern_id", "pattern_type", "raw_pattern", F.coalesce("semantic_id", empty).alias("semantic_id"), F.coalesce("description", empty).alias("description"), "count").orderBy(F.desc("count"), "pattern_id")


def pattern_counts(entries: DataFrame) -> DataFrame:
    """Entries of each pattern by its text."""
    pattern = F.col("labels")["pattern"]
    return entries.where(pattern.isNotNull() & (pattern != "")).groupBy(pattern.alias("pattern")).agg(F.count("*").alias("count"))


def grep_logs(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines (file_name, line_no, content) that a regular expression finds something in."""
    return lines.where(F.col("content").rlike(pattern))
