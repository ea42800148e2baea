"""Versions, writers at once, writers that die, and shapes fed in parts."""

import random
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from loglattice.operators import reports, templates
from loglattice.plans import workspace
from loglattice.sources import line_index, store, versions
from loglattice.streaming.templates import feed_stream

ROW = "line_number long, end_line_number long, timestamp timestamp, raw string, labels map<string,string>"


def _rows(spark, tag, n):
    return spark.createDataFrame([(k, k, None, f"{tag} {k}", None) for k in range(n)], ROW)


def test_writers_at_once_share_no_id(spark, tmp_path):
    path = f"file://{tmp_path}"
    store.init_tables(spark, path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda w: [store.append_logs(spark, path, _rows(spark, f"w{w}", 5 + w)) for _ in range(3)], range(4)))
    got = store.read_entries(spark, path).collect()
    assert sorted(r.id for r in got) == list(range(1, 3 * (5 + 6 + 7 + 8) + 1))
    assert len(got) == len({r.id for r in got})


def test_upserts_at_once_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}"
    store.init_tables(spark, path)

    def upsert(w):
        for k in range(3):
            batch = spark.createDataFrame([(f"p{w}-{k}", "drain", f"raw {w}", None, None, 1), ("shared", "drain", f"last {w}", None, None, 1)], "pattern_id string, pattern_type string, raw_pattern string, semantic_id string, description string, at int")
            store.upsert_patterns(spark, path, batch, "at")

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(upsert, range(3)))
    got = store.read_patterns(spark, path).collect()
    assert sorted(r.pattern_id for r in got) == sorted([*(f"p{w}-{k}" for w in range(3) for k in range(3)), "shared"])
    assert len(versions.versions(spark, f"{path}/patterns")) <= 2


def test_tables_made_again_stay_as_they_are(spark, tmp_path):
    path = f"file://{tmp_path}"
    for _ in range(3):
        store.init_tables(spark, path)
    assert len(list((tmp_path / "log_entries").glob("part-*"))) == 1 and versions.versions(spark, f"{path}/patterns") == [0]


def test_a_failed_append_leaves_a_gap(spark, tmp_path):
    path = f"file://{tmp_path}"
    store.init_tables(spark, path)
    store.append_logs(spark, path, _rows(spark, "a", 2))
    broken = _rows(spark, "b", 3).withColumn("raw", F.when(F.col("line_number") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("raw")))
    with pytest.raises(Exception, match="no"):
        store.append_logs(spark, path, broken)
    store.append_logs(spark, path, _rows(spark, "c", 1))
    assert sorted(r.id for r in store.read_entries(spark, path).collect()) == [1, 2, 6]


def test_reports_outlive_a_writer_that_dies(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame([("f", k, f"2024-03-28 13:45:3{k % 10} ERROR disk {k} failed") for k in range(1, 9)], "file_name string, line_no long, content string")
    done = workspace.build_workspace(lines, str(tmp_path), "topic")
    read = lambda: sorted(tuple(r) for r in reports.read_reports(spark, str(tmp_path), "topic").select("report", "dir_name", "value").collect())
    before = read()
    real = reports.report_lines
    monkeypatch.setattr(reports, "report_lines", lambda *a: real(*a).withColumn("value", F.when(F.col("report") == "summary", F.raise_error(F.lit("dies"))).otherwise(F.col("value"))))
    with pytest.raises(Exception, match="dies"):
        reports.write_reports(done.matched, done.labelled, str(tmp_path), "topic")
    assert read() == before and before
    monkeypatch.setattr(reports, "report_lines", real)
    reports.write_reports(done.matched, done.labelled, str(tmp_path), "topic")
    assert read() == before and len(list((tmp_path / "workspace=topic").glob("v*"))) == 1


def _lines(seed):
    random.seed(seed)
    kinds = ["user {} logged in", "disk {} of {} full", "disk {} gone", "a b {} c", "x {} y z w v", "{} {} {} end", "job {} took {} ms|ok=1"]
    words = ["alpha", "beta", "gamma", "7", "19"]
    return [random.choice(kinds).format(*(random.choice(words) for _ in range(3))) for _ in range(200)]


@pytest.mark.parametrize(("parts", "options"), [(2, {}), (5, {"sim_th": 0.9, "depth": 4}), (3, {"max_children": 2, "absorb": False})])
def test_parts_fed_equal_the_whole(spark, tmp_path, parts, options):
    held = _lines(parts)
    for k in range(parts):
        store.feed_lines(spark, str(tmp_path), spark.createDataFrame([(x,) for x in held[k::parts]], "content string"))
    kept = {(r.raw_pattern, r["count"], r.low_similarity) for r in templates.discover_from_shapes(store.read_shapes(spark, str(tmp_path)), min_count=1, **options).collect()}
    whole = templates.discover_templates(spark.createDataFrame([(x,) for x in held], "content string"), min_count=1, **options)
    assert kept == {(r.raw_pattern, r["count"], r.low_similarity) for r in whole.collect()} and sum(r[1] for r in kept) == 200


def test_a_micro_batch_fed_twice_counts_once(spark, tmp_path):
    lines = spark.createDataFrame([("a 1",), ("a 2",)], "content string")
    for batch in (0, 0, 1, 1, 0):
        store.feed_lines(spark, str(tmp_path), lines, batch)
    assert [(r.tokens, r["count"]) for r in store.read_shapes(spark, str(tmp_path)).collect()] == [(["a", "<*>"], 4)]


def test_a_stream_is_fed_from_its_checkpoint(spark, tmp_path):
    held = _lines(9)
    for k in range(2):
        spark.createDataFrame([(x,) for x in held[k::2]], "content string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("content string").parquet(f"{tmp_path}/in")
        feed_stream(stream, f"{tmp_path}/kept", f"{tmp_path}/state", availableNow=True).awaitTermination()
    assert store.read_shapes(spark, f"{tmp_path}/kept").agg(F.sum("count")).first()[0] == 200


def test_required_texts():
    known = line_index.required_texts
    assert known("ERROR.*click|timeout") == [{"ERROR", "click"}, {"timeout"}]
    assert known("(?i)a(bb|cd)+d") == [{"a", "bb", "d"}, {"a", "cd", "d"}] and known("ab|ac") == [{"a"}]
    assert known("x(abc)?y[0-9]{2}z") == [{"x", "y", "z"}] and known("(?:foo){2,}bar") == [{"foo", "bar"}]
    for unknown in (".*", "[a-z]+", r"\p{L}+", r"\Qa.b\E", "(?x) a b c", r"\0101", "a|.", "("):
        assert set() in known(unknown) or known(unknown) == [set()]
    assert len(known("(a|b)" * 20)) <= 64


@pytest.mark.parametrize("pattern", ["needle [0-9]+", "(?i)NEEDLE|rare thing", "w1.*w2", "é[a-z]?x", "nothing at all", "w[0-9]", ""])
def test_search_by_trigrams_equals_a_scan(spark, tmp_path, pattern):
    random.seed(1)
    texts = [" ".join(f"w{random.randint(0, 30)}" for _ in range(6)) for _ in range(600)]
    texts[77] += " needle 12"
    texts[400], texts[401], texts[402] = "a Rare Thing", None, "éx"
    lines = spark.createDataFrame([("f", k, x) for k, x in enumerate(texts)], "file_name string, line_no int, content string")
    path = str(tmp_path / "index")
    line_index.write_indexed(lines, path, block_bytes=1000)
    want = sorted(r.line_no for r in lines.where(F.col("content").rlike(pattern)).collect())
    assert sorted(r.line_no for r in line_index.grep_indexed(spark, path, pattern).collect()) == want
    blocks, stored = line_index.candidate_blocks(spark, path, pattern), spark.read.parquet(f"{path}/lines")
    if pattern in ("needle [0-9]+", "(?i)NEEDLE|rare thing", "nothing at all"):
        holding = {r.block for r in stored.where(F.col("content").rlike(pattern)).collect()}
        assert set(blocks) == holding and stored.select("block").distinct().count() > len(blocks) + 8
        plan = line_index.grep_indexed(spark, path, pattern)._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^]]*block", plan) or not blocks


@pytest.mark.parametrize(("limit", "pattern", "days"), [(5, None, {}), (7, "p1", {}), (12, None, {"from_day": "2024-01-02", "to_day": "2024-01-03"}), (1000, "p2", {}), (3, "none", {})])
def test_first_lines_open_few_files(spark, tmp_path, limit, pattern, days):
    path = f"file://{tmp_path}"
    store.init_tables(spark, path)
    for part in range(5):
        rows = spark.range(part * 40, part * 40 + 40).select(
            F.col("id").alias("line_number"), F.col("id").alias("end_line_number"), F.expr("timestamp '2024-01-01 10:00:00' + make_interval(0, 0, 0, cast(id % 4 as int))").alias("timestamp"),
            F.concat(F.lit("raw "), "id").alias("raw"), F.create_map(F.lit("pattern"), F.concat(F.lit("p"), F.col("id") % 3)).alias("labels"),
        )
        store.append_logs(spark, path, rows)
    got = store.top_entries(spark, path, limit, pattern, **days)
    want = [k for k in range(200) if (pattern is None or pattern == f"p{k % 3}") and (not days or k % 4 in (1, 2))][:limit]
    assert [r.line_number for r in got.collect()] == want
    files, stored = got.inputFiles(), store.read_entries(spark, path).inputFiles()
    assert limit == 1000 or pattern == "none" or len(files) < len(stored) / 2
