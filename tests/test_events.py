import random
from datetime import datetime
from decimal import Decimal

import pyarrow as pa

from pyspark.sql import functions as F

from loglattice.functions import events
from loglattice.functions.events import parse_events, plain_number

CASES = [
    ('{"ts":"2024-01-05T10:00:00Z","level":"ERROR","f":1.0,"e":1e3,"q":"1.0","b":true,"x":null,"o":{"b":1,"a":[1,2]},"a":1,"a":2}', "json", "2024-01-05 10:00:00",
     {"level": "error", "f": "1", "e": "1000", "q": "1.0", "b": "true", "o": '{"a":[1,2],"b":1}', "a": "2"}),
    ('{"a":1} {"b":2}', "plain_text", None, {}),
    ("{'a':1}", "plain_text", None, {}),
    ('level=info msg="a \\"b\\"" k=', "logfmt", None, {"level": "info", "msg": 'a "b"'}),
    ('a="1"b=2', "logfmt", None, {"a": "1", "b": "2"}),
    ("ts=bad time=2024-01-05T10:00:00 severity=loud service_name= x=1", "key_value", "2024-01-05 10:00:00", {"severity": "loud", "x": "1"}),
    ("timestamp=2024-01-05T10:00:00.5+02:00 environment=PROD level=warning level=err", "key_value", "2024-01-05 08:00:00.500000", {"env": "prod", "level": "error"}),
    ('a=1 note="open', "plain_text", None, {}),
    ("a=1 b", "plain_text", None, {}),
    ("\t=1", "plain_text", None, {}),
    ("2024-01-05 10:00:00 [ERROR] user", "plain_text", "2024-01-05 10:00:00", {"level": "error"}),
    ("2024-01-05T10:00:00Z info: x", "plain_text", "2024-01-05 10:00:00", {"level": "info"}),
    ("2024-01-05 10:00:00,123 ERROR user", "plain_text", "2024-01-05 10:00:00", {}),
    ("2024-02-30 10:00:00 INFO x", "plain_text", None, {"level": "info"}),
    ("WARN: disk", "plain_text", None, {"level": "warn"}),
    ("INFO2 disk", "plain_text", None, {}),
    ("2024-01-05 only a date", "plain_text", None, {}),
    ("", "plain_text", None, {}),
]


def test_formats_fields_and_times(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, content string")
    for row in events.parse_events(df).orderBy("k").collect():
        line, kind, ts, attrs = CASES[row.k]
        assert row.source_format == kind, line
        assert (str(row.ts) if row.ts else None) == ts, line
        assert row.attrs == attrs, line


def test_null_line(spark):
    row = events.parse_events(spark.createDataFrame([(None,)], "content string")).first()
    assert (row.source_format, row.ts, row.attrs) == ("plain_text", None, {})


def test_violations(spark):
    event = "named_struct('ts', cast(null as timestamp), 'text', 'x', 'attrs', map('a', 'b'), 'inferred', named_struct('pattern', '', 'entity', ''))"
    bad = "named_struct('ts', cast(null as timestamp), 'text', ' ', 'attrs', map(' ', 'b'), 'inferred', cast(null as struct<pattern:string,entity:string>))"
    df = spark.sql(f"select 'n' name, 'json' source_format, 'd' description, {event} event union all select ' ', 'grok', null, {bad}")
    got = sorted(len(r.violations) for r in events.validate_events(df).collect())
    assert got == [0, 6]


def _parser(raw):
    if raw == "bad":
        raise ValueError("no")
    return {"ts": datetime(2024, 1, 1), "labels": {"k": raw}} if raw == "good" else None


def test_no_line_is_lost(spark):
    df = spark.createDataFrame([(1, " edge "), (2, "bad"), (3, "good")], "line_no long, content string")
    rows = events.ingest_lines(df, _parser).orderBy("line_no").collect()
    assert [r.raw for r in rows] == [" edge ", "bad", "good"]
    assert [r.parse_error for r in rows] == [None, "ValueError: no", None]
    assert rows[2].labels == {"k": "good"} and rows[0].attrs == {}
    native = events.ingest_lines(df, lambda c: F.struct(F.lit(None).cast("timestamp").alias("ts"), F.create_map(F.lit("t"), c).alias("attrs"), F.lit(None).cast("struct<pattern:string,entity:string>").alias("inferred"), F.lit(None).cast("map<string,string>").alias("labels")), native=True)
    assert [r.attrs["t"] for r in native.orderBy("line_no").collect()] == [" edge ", "bad", "good"]


def test_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(1, '{"level":"WARN","a":"b"}', "old", "old", "old", "old", "old")], "line_no long, content string, ts string, attrs string, inferred string, source_format string, labels string")
    row = events.parse_events(df).first()
    assert (row.source_format, row.ts, row.attrs, row.labels) == ("json", None, {"level": "warn", "a": "b"}, "old")
    for parser in (None, lambda raw: {"labels": {"n": str(len(raw))}}):
        got = events.ingest_lines(df, parser)
        assert len(set(got.columns)) == len(got.columns)
        assert (got.first().ts, got.first().source_format, got.first().labels) == (None, "old", {} if parser is None else {"n": "24"})


def test_numbers_in_plain_decimals(spark):
    random.seed(3)
    numbers = [0.0, 1e-20, 1.5e-18, 5e-324, 2.2250738585072014e-308, 1e300, 1.7976931348623157e308, 2e23, 1e23, 9007199254740993.0, 0.1, -2.5e-7, 123456.789, 1e15, 1e16, 1e21]
    numbers += [random.choice([-1, 1]) * random.random() * 10.0 ** random.randint(-300, 300) for _ in range(300)]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(numbers)], "k int, x double").select("k", plain_number(F.col("x")).alias("text")).collect()
    for r in got:
        assert r.text == (format(Decimal(repr(numbers[r.k])), "f").removesuffix(".0") if numbers[r.k] else "0"), numbers[r.k]


def test_numbers_beyond_doubles(spark):
    lines = ['{"n":1e400,"a":"b"}', '{"n":1e-400}', '{"n":123456789012345678901234567890}', '{"n":-7}']
    got = [(r.source_format, r.attrs.get("n")) for r in parse_events(spark.createDataFrame([(x,) for x in lines], "content string")).collect()]
    assert got == [("plain_text", None), ("json", "0"), ("json", "123456789012345678901234567890"), ("json", "-7")]


def _batches(lines):
    texts = lines.to_pylist()
    if "bad" in texts:
        raise ValueError(f"no {len(texts)}")
    return {"labels": pa.array([[("k", t)] if t.strip() == t else None for t in texts], pa.map_(pa.string(), pa.string()))}


def test_a_batch_parser_loses_no_line(spark):
    held = [" edge ", "bad", *[f"good {k}" for k in range(30)], "bad", None]
    df = spark.createDataFrame([(k, x, "old", "kept") for k, x in enumerate(held)], "line_no long, content string, ts string, extra string").coalesce(1)
    rows = events.ingest_batches(df.where("content is not null"), _batches).orderBy("line_no").collect()
    assert [r.raw for r in rows] == held[:-1] and {r.extra for r in rows} == {"kept"} and {r.ts for r in rows} == {None}
    assert [r.parse_error for r in rows if r.raw == "bad"] == ["ValueError: no 1"] * 2 and not any(r.parse_error for r in rows if r.raw != "bad")
    assert rows[0].labels == {} and rows[5].labels == {"k": "good 3"} and rows[1].attrs == {}


def test_a_parser_as_a_table_function(spark):
    events.register_line_parser(spark, "parse_test", _parser)
    got = spark.sql("SELECT p.* FROM VALUES ('bad'), ('good') AS t(x), LATERAL parse_test(x) AS p ORDER BY p.text").collect()
    assert [(r.text, r.labels, r.parse_error) for r in got] == [("bad", {}, "ValueError: no"), ("good", {"k": "good"}, None)]
