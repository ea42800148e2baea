"""Structured events from log lines, as column stages of one narrow projection.

The formats are tried in the order json, logfmt, key_value, timestamp or level prefix, plain text. Fields get
canonical names and values; the text stays as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys with a meaning, levels and formats.
TIMESTAMP_KEYS = ("ts", "timestamp", "time", "@timestamp")
LEVEL_KEYS = ("level", "severity", "lvl", "log.level")
SERVICE_KEYS = ("service", "service_name", "service.name")
ENV_KEYS = ("env", "environment")
LEVELS = {"trace": "trace", "debug": "debug", "info": "info", "warn": "warn", "warning": "warn", "error": "error", "err": "error", "fatal": "fatal"}
FORMATS = ("json", "logfmt", "key_value", "plain_text")

#: All characters of white space.
_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_DATE_TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}"
_STAMP = rf"{_DATE_TIME}(?:\.[0-9]+)?(?:Z|[+-][0-9]{{2}}:[0-9]{{2}})?"
_WORD_END = "(?![A-Za-z0-9_])"
_ASSIGNMENTS = r'(?s)^ *+(?:[^= ]++=(?:"(?:\\.|[^"\\])*+"|(?!")[^ ]*+) *+)++\z'
_ASSIGNMENT = r'(?s)([^= ]++)=("(?:\\.|[^"\\])*+"|(?!")[^ ]*+)'
_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

EVENT_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("text", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("inferred", T.StructType([T.StructField("pattern", T.StringType()), T.StructField("entity", T.StringType())])),
])


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    """The value of a key in a fixed table, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once and not for every use: it is the argument of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_timestamp(text: Column) -> Column:
    """A full date and time, with a fraction and a zone or not; without a zone it is UTC. Others are null."""
    value = F.regexp_replace(trimmed(text), ",([0-9]+)", ".$1")

    def read(value: Column) -> Column:
        zoned = F.when(value.rlike(r"(?:Z|[+-][0-9]{2}:[0-9]{2})\z"), value).otherwise(F.concat(value, F.lit("Z")))
        return F.when(value.rlike(rf"^{_STAMP}\z"), zoned.try_cast("timestamp"))

    return _bound(value, read)


def canonical_level(text: Column) -> Column:
    """One of the known levels, or null."""
    return _looked_up(LEVELS, F.lower(F.btrim(trimmed(text), F.lit("[]"))))


_PAIRS = "array<struct<key:string,value:string>>"


def _json_pairs(line: Column) -> Column:
    """Top-level fields of a line that is one JSON object, in document order; null for other lines."""
    text = trimmed(line)
    wrapped = F.when(text.startswith("{") & text.endswith("}"), F.concat(F.lit("["), text, F.lit("]")))
    whole = F.from_json(wrapped, "array<map<string,variant>>", _JSON)
    fields = F.map_entries(F.get(whole, F.lit(0)))

    def text_of(v: Column) -> Column:
        kind, plain = F.schema_of_variant(v), v.try_cast("string")
        # of a fraction with more digits than a double has, a double's digits count
        fraction = kind.startswith("DECIMAL") & (F.length(plain) > 16) & plain.contains(".")
        return F.when(F.is_variant_null(v) | (kind == "VOID"), F.lit(None)).when((kind == "DOUBLE") | fraction, plain_number(v.try_cast("double"))).otherwise(plain)

    pairs = F.transform(fields, lambda e: F.struct(e["key"].alias("key"), text_of(e["value"]).alias("value")))
    # a number that no double can hold makes the line something else
    beyond = F.exists(fields, lambda e: (F.schema_of_variant(e["value"]) == "DOUBLE") & (F.abs(e["value"].try_cast("double")) == float("inf")))
    return F.when((F.size(whole) == 1) & ~beyond, pairs)


def plain_number(x: Column) -> Column:
    """The shortest decimal that is this double, without an exponent."""

    def written(x: Column) -> Column:
        # the fewest digits that are read as the same number
        tries = F.array(*[F.format_string(f"%.{n}e", x) for n in range(17)])
        return _bound(F.get(F.filter(tries, lambda t: t.cast("double") == x), F.lit(0)), placed)

    def placed(text: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(text, "^-?([0-9.]+)e", 1), "[.]", "")
        power = F.regexp_extract(text, "e([+-][0-9]+)", 1).cast("int")
        zeros, size = F.repeat(F.lit("0"), F.abs(power - F.length(digits) + 1)), F.length(digits)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        inner = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, size))
        plain = F.when(power < 0, small).when(size <= power + 1, F.concat(digits, zeros)).otherwise(inner)
        return F.when(text.startswith("-"), F.concat(F.lit("-"), plain)).otherwise(plain)

    return _bound(x, written)


def _assignment_pairs(line: Column) -> Column:
    """key=value items of a line that is nothing else, values with their quotes; null for other lines."""
    keys = F.regexp_extract_all(line, F.lit(_ASSIGNMENT), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(_ASSIGNMENT), F.lit(2))
    pairs = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value")))
    good = line.rlike(_ASSIGNMENTS) & F.forall(keys, lambda k: trimmed(k) != "")
    return F.when(good, pairs)


def _unquoted(value: Column) -> Column:
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    return F.when(value.startswith('"'), F.regexp_replace(inner, r"(?s)\\(.)", "$1")).otherwise(value)


_KINDS = {key: kind for kind, keys in (("ts", TIMESTAMP_KEYS), ("level", LEVEL_KEYS), ("service", SERVICE_KEYS), ("env", ENV_KEYS)) for key in keys}


def _assigned(pairs: Column) -> Column:
    """Timestamp and attributes of fields, as a struct: canonical keys, later fields over earlier ones."""

    def named(e: Column) -> Column:
        key = trimmed(e["key"])
        return F.struct(key.alias("key"), _looked_up(_KINDS, F.lower(key)).alias("kind"), trimmed(e["value"]).alias("value"))

    def entry(e: Column) -> Column:
        level = F.when(e["kind"] == "level", canonical_level(e["value"]))
        return _bound(level, lambda level: F.struct(
            F.when(e["kind"] == "level", F.when(level.isNotNull(), F.lit("level")).otherwise(e["key"])).otherwise(F.coalesce(e["kind"], e["key"])).alias("key"),
            F.when(e["kind"] == "env", F.lower(e["value"])).otherwise(F.coalesce(level, e["value"])).alias("value"),
        ))

    def gathered(fields: Column) -> Column:
        stamps = F.transform(F.filter(fields, lambda e: e["kind"] == "ts"), lambda e: parse_timestamp(e["value"]))
        entries = F.transform(F.filter(fields, lambda e: F.coalesce(e["kind"], F.lit("")) != "ts"), entry)
        # the last of each key, without a session setting
        last = _bound(entries, lambda es: F.filter(es, lambda e, k: ~F.exists(F.slice(es, k + 2, F.size(es)), lambda later: later["key"] == e["key"])))
        return F.struct(F.get(F.filter(stamps, lambda t: t.isNotNull()), F.lit(0)).alias("ts"), F.map_from_entries(last).alias("attrs"))

    used = F.transform(F.filter(pairs, lambda e: e["value"] != ""), named)
    return _bound(F.filter(used, lambda e: e["key"] != ""), gathered)


def _prefix(line: Column) -> Column:
    """Timestamp and level at the beginning of a line, as a struct; both null if there is neither."""
    # after the word and its brackets a word must end or begin
    word_end = rf"(?:{_WORD_END}|(?:\]:?|:)(?=[A-Za-z0-9_]))"
    both = rf"^({_STAMP})(?U:\s)+\[?([A-Za-z]+){word_end}"
    leading = rf"^\[?([A-Za-z]+){word_end}"

    def dated(head: Column) -> Column:
        level = canonical_level(F.regexp_extract(head, both, 2))
        alone = F.regexp_extract(head, rf"^({_STAMP}){_WORD_END}", 1)
        return _bound(F.struct(parse_timestamp(F.regexp_extract(head, both, 1)).alias("ts"), level.alias("level")), lambda x: F.when(
            x["ts"].isNotNull() | x["level"].isNotNull(), x).otherwise(F.struct(parse_timestamp(alone).alias("ts"), F.lit(None).cast("string").alias("level")))
        )

    def found(head: Column) -> Column:
        word = F.struct(F.lit(None).cast("timestamp").alias("ts"), canonical_level(F.regexp_extract(head, leading, 1)).alias("level"))
        return F.when(F.substring(head, 1, 1).between("0", "9"), dated(head)).otherwise(word)

    return _bound(F.ltrim(line, F.lit(_SPACES)), found)


def parse_events(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Adds source_format, ts, attrs and inferred to lines, in place of input columns of these names; works on tables
    and streams."""
    line = F.col("__line")
    held = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("source_format", "ts", "attrs", "inferred")], F.col(text_col).alias("__line"))
    staged = held.withColumn("__json", _json_pairs(line)).withColumn("__pairs", F.when(F.col("__json").isNull(), _assignment_pairs(line)))
    quoted = F.exists("__pairs", lambda e: e["value"].startswith('"'))
    staged = staged.withColumn("source_format", F.when(F.col("__json").isNotNull(), "json").when(F.col("__pairs").isNotNull(), F.when(quoted, "logfmt").otherwise("key_value")).otherwise("plain_text"))
    fields = F.coalesce("__json", F.transform("__pairs", lambda e: F.struct(e["key"].alias("key"), _unquoted(e["value"]).alias("value"))))
    prefix = _bound(_prefix(line), lambda x: F.struct(x["ts"].alias("ts"), F.when(x["level"].isNotNull(), F.create_map(F.lit("level"), x["level"])).alias("attrs")))
    found = F.when(F.col("source_format") == "plain_text", prefix).otherwise(_assigned(fields))
    out = staged.withColumn("__found", found).withColumn("ts", F.col("__found.ts")).withColumn("attrs", F.coalesce("__found.attrs", F.create_map().cast("map<string,string>")))
    inferred = F.struct(F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("entity"))
    return out.withColumn("inferred", inferred).drop("__json", "__pairs", "__found", "__line")


def validate_events(df: DataFrame) -> DataFrame:
    """Adds `violations`, the rules that an event row (name, source_format, description, event) breaks."""
    blank = lambda c: F.coalesce(trimmed(c) == "", F.lit(True))
    event = F.col("event")
    rules = [
        ("name is required", blank(F.col("name"))),
        ("source_format is not supported", ~F.coalesce(F.col("source_format").isin(*FORMATS), F.lit(False))),
        ("description is required", blank(F.col("description"))),
        ("event.text is required", blank(event["text"])),
        ("event.attrs is required", event["attrs"].isNull()),
        ("event.inferred is required", event["inferred"].isNull()),
        ("event.attrs has a blank key", F.coalesce(F.exists(F.map_keys(event["attrs"]), blank), F.lit(False))),
    ]
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules])))


OUTCOME = "ts timestamp, text string, attrs map<string,string>, inferred struct<pattern:string,entity:string>, labels map<string,string>, parse_error string"


def ingest_lines(df: DataFrame, parser: Callable[[str], dict | None] | Callable[[Column], Column] | None = None, native: bool = False) -> DataFrame:
    """Every line (line_no, content, ...) becomes an entry, whatever its parser does.

    `parser` is a Python function of the raw line that gives a dict of ts, attrs, inferred and labels (or None, or
    raises), or with `native` a function of the column that gives a struct of those. Without a parser, or where it
    gives nothing, the text is kept with empty fields; an error is kept as parse_error and so is the row. Input columns
    that bear the names of results are replaced."""
    text = F.col("content")
    kept = [c for c in df.columns if c not in ("ts", "text", "attrs", "inferred", "labels", "parse_error", "line_number", "end_line_number", "raw")]
    if parser is None or native:
        got = parser(text) if parser is not None else F.lit(None).cast("struct<ts:timestamp,attrs:map<string,string>,inferred:struct<pattern:string,entity:string>,labels:map<string,string>>")
        held = df.withColumn("__got", got)
        empty = F.create_map().cast("map<string,string>")
        out = held.select(
            *[F.col(f"`{c}`") for c in kept], F.col("__got.ts").alias("ts"), text.alias("text"), F.coalesce("__got.attrs", empty).alias("attrs"),
            F.coalesce("__got.inferred", F.struct(F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("entity"))).alias("inferred"),
            F.coalesce("__got.labels", empty).alias("labels"), F.lit(None).cast("string").alias("parse_error"),
        )
    else:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.concat([frame.reset_index(drop=True), pd.DataFrame([_outcome(parser, raw) for raw in frame["content"]], columns=["ts", "text", "attrs", "inferred", "labels", "parse_error"])], axis=1)

        df = df.select(*[F.col(f"`{c}`") for c in kept])
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        out = df.mapInPandas(run, f"{schema}, {OUTCOME}")
    return out.withColumn("line_number", F.col("line_no")).withColumn("end_line_number", F.col("line_no")).withColumn("raw", text)


def _outcome(parser: Callable[[str], dict | None], raw: str) -> dict:
    nothing = {"ts": None, "text": raw, "attrs": {}, "inferred": {"pattern": None, "entity": None}, "labels": {}, "parse_error": None}
    try:
        got = parser(raw) or {}
    except Exception as e:  # whatever a user's parser raises, the line is kept
        return nothing | {"parse_error": f"{type(e).__name__}: {e}"}
    return nothing | {k: v for k, v in got.items() if k in ("ts", "attrs", "inferred", "labels") and v is not None}


_OUTCOME_FIELDS = {
    "ts": pa.timestamp("us", tz="UTC"), "attrs": pa.map_(pa.string(), pa.string()), "inferred": pa.struct([("pattern", pa.string()), ("entity", pa.string())]), "labels": pa.map_(pa.string(), pa.string()),
}


def ingest_batches(df: DataFrame, parser: Callable[[pa.Array], dict[str, pa.Array]]) -> DataFrame:
    """ingest_lines with a parser for Arrow batches: it gets an array of lines and returns arrays of ts, attrs, inferred or
    labels (any of them), one value a line. If it raises, the batch is halved, until only the lines that it
    can't parse are left; these have the error as parse_error and nothing else."""
    kept = [c for c in df.columns if c not in ("ts", "text", "attrs", "inferred", "labels", "parse_error")]
    rows = df.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, size, got, error in _parsed_parts(parser, batch.column("content"), 0, batch.num_rows):
                part = batch.slice(begin, size)
                none = {"attrs": pa.array([[]] * size, _OUTCOME_FIELDS["attrs"]), "inferred": pa.array([{}] * size, _OUTCOME_FIELDS["inferred"]), "labels": pa.array([[]] * size, _OUTCOME_FIELDS["labels"])}
                columns = [_filled(got.get(name), none.get(name, pa.nulls(size, kind)), kind) for name, kind in _OUTCOME_FIELDS.items()]
                out = [*part.columns, columns[0], part.column("content"), *columns[1:], pa.array([error] * size, pa.string())]
                yield pa.RecordBatch.from_arrays(out, [*kept, "ts", "text", "attrs", "inferred", "labels", "parse_error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(run, f"{schema}, {OUTCOME}")
    return out.withColumn("line_number", F.col("line_no")).withColumn("end_line_number", F.col("line_no")).withColumn("raw", F.col("content"))


def _filled(given: pa.Array | None, default: pa.Array, kind: pa.DataType) -> pa.Array:
    """What a parser gave, with the default where it gave null."""
    if given is None:
        return default
    given = given.cast(kind)
    if not given.null_count or default.null_count:
        return given
    return pa.concat_arrays([given, default]).take(pa.array([k if ok else len(given) + k for k, ok in enumerate(given.is_valid().to_pylist())], pa.int64()))


def _parsed_parts(parser: Callable[[pa.Array], dict[str, pa.Array]], lines: pa.Array, begin: int, size: int) -> Iterator[tuple[int, int, dict[str, pa.Array], str | None]]:
    if not size:
        return
    try:
        got = parser(lines.slice(begin, size)) or {}
        if wrong := [name for name, x in got.items() if name not in _OUTCOME_FIELDS or len(x) != size]:
            raise ValueError(f"{wrong[0]} is no result for {size} lines")
        yield begin, size, {name: x.cast(_OUTCOME_FIELDS[name]) for name, x in got.items()}, None
    except Exception as e:  # whatever a user's parser raises, every line is kept
        if size == 1:
            yield begin, 1, {}, f"{type(e).__name__}: {e}"
            return
        half = size // 2
        yield from _parsed_parts(parser, lines, begin, half)
        yield from _parsed_parts(parser, lines, begin + half, size - half)


def register_line_parser(spark: SparkSession, name: str, parser: Callable[[str], dict | None]) -> None:
    """Makes a parser of single lines a table function for SQL: `name`(line) gives one row (ts, text, attrs, inferred,
    labels, parse_error), also for lines that the parser raises on; used with LATERAL over a table of lines."""

    class Parse:
        def eval(self, line: str):  # noqa: ANN202
            got = _outcome(parser, line)
            yield tuple(got[k] for k in ("ts", "text", "attrs", "inferred", "labels", "parse_error"))

    spark.udtf.register(name, F.udtf(Parse, returnType=OUTCOME))
