"""Tool-call linking: calls and results joined by identifier, put in topological order, checked and serialised.

Calls and results are dealt to partitions by the hash of (conv_id, call_id); in each, the results are a hash table that
the calls look into, and unmatched rows of both sides are kept. An identifier has one row on each side by then, so no
partition can be hot, and there are as many as keep the results of one at about `JOIN_BYTES`. A call may depend
on others of its conversation; its level is 0 without such, else one above the highest level it depends on, and
sorting by (level, position) is topological. Calls are cut into chunks of bounded size in the order of
conversation and position, so that most conversations are whole in one; a task settles what it can of a chunk, and
levels that other chunks wait for are joined to them before the next round. There are as many rounds as the longest
chain crosses from chunk to chunk, and no conversation needs to fit a task; calls on or behind a cycle are never settled.

Arguments are parsed and checked against the tool's schema (type, properties, required, additionalProperties,
enum, items, minimum, maximum); every linked row becomes canonical JSON: keys sorted, no white space, other
letters than ASCII as they are.

Defined results: rows with a null conv_id or call_id are left out; of repeated call or result ids in a
conversation the one with the smallest position (then text) counts; dependencies on unknown ids are ignored
for the order and reported; a null position is smaller than all others and stays null, its call or result
is linked like any other; a schema with an unknown type is an error before any task runs; null or malformed arguments, numbers beyond a double or of over 4,300 digits and values
nested deeper than 100 levels are errors, and `arguments` is null in the JSON; surrogates without their partner stay
escaped (\\ud800); of repeated names in an object the last counts; very long arguments are no special case; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bytes of results in a partition of the join, and rows.
JOIN_BYTES, _JOIN_ROWS = 16 << 20, 100_000
_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
        return not isinstance(value, bool) and (whole or kind == "number" and isinstance(value, float))
    return isinstance(value, _TYPES[kind])


def check_schema(schema: dict[str, Any], at: str) -> None:
    """Raises ValueError where a schema, or one inside it, names a type that JSON doesn't have."""
    kinds = schema.get("type", [])
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in (*_TYPES, "integer", "number"):
            raise ValueError(f"{at}: {kind!r} is no type")
    for name, field in schema.get("properties", {}).items():
        check_schema(field, f"{at}.{name}")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def violations(value: Any, schema: dict[str, Any], path: str = "") -> list[str]:
    """What of `schema` doesn't hold, each with the path of the value it is about."""
    at = path or "arguments"
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not among the allowed values")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            found.append(f"{at}: below {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            found.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        found += [f"{at}: {name} is missing" for name in sorted(schema.get("required", [])) if name not in value]
        for name in sorted(value):
            if name in fields:
                found += violations(value[name], fields[name], f"{path}.{name}" if path else name)
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}: {name} is unknown")
    if isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            found += violations(item, schema["items"], f"{path}[{k}]")
    return found


def canonical(value: Any) -> str:
    return _escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _escaped(text: str) -> str:
    """Surrogates without their partner, which UTF-8 has no bytes for, as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


_DEEPEST = 100
_NESTING = re.compile(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', re.DOTALL)


def _too_deep(text: str) -> bool:
    if text.count("[") + text.count("{") <= _DEEPEST:
        return False
    depth = 0
    for m in _NESTING.finditer(text):
        depth += (m[0] in "[{") - (m[0] in "]}")
        if depth > _DEEPEST:
            return True
    return False


def _parsed(text: str | None) -> tuple[Any, str | None]:
    """The value of a JSON text, and what is wrong with it."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    def double(digits: str) -> float:
        if math.isinf(value := float(digits)):
            raise OverflowError
        return value

    def whole(digits: str) -> int:
        if len(digits) > 4300:
            raise OverflowError
        return int(digits)

    if _too_deep(text or ""):
        return None, f"arguments: nested deeper than {_DEEPEST} levels"
    try:
        return json.loads(text or "", parse_constant=refuse, parse_float=double, parse_int=whole), None
    except OverflowError:
        return None, "arguments: number out of range"
    except ValueError:
        return None, "arguments: not JSON"


def _settle(part: pa.Table) -> pa.Table:
    """Levels of the calls of a chunk that wait for no other chunk; the others keep what they still wait for."""
    rows = part.to_pylist()
    at = {(r["conv_id"], r["call_id"]): k for k, r in enumerate(rows)}
    waiting = [len(r["inner"]) + len(r["outer"]) for r in rows]
    level = [r["base"] for r in rows]
    needed_by: dict[int, list[int]] = defaultdict(list)
    for k, r in enumerate(rows):
        for name in r["inner"]:
            needed_by[at[r["conv_id"], name]].append(k)
    ready = [k for k, n in enumerate(waiting) if not n]
    for k in ready:  # grows as it is read
        for other in needed_by[k]:
            level[other] = max(level[other], level[k] + 1)
            waiting[other] -= 1
            if not waiting[other]:
                ready.append(other)
    done = set(ready)
    for k, r in enumerate(rows):
        r["level"], r["base"] = (level[k] if k in done else None), level[k]
        r["inner"] = [name for name in r["inner"] if at[r["conv_id"], name] not in done]
    return pa.Table.from_pylist(rows, part.schema.append(pa.field("level", pa.int32())))


def topological_levels(calls: DataFrame, chunk_rows: int = 20_000) -> DataFrame:
    """conv_id, call_id and level of each call (conv_id, call_id, position, depends_on; ids unique); level null: on or
    behind a cycle."""
    chunks = max(1, math.ceil(calls.count() / chunk_rows))
    ranged = calls.repartitionByRange(chunks, "conv_id", "position", "call_id").withColumn("chunk", F.spark_partition_id())
    ranged = materialise(ranged.select("chunk", "conv_id", "call_id", F.array_distinct("depends_on").alias("needs")))
    known = ranged.select("conv_id", F.col("call_id").alias("need"), F.col("chunk").alias("where"))
    edges = ranged.select("chunk", "conv_id", "call_id", F.explode("needs").alias("need")).join(known, ["conv_id", "need"])
    inside = F.col("where") == F.col("chunk")
    some = lambda c: F.collect_list(F.when(c, F.col("need")))
    needs = edges.groupBy("conv_id", "call_id").agg(some(inside).alias("inner"), some(~inside).alias("outer"))
    none = F.array().cast("array<string>")
    nodes = ranged.join(needs, ["conv_id", "call_id"], "left").select("chunk", "conv_id", "call_id", F.lit(0).alias("base"), F.coalesce("inner", none).alias("inner"), F.coalesce("outer", none).alias("outer"))
    kind = calls.schema["conv_id"].dataType.simpleString()
    settled: list[DataFrame] = []
    schema = f"chunk int, conv_id {kind}, call_id string, base int, inner array<string>, outer array<string>, level int"
    while True:
        seen = materialise(nodes.groupBy("chunk").applyInArrow(_settle, schema))
        fresh, rest = seen.where("level is not null"), seen.where("level is null")
        settled.append(fresh.select("conv_id", "call_id", "level"))
        if rest.isEmpty() or fresh.isEmpty():
            break
        done = fresh.select("conv_id", F.col("call_id").alias("need"), "level")
        asked = rest.select("conv_id", "call_id", F.explode("outer").alias("need")).join(done, ["conv_id", "need"], "left")
        told = asked.groupBy("conv_id", "call_id").agg((F.max("level") + 1).alias("above"), some(F.col("level").isNull()).alias("open"))
        nodes = rest.join(told, ["conv_id", "call_id"], "left").select("chunk", "conv_id", "call_id", F.greatest("base", "above").alias("base"), "inner", F.coalesce("open", none).alias("outer"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return ranged.select("conv_id", "call_id").join(out, ["conv_id", "call_id"], "left")


def _first_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of each (conv_id, call_id) the row with the smallest position, then the other columns."""
    good = df.where("conv_id is not null and call_id is not null")
    return good.groupBy("conv_id", "call_id").agg(F.min(F.struct("position", *columns)).alias("first")).select("conv_id", "call_id", "first.*")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, Any]]) -> DataFrame:
    """conv_id, call_id, position, level, status (linked, no_result, no_call), valid, errors (joined by "; ") and
    canonical (JSON) for each call of `calls` (conv_id, call_id, position, name, arguments, depends_on) and each
    result of `results` (conv_id, call_id, position, content) without one."""
    for name, schema in schemas.items():
        check_schema(schema, name)
    calls = materialise(_first_of(calls, ["name", "arguments", "depends_on"]))
    results = materialise(_first_of(results, ["content"]).select("conv_id", "call_id", F.col("position").alias("answered"), "content", F.lit(True).alias("replied")))
    levels = topological_levels(calls)
    lost = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("needs"))
    ids = calls.select("conv_id", F.col("call_id").alias("needs"))
    lost = lost.join(ids, ["conv_id", "needs"], "left_anti").groupBy("conv_id", "call_id").agg(F.array_sort(F.collect_set("needs")).alias("lost"))
    ordered = calls.join(levels, ["conv_id", "call_id"]).join(lost, ["conv_id", "call_id"], "left")
    size, count = results.agg(F.sum(F.octet_length("content")), F.count("*")).first()
    partitions = max(1, math.ceil((size or 0) / JOIN_BYTES), math.ceil(count / _JOIN_ROWS))
    keys = ["conv_id", "call_id"]
    table = results.repartition(partitions, *keys).hint("shuffle_hash")
    linked = ordered.withColumn("called", F.lit(True)).repartition(partitions, *keys).join(table, keys, "full_outer")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in ("call_id", "called", "replied", "name", "arguments", "content", "level", "lost")}
            out: dict[str, list] = {"status": [], "valid": [], "errors": [], "canonical": []}
            for row in (dict(zip(columns, values, strict=True)) for values in zip(*columns.values(), strict=True)):
                errors, arguments = [], None
                if row["called"]:
                    arguments, wrong = _parsed(row["arguments"])
                    if wrong:
                        errors.append(wrong)
                    elif row["name"] not in schemas:
                        errors.append("name: unknown tool")
                    else:
                        errors += violations(arguments, schemas[row["name"]])
                    errors += [f"depends_on: {x} is unknown" for x in row["lost"] or ()]
                    if row["level"] is None:
                        errors.append("depends_on: cycle")
                out["status"].append("no_call" if not row["called"] else "linked" if row["replied"] else "no_result")
                out["valid"].append(bool(row["called"]) and not errors)
                out["errors"].append(_escaped("; ".join(errors)))
                out["canonical"].append(canonical({"arguments": arguments, "call_id": row["call_id"], "name": row["name"], "result": row["content"]}))
            arrays = [pa.array(out["status"], pa.string()), pa.array(out["valid"], pa.bool_()), pa.array(out["errors"], pa.string()), pa.array(out["canonical"], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("call_id"), batch.column("at"), batch.column("level"), *arrays], ["conv_id", "call_id", "position", "level", *out])

    rows = linked.withColumn("at", F.coalesce("position", "answered").cast("long")).drop("position", "depends_on")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(check, f"conv_id {kind}, call_id string, position long, level int, status string, valid boolean, errors string, canonical string")
