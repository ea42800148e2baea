"""Classifiers by held-out accuracy and odd rows; language phrases and tool calls by brute force."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglattice.llm import language, quality, toolcalls, toxicity
from loglattice.llm.common import crc_bucket, table

from .cases import frame, texts

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


def accuracy(scored, labels, label, fold):
    joined = scored.where(fold).join(labels, "doc_id").select((F.col("score") >= 0.5).cast("int").alias("p"), F.col(label).alias("y")).toPandas()
    return float((joined.p == joined.y).mean()), joined


def test_toxicity_on_held_out_documents(spark, docs, labels):
    fold = crc_bucket("doc_id", 5)
    model = toxicity.train(docs, labels, "toxic", fold > 0)
    right, joined = accuracy(toxicity.score(docs, model), labels, "toxic", fold == 0)
    assert right > max(0.85, 1 - joined.y.mean())
    odd = toxicity.score(frame(spark), model).collect()
    assert len(odd) == len(texts()) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_toxicity_without_labels(spark, docs, labels):
    model = toxicity.train(docs, labels.limit(0), "toxic", F.lit(True))
    assert {r.score for r in toxicity.score(frame(spark), model).collect()} == {0.5}
    one = toxicity.train(frame(spark), spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int"), "toxic", F.lit(True))
    assert all(r.score > 0.99 for r in toxicity.score(frame(spark), one).collect())


def test_ratios_and_distinct_features():
    features = toxicity.Features()
    assert len(features.of(b"")) == 0
    for text in (b"abcabcabc", b"xyz " * 30, b"A-b"):
        found = features.of(text)
        assert len(set(found.tolist())) == len(found)
    assert set(features.of(b"abc def").tolist()) == set(features.of(b"ABC-def").tolist())
    rows = [np.array([1, 2]), np.array([1, 3]), np.array([1])]
    ratios = toxicity.log_ratios(rows, np.array([1, 0, 1]), 3, least=1, weakest=0.0)
    p, n = np.array([1, 3, 2, 1, 1, 1, 1, 1]) / 11, np.array([1, 2, 1, 2, 1, 1, 1, 1]) / 10
    assert np.allclose(ratios, np.where([0, 1, 1, 1, 0, 0, 0, 0], np.log(p / n), 0))


def test_quality_on_held_out_documents(spark, docs, labels):
    fold = crc_bucket("doc_id", 3)
    model = quality.train(docs, labels, "quality", (fold >= 0) & (fold != 1))
    scored = quality.score(docs, model).select("row.doc_id", "score")
    right, joined = accuracy(scored, labels, "quality", fold == 1)
    assert right > max(0.95, joined.y.mean())
    odd = quality.score(frame(spark), model)
    assert odd.count() == len(texts()) and odd.where("score between 0 and 1").count() == len(texts())
    assert quality.keep_good(frame(spark), model).columns == frame(spark).columns
    # the compiled columns say what the rules say
    rows = quality.score(docs.limit(50), model).select("row.text", "score").collect()
    stats = np.array([quality.statistics_of((r.text or "").encode()) for r in rows])
    z = model.bias + sum(w * np.all([c.holds(stats) for c in rule], axis=0) for rule, w in model.rules)
    assert np.allclose([r.score for r in rows], 1 / (1 + np.exp(-z)))


def test_quality_without_labels(spark, docs, labels):
    model = quality.train(docs, labels.limit(0), "quality", F.lit(True))
    assert model.rules == [] and quality.score(frame(spark), model).where("abs(score - 0.5) < 1e-9").count() == len(texts())
    assert quality.statistics_of(b"") == (0.0,) * len(quality.STATISTICS)


def test_languages_on_held_out_documents(spark, docs):
    fold = crc_bucket("doc_id", 4)
    samples = language.sample(docs, (fold >= 0) & (fold != 2))
    assert set(samples) == {"de", "en", "es", "fr"}
    got = language.identify(docs, samples).where(fold == 2).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95
    odd = language.identify(frame(spark), samples).collect()
    assert len(odd) == len(texts())
    by_id = {r.doc_id: r for r in odd}
    assert by_id[6].lang_pred == by_id[7].lang_pred == by_id[8].lang_pred == "und" and by_id[6].score == 0
    assert {r.lang_pred for r in language.identify(frame(spark), {}).collect()} == {"und"}
    assert language.sample(frame(spark).withColumn("lang", F.lit(None).cast("string")), F.lit(True)) == {}


def test_phrases_by_brute_force():
    random.seed(2)
    for _ in range(60):
        samples = {name: ["".join(random.choice("abc") for _ in range(random.randint(1, 12))) for _ in range(2)] for name in "xy"}
        parser = language.Parser(samples)
        held = ["".join(random.choice("abcd") for _ in range(random.randint(0, 30))) for _ in range(4)]
        want = []
        for text in held:
            want.append([])
            for name in "xy":
                at = count = 0
                while at < len(text):
                    size = 0
                    while at + size < len(text) and any(text[at : at + size + 1] in s for s in samples[name]):
                        size += 1
                    at, count = at + max(1, size), count + 1
                want[-1].append(count)
        assert parser.phrases([parser.codes(language.letters_of(t)) for t in held]).tolist() == want


def test_phrases_with_many_letters():
    random.seed(3)
    letters = [chr(p) for start in (0x61, 0x3B1, 0x430, 0x5D0, 0x4E00) for p in range(start, start + 24)]
    samples = {name: ["".join(random.choice(letters[at : at + 60]) for _ in range(300))] for name, at in (("x", 0), ("y", 40), ("z", 60))}
    held = [samples["x"][0][20:40] + samples["z"][0][90:120] + samples["y"][0][5:9], "".join(random.choice(letters) for _ in range(40))]
    want = []
    for text in held:
        want.append([])
        for name in "xyz":
            at = count = 0
            while at < len(text):
                size = 1
                while at + size < len(text) and text[at : at + size + 1] in samples[name][0]:
                    size += 1
                at, count = at + size, count + 1
            want[-1].append(count)
    for parser in (language.Parser(samples), language.Parser(samples, dense_bytes=0)):
        assert parser.phrases([parser.codes(language.letters_of(t)) for t in held]).tolist() == want


def _phrases(text, sample):
    at = count = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, count = at + size, count + 1
    return count


@pytest.mark.parametrize("segment", [1, 3, 16, 512])
def test_phrases_run_on_over_segments(monkeypatch, segment):
    random.seed(segment)
    monkeypatch.setattr(language, "SEGMENT", segment)
    samples = {name: ["".join(random.choice("abcde") for _ in range(400))] for name in "xy"}
    copied = samples["x"][0]
    held = [copied, copied[100:] + copied[:100], copied[:390] + "q" + copied, "".join(random.choice("abcdeq") for _ in range(900)), "a", "", copied[:2] * 40]
    parser = language.Parser(samples)
    assert parser.phrases([parser.codes(language.letters_of(t)) for t in held]).tolist() == [[_phrases(t, samples[name][0]) for name in "xy"] for t in held]


def test_texts_of_many_scripts(spark):
    random.seed(6)
    ranges = {"el": (0x3B1, 0x3C9), "ja": (0x3042, 0x3093), "ru": (0x430, 0x44F), "zh": (0x4E00, 0x5500), "ko": (0xAC00, 0xAC80)}
    text = lambda name, n: "".join(chr(random.randint(*ranges[name])) for _ in range(n))
    samples = {name: [text(name, 3000)] for name in ranges}
    rows = [(k, samples[name][0][500:700]) for k, name in enumerate(sorted(ranges))] + [(10 + k, text(name, 80)) for k, name in enumerate(sorted(ranges))]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), samples).collect()}
    assert [got[k][0] for k in range(5)] == sorted(ranges) and all(got[k][1] > 0.9 for k in range(5))
    assert [got[10 + k][0] for k in range(3)] == ["el", "ja", "ko"]


def test_samples_are_whole_texts(spark):
    rows = [(1, "a" * 50, "x"), (2, "b" * 60, "x"), (3, "c" * 5000, "x"), (4, "d" * 3000, "y"), (5, "e" * 2000, "y"), (6, "", "z"), (7, None, "z"), (8, "f", None)]
    got = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), max_chars=100)
    assert {k: sorted(map(len, v)) for k, v in got.items()} in ({"x": [50], "y": [2000]}, {"x": [60], "y": [2000]})
    assert language.identify(spark.createDataFrame([], "doc_id long, text string"), got).count() == 0


def test_more_languages_than_a_pass(spark):
    random.seed(4)
    alphabets = {f"l{k:02}": [chr(0x4E00 + 40 * k + j) for j in range(40)] for k in range(70)}
    text = lambda name: "".join("".join(alphabets[name][at : at + 5]) for at in random.choices(range(0, 40, 5), k=16))
    rows = [(k, text(name), name) for k, name in enumerate(sorted(alphabets) * 2)] + [(500, " ", None), (501, None, "l00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.sample(docs, F.col("doc_id") < 70)
    assert set(samples) == set(alphabets)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, samples).collect()}
    assert all(got[d][0] == lang for d, _, lang in rows[:140]) and got[500] == got[501] == ("und", 0.0)
    assert got == {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, samples, per_pass=30).collect()}
    assert got == {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, samples, per_pass=100).collect()}


def test_tool_calls(spark):
    schema = {"type": "object", "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "string"}}, "c": {"enum": ["x"]}}, "required": ["a"], "additionalProperties": False}
    good = '{"b": ["é"], "a": 1}'
    calls = [
        (1, "c1", 1, "t", good, ["c2"]), (1, "c2", 2, "t", '{"a": 0}', ["c3"]), (1, "c3", 3, "t", '{"b": [1], "d": 2}', None), (1, "c1", 9, "t", "{}", None),
        (2, "p", 1, "t", good, ["q"]), (2, "q", 2, "t", good, ["p"]), (2, "r", 3, "t", good, ["zz"]), (3, "x", 1, "none", "{", None), (3, "y", 2, None, None, ["x"]), (None, "n", 1, "t", good, None),
    ]
    results = [(1, "c1", 4, "first"), (1, "c1", 5, "second"), (2, "lost", 6, "alone"), (3, "x", 2, None)]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, position int, name string, arguments string, depends_on array<string>")
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link_tool_calls(df, spark.createDataFrame(results, "conv_id long, call_id string, position int, content string"), {"t": schema}).collect()}
    assert len(got) == 9
    assert [got[1, c].level for c in ("c3", "c2", "c1")] == [0, 1, 2]
    assert got[1, "c1"].valid and json.loads(got[1, "c1"].canonical) == {"arguments": {"a": 1, "b": ["é"]}, "call_id": "c1", "name": "t", "result": "first"}
    assert got[1, "c1"].canonical.startswith('{"arguments":{"a":1,"b":["é"]},')
    assert got[1, "c2"].errors == "a: below 1"
    assert got[1, "c3"].errors == "arguments: a is missing; b[0]: not of type string; arguments: d is unknown"
    assert got[2, "p"].level is None and "cycle" in got[2, "q"].errors and got[2, "r"].errors == "depends_on: zz is unknown" and got[2, "r"].level == 0
    assert got[2, "lost"].status == "no_call" and got[3, "y"].status == "no_result" and got[3, "y"].errors == "arguments: not JSON"
    assert got[3, "x"].status == "linked"
    empty = toolcalls.link_tool_calls(df.limit(0), spark.createDataFrame([], "conv_id long, call_id string, position int, content string"), {})
    assert empty.count() == 0


@pytest.mark.parametrize(
    ("arguments", "error", "kept"),
    [
        ('{"a": 1e400}', "arguments: number out of range", "null"), ('{"a": -1e400}', "arguments: number out of range", "null"), ('{"a": NaN}', "arguments: not JSON", "null"),
        ('{"a": ' + "9" * 5000 + "}", "arguments: number out of range", "null"), ("[" * 5000 + "]" * 5000, "arguments: nested deeper than 100 levels", "null"), ("[" * 100_000, "arguments: nested deeper than 100 levels", "null"),
        ('{"a": "' + "[" * 500 + '"}', None, '{"a":"' + "[" * 500 + '"}'), ('{"b": "\\ud800"}', None, '{"b":"\\ud800"}'), ('{"\\udfff": 1}', None, '{"\\udfff":1}'), ('{"a": "\\ud83d\\ude00"}', None, '{"a":"😀"}'),
        ('{"a": 1, "a": 2}', None, '{"a":2}'), ("", "arguments: not JSON", "null"), ("x" * 200_000, "arguments: not JSON", "null"), ('{"a": "' + "x" * 200_000 + '"}', None, '{"a":"' + "x" * 200_000 + '"}'),
    ],
)
def test_odd_arguments(spark, arguments, error, kept):
    value, wrong = toolcalls._parsed(arguments)
    assert wrong == error and toolcalls.canonical(value) == kept
    toolcalls.canonical(value).encode()
    assert toolcalls.violations(value, {"type": "object"}) == [] or error or isinstance(value, list)


def test_odd_arguments_in_rows(spark):
    texts = ['{"a": 1e400}', '{"\\ud800": "\\ud800"}', "[" * 3000, None, ""]
    calls = spark.createDataFrame([(1, f"c{k}", k, "t", t, None, "x") for k, t in enumerate(texts)], "conv_id long, call_id string, position int, name string, arguments string, depends_on array<string>, level string")
    results = spark.createDataFrame([(1, "c1", 9, None, 5)], "conv_id long, call_id string, position int, content string, status int")
    got = {r.call_id: r for r in toolcalls.link_tool_calls(calls, results, {"t": {"type": "object", "additionalProperties": False}}).collect()}
    assert [got[f"c{k}"].errors.split(": ", 1)[1] for k in range(5)] == ["number out of range", "\\ud800 is unknown", "nested deeper than 100 levels", "not JSON", "not JSON"]
    assert got["c1"].status == "linked" and '"\\ud800":"\\ud800"' in got["c1"].canonical


@pytest.mark.parametrize("chunk_rows", [20_000, 7])
def test_levels_by_brute_force(spark, chunk_rows):
    random.seed(chunk_rows)
    needs = {}
    for conv in range(4):
        for k in range(40):
            back, ahead = [random.randrange(k) for _ in range(random.choice([0, 1, 1, 2]) if k else 0)], [k + 1] if k % 9 == 4 else []
            needs[conv, f"c{k}"] = [f"c{x}" for x in (back if not ahead else ahead)]
        for k in range(1, 30):  # a chain
            needs[conv, f"d{k}"] = [f"d{k - 1}"] if k > 1 else []
        needs[conv, "e"], needs[conv, "f"], needs[conv, "g"], needs[conv, "h"] = ["f"], ["e"], ["f", "c1"], ["h"]
    levels = dict.fromkeys(needs)
    for _ in range(len(needs)):
        for (conv, name), wanted in needs.items():
            below = [levels[conv, w] for w in wanted]
            if None not in below:
                levels[conv, name] = max([0, *(b + 1 for b in below)])
    rows = [(conv, name, k, [*wanted, "unknown"] if k % 5 == 0 else wanted or None) for k, ((conv, name), wanted) in enumerate(needs.items())]
    got = toolcalls.topological_levels(spark.createDataFrame(rows, "conv_id long, call_id string, position int, depends_on array<string>"), chunk_rows).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == levels and max(x for x in levels.values() if x is not None) >= 28
    assert sum(x is None for x in levels.values()) >= 16


_CALLS = "conv_id long, call_id string, position int, name string, arguments string, depends_on array<string>"
_RESULTS = "conv_id long, call_id string, position int, content string"


def test_calls_without_a_position(spark):
    calls = spark.createDataFrame([(1, "a", None, "t", "{}", None), (1, "b", 3, "t", "{}", ["a"]), (1, "b", None, "t", "[]", None)], _CALLS)
    results = spark.createDataFrame([(1, "a", None, "one"), (1, "c", None, "alone"), (1, "b", 7, "two")], _RESULTS)
    got = {r.call_id: r for r in toolcalls.link_tool_calls(calls, results, {"t": {"type": "object"}}).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "linked", "b": "linked", "c": "no_call"}
    assert {k: r.position for k, r in got.items()} == {"a": None, "b": 7, "c": None}
    assert got["b"].errors == "arguments: not of type object" and json.loads(got["a"].canonical)["result"] == "one"


@pytest.mark.parametrize("schema", [{"type": "text"}, {"type": "object", "properties": {"a": {"type": ["string", "float"]}}}, {"type": "array", "items": {"type": "date"}}])
def test_unknown_types_are_told_before_any_task(spark, schema):
    with pytest.raises(ValueError, match="is no type"):
        toolcalls.link_tool_calls(spark.createDataFrame([], _CALLS), spark.createDataFrame([], _RESULTS), {"t": schema})


def test_calls_are_joined_by_hash(spark, monkeypatch):
    """The results are cut into hash tables of bounded size, whatever the statistics say."""
    monkeypatch.setattr(toolcalls, "JOIN_BYTES", 1000)
    calls = spark.createDataFrame([(k, "a", 1, "t", "{}", None) for k in range(300)], _CALLS)
    results = spark.createDataFrame([(k, "a", 2, "x" * 40) for k in range(100, 400)], _RESULTS)
    linked = toolcalls.link_tool_calls(calls, results, {"t": {}})
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [conv_id" in plan and "hashpartitioning(conv_id" in plan and ", 12)" in plan
    assert sorted((r.conv_id, r.status) for r in linked.collect()) == [(k, "no_result" if k < 100 else "linked" if k < 300 else "no_call") for k in range(400)]


def test_repeated_rows_are_learned_from_once(spark):
    rows = [*[(5, f"ein text der oft da ist {k % 3}", "de") for k in range(1000)], *[(k, f"un autre texte {k}", "fr") for k in range(60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sample(docs, F.lit(True))
    assert sorted(got["de"]) == [f"ein text der oft da ist {k}" for k in range(3)] and len(got["fr"]) == len(set(got["fr"])) == 24
    assert language.identify(docs, got).count() == 1060
