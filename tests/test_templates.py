import itertools
import random
from collections import Counter

import pytest
from loglattice.operators import labels, reports, search, templates
from loglattice.plans import workspace
from loglattice.plans.stages import materialise
from loglattice.sources import logs, store
from pyspark.sql import functions as F


def lines(spark, texts):
    return spark.createDataFrame([("f", k, x) for k, x in enumerate(texts, 1)], "file_name string, start_line long, content string")


TEXTS = ["user 12|bob logged in", "user 7|bob logged in", "user 9|alice logged in", "user 8|alice logged in", "disk 1 full", "disk 2 full", "alone"]


def test_counts_are_kept_and_order_does_not_matter(spark):
    one = {r.raw_pattern: r["count"] for r in templates.discover_templates(lines(spark, TEXTS), min_count=1).collect()}
    two = {r.raw_pattern: r["count"] for r in templates.discover_templates(lines(spark, TEXTS[::-1]).repartition(3), min_count=1).collect()}
    assert one == two and sum(one.values()) == len(TEXTS)
    assert one["disk <*> full"] == 2 and one["alone"] == 1


def test_absorption(spark):
    texts = ["x 1 y z", "x 2 y z", "x foo y z", "q foo y z", "1 2 3 y", "7 8 9 y"]
    kept = {r.raw_pattern: r["count"] for r in templates.discover_templates(lines(spark, texts), min_count=1, absorb=False).collect()}
    assert kept == {"x <*> y z": 2, "x foo y z": 1, "q foo y z": 1, "<*> <*> <*> y": 2}
    joined = {r.raw_pattern: r["count"] for r in templates.discover_templates(lines(spark, texts), min_count=1).collect()}
    # "<*> <*> <*> y" shares too few tokens to take anything
    assert joined == {"x <*> y z": 3, "q foo y z": 1, "<*> <*> <*> y": 2}


def test_match_first_all_and_none(spark):
    given = spark.createDataFrame([("p1", "user <*> in", 1), ("p2", "user bob in", 2)], "pattern_id string, raw_pattern string, ord int")
    df = lines(spark, ["user bob in", "user eve in", "other"])
    got = {r.content: r.pattern_id for r in templates.match_templates(df, given, workspace.KEYS, order_col="ord").collect()}
    assert got == {"user bob in": "p1", "user eve in": "p1", "other": None}
    literal = {r.content: r.pattern_id for r in templates.match_templates(df, given, workspace.KEYS).collect()}
    assert literal["user bob in"] == "p2"
    assert templates.match_templates(df, given, workspace.KEYS, mode="all").count() == 3


def test_dir_names_skip_taken_ones(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, "a!"), (4, "a-2"), (5, "a"), (6, "///"), (7, "a-2")], "k int, semantic_id string")
    got = {r.k: r.dir_name for r in labels.with_dir_names(df, F.struct("k")).collect()}
    assert len(set(got.values())) == 7
    assert (got[1], got[2], got[4], got[6]) == ("a", "a-3", "a-2", "unknown")


def test_label_answers(spark):
    good = '[{"pattern_id":"p","semantic_id":"s","description":"d"}]'
    df = spark.createDataFrame([(good,), (f"```json\n{good}\n```",), ("nonsense",), ("```json\n[",), (f" {good}\n",)], "response string")
    parsed, failed = labels.parse_label_responses(df)
    assert parsed.count() == 2 and failed.count() == 3


def test_reports_and_rebuild(spark, tmp_path):
    raw = spark.createDataFrame([("f", k, f"2024-03-28 13:45:3{k % 10} ERROR disk {k} failed") for k in range(1, 9)] + [("g", 1, "2024-03-28 13:45:30 odd one")], "file_name string, line_no long, content string")
    for _ in range(2):
        done = workspace.build_workspace(raw, str(tmp_path), "My Topic!")
    stats = reports.pattern_stats(done.matched, done.labelled).collect()
    assert [(r["count"], r.first_line, r.last_line) for r in stats] == [(8, 1, 8)]
    summary = reports.corpus_summary(done.matched, done.labelled).first()
    assert (summary.file_count, summary.total_lines, summary.pattern_count, summary.unmatched_count) == (2, 9, 1, 1)
    assert reports.unmatched_errors(done.matched, done.labelled).count() == 0
    back = spark.read.text(f"{tmp_path}/workspace=my-topic")
    assert back.where("report = 'samples' and dir_name = 'unmatched'").count() == 1
    assert back.where("value like '- **Matches:** 8'").count() == 1


def test_files_numbers_and_blank_ends(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\n\r\nthree\n\n \n")
    (tmp_path / "b.log").write_bytes("x\ry\né".encode())
    got = {(r.file_name, r.line_no): r.content for r in logs.read_logs(spark, str(tmp_path)).collect()}
    assert got == {("a.log", 1): "one", ("a.log", 2): "", ("a.log", 3): "three", ("b.log", 1): "x\ry", ("b.log", 2): "é"}
    assert [r.file_name for r in logs.list_inputs(spark, str(tmp_path)).collect()] == ["a.log", "b.log"]


def test_store(spark, tmp_path):
    path = str(tmp_path)
    for _ in range(2):
        store.init_tables(spark, path)
    rows = spark.sql("select id line_number, id end_line_number, timestamp'2024-01-01' + make_interval(0,0,0,id) timestamp, 'r' raw, if(id = 3, null, map('pattern', 'p', 'pattern_id', 'i')) labels from range(1, 6)")
    store.append_logs(spark, path, rows)
    store.append_logs(spark, path, rows.limit(1))
    entries = store.read_entries(spark, path)
    assert sorted(r.id for r in entries.collect()) == [1, 2, 3, 4, 5, 6]
    assert entries.where("labels is null").count() == 0
    found = search.query_logs(entries, "p", F.to_timestamp(F.lit("2024-01-03")), F.to_timestamp(F.lit("2024-01-05")))
    assert [r.line_number for r in found.collect()] == [2, 4]
    patterns = spark.createDataFrame([("i", "t", "p", None, None, 1), ("i", "t", "p2", "s", None, 2), ("k", "t", "q", None, None, 1)], "pattern_id string, pattern_type string, raw_pattern string, semantic_id string, description string, ord int")
    store.upsert_patterns(spark, path, patterns, "ord")
    store.upsert_patterns(spark, path, patterns.where("pattern_id = 'k'"), "ord")
    assert [(r.pattern_id, r.raw_pattern, r.description) for r in store.read_patterns(spark, path).collect()] == [("i", "p2", ""), ("k", "q", "")]
    assert [r["count"] for r in search.pattern_summaries(entries, store.read_patterns(spark, path)).collect()] == [5]
    assert [r["count"] for r in search.pattern_counts(entries).collect()] == [5]


def test_unlike_lines_are_told_apart(spark):
    """Lines that share 27 tokens of 100 and nothing else."""
    head = " ".join(f"h{chr(97 + k)}" for k in range(27))
    texts = [f"{head} {' '.join(f'{kind}{chr(97 + k % 26)}{chr(97 + k // 26)}' for k in range(73))}" for kind in ("x", "y", "z") for _ in range(2)]
    got = {r.raw_pattern: (r["count"], r.low_similarity) for r in templates.discover_templates(lines(spark, texts)).collect()}
    assert got == {t: (2, False) for t in texts}
    # digits leave nothing to tell apart: one template, marked
    got = templates.discover_templates(lines(spark, ["1 2 3 4 a", "5 6 7 8 b"])).collect()
    assert [(r.raw_pattern, r["count"], r.low_similarity) for r in got] == [("<*> <*> <*> <*> <*>", 2, True)]


def test_crowded_places_are_wildcards(spark):
    letters = "abcdefghijklmnop"
    texts = [f"user {a}{b} logged in from {c} now" for a in letters for b in letters[:4] for c in "xyz"] + ["host up for us all day long"] * 3
    got = {r.raw_pattern: r["count"] for r in templates.discover_templates(lines(spark, texts), max_children=10).collect()}
    assert got == {"user <*> logged in from x now": 64, "user <*> logged in from y now": 64, "user <*> logged in from z now": 64, "host up for us all day long": 3}
    assert len(templates.discover_templates(lines(spark, texts), min_count=1).collect()) == 193


def test_accuracy(spark):
    rows = [("p", "A"), ("p", "A"), ("q", "B"), ("r", "B"), ("s", "C"), ("s", "D"), (None, "E")]
    got = templates.template_accuracy(spark.createDataFrame(rows, "pattern_id string, EventTemplate string")).first()
    assert (got.entries, got.correct) == (7, 2)


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_bytes(b"2024-03-28 13:45:30 one\r\n  more\n\n2024-03-28 13:45:31 two  \n")
    (tmp_path / "in" / "b.log").write_bytes(b"x\n \n\n")
    (tmp_path / "in" / "c.log").write_bytes(b" \n")
    query = logs.stream_logs(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("file_name", "line_no", "content").collect())
    assert got == [("a.log", 1, "2024-03-28 13:45:30 one"), ("a.log", 2, "  more"), ("a.log", 3, ""), ("a.log", 4, "2024-03-28 13:45:31 two  "), ("b.log", 1, "x")]
    assert got == sorted(tuple(r) for r in logs.read_logs(spark, str(tmp_path / "in")).collect())


def _many(seed, n):
    random.seed(seed)
    words = [f"w{k}" for k in range(60)]
    made = {" ".join(random.choice([templates.WILDCARD, random.choice(words)]) for _ in range(random.randint(1, 7))) for _ in range(n)}
    texts = [" ".join(random.choice(words) for _ in range(random.randint(1, 8))) for _ in range(150)] + ["", "w1"]
    return sorted(made), texts


@pytest.mark.parametrize("by_joins", [False, True])
@pytest.mark.parametrize("mode", ["first", "all"])
def test_many_templates_by_brute_force(spark, monkeypatch, by_joins, mode):
    if by_joins:
        monkeypatch.setattr(templates, "INDEX_TEMPLATES", 0)
    made, texts = _many(4, 900)
    covers = lambda p, t: len(p) == len(t) and all(a in (templates.WILDCARD, b) for a, b in zip(p, t, strict=True))
    want = Counter()
    for k, text in enumerate(texts):
        found = sorted((p for p in made if covers(p.split(" "), text.split(" "))), key=lambda p: (-sum(x != templates.WILDCARD for x in p.split(" ")), p))
        want.update((k, p) for p in (found if mode == "all" else [found[0] if found else None]))
    df = spark.createDataFrame([("f", k, x, 1) for k, x in enumerate(texts)], "file_name string, start_line long, content string, rank int").repartition(3)
    given = spark.createDataFrame([(f"id {p}", p) for p in made], "pattern_id string, raw_pattern string")
    matched = templates.match_templates(df, given, workspace.KEYS, mode=mode)
    assert Counter((r.start_line, r.raw_pattern) for r in matched.collect()) == want
    if mode == "first":
        assert matched.columns == [*df.columns, "pattern_id", "raw_pattern"]
        samples = templates.template_samples(df, given, workspace.KEYS, k=2).collect()
        of = {}
        for k, text in enumerate(texts):
            for p in made:
                if covers(p.split(" "), text.split(" ")):
                    of.setdefault(p, []).append((text, len(of.get(p, [])) + 1))
        assert sorted((r.raw_pattern, r.content, r["rank"]) for r in samples) == sorted((p, *x) for p, held in of.items() for x in held[:2])


def test_lines_are_not_moved_to_be_matched(spark):
    df = lines(spark, TEXTS)
    matched = templates.match_templates(df, templates.discover_templates(df), workspace.KEYS)
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and "MapInArrow" in plan


def test_tries_do_not_grow_with_templates():
    """10,000 templates: a line compares few of them."""
    made = [["job", f"k{k}", templates.WILDCARD, "in", f"zone{k % 7}"] for k in range(10_000)]
    index = templates.TemplateIndex([(t, k) for k, t in enumerate(made)])
    assert [len(held) for held in index.anchored[5].values()] == [10_000] and all(len(x) == 1 for x in index.anchored[5][1].values())
    assert index.first(["job", "k77", "x", "in", "zone0"]) == 77 and index.first(["job", "k77", "x", "in", "zone1"]) is None


def test_no_task_sorts_the_tokens_of_its_lines(spark):
    """Shapes are kept in hash tables, whose size is that of the shapes, whatever the lines."""
    df = lines(spark, TEXTS)
    for found in (templates.shapes(df), templates.line_shapes(df), templates.merge_shapes(templates.line_shapes(df), templates.line_shapes(df))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_shapes_of_odd_tokens(spark):
    """Tokens that are empty, that begin others, of zero bytes, of more bytes than letters and of many numbers."""
    random.seed(11)
    odd = ["", "1", "\x00", "\x001", "1\x00", "abcdef1", "abcdef12", "abcdefg", "x1" * 7, "x1" * 7 + "y", "é1éé", "日本語1", "<*>", "7" * 700, "7" * 699 + "8"]
    texts = ["w" + "".join(f" {random.choice(odd)}" for _ in range(random.randint(1, 4))) + " z" for _ in range(800)] + [None, ""]
    want: dict[tuple, list] = {}
    for text in filter(None, texts):
        tokens = text.split(" ")
        held = want.setdefault((len(tokens), tuple("<*>" if any(c.isdigit() for c in t) else t for t in tokens[:-1])), [tokens, 0])
        held[0], held[1] = [a if a == b else "<*>" for a, b in zip(held[0], tokens, strict=True)], held[1] + 1
    got = {(r.n, tuple(r.path)): [r.tokens, r["count"]] for r in templates.shapes(lines(spark, texts).repartition(3)).collect()}
    assert got.pop((1, ())) == [[""], 1] and got == want


def _sorts(df) -> list[bool]:
    """Of each sort in a plan whether what it sorts are groups or chosen lines, and not all that was read."""
    plan = [(len(x) - len(x.lstrip(" :+-")), x.lstrip(" :+-")) for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    found = []
    for k, (depth, node) in enumerate(plan):
        if node.startswith("Sort"):
            below = [x for at, x in itertools.takewhile(lambda x: x[0] > depth, plan[k + 1 :])]
            found.append(any(x.startswith("HashAggregate") or "LeftSemi" in x for x in below))
    return found


def test_no_task_sorts_its_lines_for_the_first_and_last(spark):
    """Statistics and samples sort groups and chosen lines only."""
    given = spark.createDataFrame([("p1", "user <*> in"), ("p2", "user bob in")], "pattern_id string, raw_pattern string")
    df = lines(spark, ["user bob in", "user eve in"])
    matched = materialise(templates.match_templates(df, given, workspace.KEYS))
    labelled = materialise(labels.apply_labels(given.withColumn("count", F.lit(1)), labels.default_labels(given)))
    sorts = _sorts(reports.pattern_stats(matched, labelled)), _sorts(reports.pattern_samples(matched, labelled))
    assert all(sorts) and all(map(all, sorts))
    # the lines are chosen by then
    assert not _sorts(templates.template_samples(materialise(df), given, workspace.KEYS))


@pytest.mark.parametrize(("stretch", "k"), [(1, 3), (4, 1), (4, 7), (1000, 5)])
def test_first_lines(spark, monkeypatch, stretch, k):
    """Against all lines in order: stretches with fewer than k lines of a pattern, several files, gaps, one without a name."""
    monkeypatch.setattr(templates, "FIRST_LINES", stretch)
    random.seed(stretch + k)
    rows = [(random.choice("abcd"), random.choice(["f", "g", None]), line, f"x{line}") for line in random.sample(range(100), 60)]
    rows += [("rare", "g", 99, "last"), (None, "f", 100, "none"), (None, "f", 7, "none")]
    got = templates.first_lines(spark.createDataFrame(rows, "pattern_id string, file_name string, start_line long, content string").repartition(3), workspace.KEYS, k).collect()
    want = {}
    for pattern, name, line, content in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2])):
        held = want.setdefault(pattern, [])
        if len(held) < k:
            held.append((name, line, content, len(held) + 1))
    assert {p: sorted(((r.file_name, r.start_line, r.content, r["rank"]) for r in got if r.pattern_id == p), key=lambda x: x[3]) for p in {r.pattern_id for r in got}} == want


def test_statistics_over_files(spark):
    """The first and last line of a pattern are by file, then by line."""
    rows = [("p", "b", 1), ("p", "a", 30), ("p", "b", 9), ("p", "a", 4), ("q", "c", 2)]
    matched = spark.createDataFrame([(*r, "x") for r in rows], "pattern_id string, file_name string, start_line long, content string").repartition(2)
    labelled = spark.createDataFrame([(p, p, p, p, p) for p in "pqr"], "pattern_id string, raw_pattern string, semantic_id string, description string, dir_name string")
    got = {r.pattern_id: (r["count"], r.first_file, r.first_line, r.last_file, r.last_line) for r in reports.pattern_stats(matched, labelled).collect()}
    assert got == {"p": (4, "a", 4, "b", 9), "q": (1, "c", 2, "c", 2), "r": (0, None, None, None, None)}
