"""Boundary classes and likeness against a plain reading of the rules."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loglattice.functions import boundary

_WHEN = datetime(2025, 11, 2, 7, 1, 59, 4211)
#: Notations of one time, with text after them, one with text before it, and a stretch of known pairs without any digit.
NEW = [_WHEN.strftime(n) + tail for n, tail in (("%Y-%m-%d %H:%M:%S", ""), ("%Y-%m-%dT%H:%M:%S.%fZ", " x"), ("%b %d %H:%M:%S", " node"), ("%d/%b/%Y:%H:%M:%S", " +0100"), ("%Y/%m/%d %H:%M:%S", " [x]"))]
NEW += [f"took 3 s from {_WHEN:%Y-%m-%d %H:%M:%S} on", ", PM:, PM:, PM:, PM:"]


def _continued(seed: int) -> str:
    """A line of letters and marks, indented or not: nothing in it is part of a date."""
    random.seed(seed)
    words = ["".join(random.choices("bcdfghk", k=random.randint(1, 9))) + random.choice(["", "", ".", ":", "(", ")", '"', "->", "[", "]"]) for _ in range(random.randint(0, 9))]
    return random.choice(["", "\t", "  ", "    "]) + random.choice([" ", "", "/"]).join(words)


#: Such lines, and dates and times that are too short, too loose or no dates at all.
OLD = [*map(_continued, range(40)), f"{_WHEN:%Y-%m-%d} WARN x", f"{_WHEN:%y%m%d %H%M%S} 9 WARN", f"{_WHEN:%H:%M:%S}.250 WARN late", "am pm am pm", "may may", "T' T'"]


def plain_classes(line: str) -> list[str]:
    data = line.encode()[:60].decode("latin-1")
    return [boundary._class_of(m.group()) for m in re.finditer(boundary._RUN, data)]


def plain_likeness(classes: list[str]) -> float:
    """The best stretch by trying all of them in order of their ends, as a running sum would meet them."""
    known = set(boundary.known_pairs())
    if len(classes) < boundary.MIN_TOKENS:
        return 0.0
    steps = [1 if f"{a}>{b}" in known else -1 for a, b in zip(classes, classes[1:], strict=False)]
    best, run, start, found = None, 0, 0, (0, 0)
    for k, v in enumerate(steps):
        if k == 0 or run < 0:
            run, start = v, k
        else:
            run += v
        if best is None or run > best:
            best, found = run, (start, k + 1)
    size = found[1] - found[0]
    return best / size if size >= boundary.MIN_TOKENS else 0.0


@pytest.fixture(scope="module")
def scored(spark):
    random.seed(3)
    parts = [*boundary.TIMESTAMP_FORMATS, "é", "日本", " ", "\t", "x", "INFO", "12", "[", "]", "==", "T", "'", "z", "<*>", "PM", "may", ", ", ":", " Z", "+"]
    lines = [*NEW, *OLD, *boundary.TIMESTAMP_FORMATS, *(f[:k] for f in boundary.TIMESTAMP_FORMATS for k in (9, 14))]
    lines += ["".join(random.choice(parts) for _ in range(random.randint(1, 8))) for _ in range(600)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, content string")
    classes, codes = boundary.token_classes(F.col("content")), boundary.token_codes(F.col("content"))
    rows = df.select("k", "content", classes.alias("c"), boundary.timestamp_likeness(codes).alias("p"), boundary.is_new_entry(F.col("content")).alias("new")).orderBy("k").collect()
    return {r.content: r for r in rows}


def test_known_lines(scored):
    assert all(scored[x].new for x in NEW)
    assert not any(scored[x].new for x in OLD)
    missed = {f for f in boundary.TIMESTAMP_FORMATS if not scored[f].new}
    assert missed == {"11:42:35.173", "11:42:35,173"}


def test_classes_and_likeness_by_the_rules(scored):
    for line, row in scored.items():
        assert row.c == plain_classes(line), line
        assert row.p == pytest.approx(plain_likeness(row.c)), line
        assert row.new == (plain_likeness(row.c) > 0.5), line


def test_gate_lets_all_entries_pass():
    """Classes that the gate knows nothing of: no stretch of them scores over a half."""
    rest = sorted({c for c in boundary.CLASSES if not c.startswith("D")} - {"MTH", "APM"} - {f"C{n}" for n in range(2, 11)})
    known = set(boundary.known_pairs())
    free = [c for c in rest if any(f"{c}>{d}" in known or f"{d}>{c}" in known for d in rest)]
    random.seed(5)
    for _ in range(20_000):
        stretch = [random.choice(free)]
        while len(stretch) < 24:
            follow = [d for d in free if f"{stretch[-1]}>{d}" in known and (stretch[-1], d) not in {("T", "'"), ("'", "T")}]
            stretch.append(random.choice(follow or free))
        if any(pair in {("T", "'"), ("'", "T")} for pair in zip(stretch, stretch[1:], strict=False)):
            continue
        assert plain_likeness(stretch) <= 0.5


def test_null_and_regex(spark):
    df = spark.createDataFrame([(None,), ("#1 x",), ("y",)], "content string")
    assert [r[0] for r in df.select(boundary.is_new_entry(F.col("content"), "^#")).collect()] == [False, True, False]
    assert [r[0] for r in df.select(boundary.is_new_entry(F.col("content"))).collect()] == [False, False, False]
