"""Does a line begin a log entry? Timestamp likeness of its first bytes as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The timestamp notations that a new entry may show, and the words with a class of their own.
TIMESTAMP_FORMATS = (
    "2024-03-28T13:45:30.123456Z",
    "28/Mar/2024:13:45:30",
    "Sun, 28 Mar 2024 13:45:30",
    "2024-03-28 13:45:30",
    "2024-03-28 13:45:30,123",
    "02 Jan 06 15:04 MST",
    "2024-03-28T14:33:53.743350Z",
    "2024-03-28T15:19:38.578639+00:00",
    "2024-03-28 15:44:53",
    "2024-08-20'T'13:20:10*633+0000",
    "2024 Mar 03 05:12:41.211 PDT",
    "Jan 21 18:20:11 +0000 2024",
    "19/Apr/2024:06:36:15",
    "Dec 2, 2024 2:39:58 AM",
    "Jun 09 2024 15:28:14",
    "Apr 20 00:00:35 2010",
    "Sep 28 19:00:00 +0000",
    "Mar 16 08:12:04",
    "Jul 1 09:00:55",
    "2024-10-14T22:11:20+0000",
    "2024-07-01T14:59:55.711",
    "2024-07-01T14:59:55.711Z",
    "2024-08-19 12:17:55-0400",
    "2024-06-26 02:31:29,573",
    "2024/04/12*19:37:50",
    "2024 Apr 13 22:08:13.211*PDT",
    "2024 Mar 10 01:44:20.392",
    "2024-03-10 14:30:12,655+0000",
    "2024-02-27 15:35:20.311",
    "2024-07-22'T'16:28:55.444",
    "2024-11-22'T'10:10:15.455",
    "2024-02-11'T'18:31:44",
    "2024-10-30*02:47:33:899",
    "2024-07-04*13:23:55",
    "24-02-11 16:47:35,985 +0000",
    "24-06-26 02:31:29,573",
    "24-04-19 12:00:17",
    "06/01/24 04:11:05",
    "08/10/24*13:33:56",
    "11/24/2024*05:13:11",
    "05/09/2024*08:22:14*612",
    "04/23/24 04:34:22 +0000",
    "2024/04/25 14:57:42",
    "11:42:35.173",
    "11:42:35,173",
    "23/Apr 11:42:35,173",
    "23/Apr/2024:11:42:35",
    "23/Apr/2024 11:42:35",
    "23-Apr-2024 11:42:35",
    "23-Apr-2024 11:42:35.883",
    "23 Apr 2024 11:42:35",
    "23 Apr 2024 10:32:35*311",
    "8/5/2024 3:31:18 AM:234",
    "9/28/2024 2:23:15 PM",
    "2023-03.28T14-33:53-7430Z",
    "2017-05-16_13:53:08",
)
WORD_CLASSES = {
    "T": ("T",),
    "APM": ("AM", "PM"),
    "MTH": ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"),
    "DAY": ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"),
    "ZONE": (
        "Z",
        "UTC", "GMT", "EST", "EDT", "CST", "CDT", "MST", "MDT", "PST", "PDT", "JST", "KST", "IST", "MSK", "CET", "BST", "HST", "HDT", "NST", "NDT",
        "CEST", "NZST", "NZDT", "ACST", "ACDT", "AEST", "AEDT", "AWST", "AWDT", "AKST", "AKDT", "CHST", "CHDT",
    ),
}
PUNCTUATION = ":;-_/\\.,'\"`~*+=(){}[]&!@#$%^"
MIN_TOKENS = 8
LONGEST_RUN = 10

_SPACE = "[ \\t\\n\\r]"
_MARKS = [re.escape(c) for c in PUNCTUATION]
_OTHER = f"[^ \\t\\n\\r0-9{''.join(_MARKS)}]"
#: A run of one class of bytes: white space, digits, one punctuation mark, or anything else.
_RUN = "|".join(f"{one}++" for one in (_SPACE, "[0-9]", *_MARKS, _OTHER))


#: First bytes of runs with a class of their own, and the names of all classes; a class is its place among them.
_FIRST = " \t\n\r" + PUNCTUATION + "0123456789"
CLASSES = (" ", *PUNCTUATION, *(f"D{n}" for n in range(1, LONGEST_RUN + 1)), *WORD_CLASSES, *(f"C{n}" for n in range(1, LONGEST_RUN + 1)))
_CODE = {name: k for k, name in enumerate(CLASSES)}
#: Without a digit or one of these words no stretch scores more than half: the known pairs of other classes are too few.
_GATE_SCORE = 0.5


def _class_of(run: str) -> str:
    """The class of a run; the Python twin of token_classes for the known formats."""
    if run[0] in " \t\n\r":
        return " "
    if run[0] in PUNCTUATION:
        return run[0]
    if run[0].isdigit():
        return f"D{min(len(run), LONGEST_RUN)}"
    named = (name for name, words in WORD_CLASSES.items() if run.upper() in words)
    return next(named, f"C{min(len(run), LONGEST_RUN)}")


_GATE = f"[0-9]|T'|'T|(?i)(?<!{_OTHER})(?:{'|'.join(WORD_CLASSES['MTH'] + WORD_CLASSES['DAY'] + WORD_CLASSES['APM'])})(?!{_OTHER})"


def known_pairs() -> list[str]:
    """Pairs of neighbouring classes in the known formats."""
    pairs = set()
    for example in TIMESTAMP_FORMATS:
        classes = [_class_of(m.group()) for m in re.finditer(_RUN, example)]
        pairs.update(f"{a}>{b}" for a, b in zip(classes, classes[1:], strict=False))
    return sorted(pairs)


def _prefix(line: Column, max_scan_bytes: int) -> Column:
    # one character for each byte, so that lengths are lengths in bytes
    return F.decode(F.substring(F.encode(line, "UTF-8"), 1, max_scan_bytes), "ISO-8859-1")


def token_codes(line: Column, max_scan_bytes: int = 60) -> Column:
    """The classes of the runs in the first bytes of a line, as places in CLASSES."""
    runs = F.regexp_extract_all(_prefix(line, max_scan_bytes), F.lit(f"({_RUN})"), F.lit(1))
    words = F.create_map(*[F.lit(x) for name, members in WORD_CLASSES.items() for word in members for x in (word, _CODE[name])])
    # by place in _FIRST: a class, -1 for digits, -2 for all else
    codes = F.array(*[F.lit(k) for k in (-2, *[0] * 4, *range(1, 1 + len(PUNCTUATION)), *[-1] * 10)])

    def classify(run: Column) -> Column:
        code = F.get(codes, F.position(F.substring(run, 1, 1), F.lit(_FIRST)))
        size = F.least(F.length(run), F.lit(LONGEST_RUN)) - 1
        word = F.when(F.length(run) <= 4, F.try_element_at(words, F.upper(run)))
        return F.when(code >= 0, code).when(code == -1, size + _CODE["D1"]).otherwise(F.coalesce(word, size + _CODE["C1"]))

    return F.transform(runs, classify)


def token_classes(line: Column, max_scan_bytes: int = 60) -> Column:
    """The names of the classes of the runs in the first bytes of a line."""
    names = F.array(*[F.lit(name) for name in CLASSES])
    return F.transform(token_codes(line, max_scan_bytes), lambda code: F.get(names, code))


def timestamp_likeness(codes: Column) -> Column:
    """Score of the best stretch of neighbouring classes: known pairs give 1, others -1; 0 if it is too short."""
    # as the argument of a lambda the classes are worked out once, not for every use
    return F.get(F.transform(F.array(codes), _likeness), F.lit(0))


def _likeness(classes: Column) -> Column:
    pairs = [p.split(">") for p in known_pairs()]
    known = F.array(*[F.lit(_CODE[a] * len(CLASSES) + _CODE[b]) for a, b in pairs])
    size = F.size(classes)
    steps = F.transform(
        F.slice(classes, 2, F.greatest(size - 1, F.lit(0))),
        lambda x, k: F.when(F.array_contains(known, F.get(classes, k) * len(CLASSES) + x), 1).otherwise(-1),
    )
    zero = F.lit(0)
    start = F.struct(zero.alias("k"), zero.alias("sum"), zero.alias("from"), F.lit(-100).alias("best"), zero.alias("best_from"), zero.alias("best_to"))

    def step(acc: Column, v: Column) -> Column:
        # a running sum below 0 is dropped; the first stretch with the greatest sum stays
        fresh = (acc["sum"] < 0) | (acc["k"] == 0)
        total = F.when(fresh, v).otherwise(acc["sum"] + v)
        begin = F.when(fresh, acc["k"]).otherwise(acc["from"])
        better = total > acc["best"]
        return F.struct(
            (acc["k"] + 1).alias("k"),
            total.alias("sum"),
            begin.alias("from"),
            F.when(better, total).otherwise(acc["best"]).alias("best"),
            F.when(better, begin).otherwise(acc["best_from"]).alias("best_from"),
            F.when(better, acc["k"] + 1).otherwise(acc["best_to"]).alias("best_to"),
        )

    score = F.aggregate(steps, start, step, lambda acc: F.when(acc["best_to"] - acc["best_from"] >= MIN_TOKENS, acc["best"] / (acc["best_to"] - acc["best_from"])).otherwise(0.0))
    return F.when(size >= MIN_TOKENS, score).otherwise(F.lit(0.0))


def is_new_entry(line: Column, first_line_regex: str | None = None, max_scan_bytes: int = 60, threshold: float = 0.5) -> Column:
    """Whether a line begins an entry: by the regular expression if there is one, else by its timestamp."""
    if first_line_regex is not None:
        return F.coalesce(line.rlike(first_line_regex), F.lit(False))
    new = timestamp_likeness(token_codes(line, max_scan_bytes)) > threshold
    if threshold >= _GATE_SCORE:
        new = _prefix(line, max_scan_bytes).rlike(_GATE) & new
    return F.coalesce(new, F.lit(False))
