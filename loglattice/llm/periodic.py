"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words with smallest period q, at least 2q long, that no neighbour extends. Texts are
taken a slice at a time; the words of a slice stand one after the other, and a word of another document is
another letter, so one suffix array serves all documents of a slice and no match leaves its document.

1. Suffixes are sorted by doubling. The ranks of each round are kept, and with them neighbours' common prefixes
   are put together from the longest power of two down.
2. An LCP interval is all suffixes that share their first `depth` words. Its edges are the nearest smaller
   values of the LCP array on both sides; its children end where the array holds `depth` itself. All intervals
   are worked out side by side on arrays; there are no nodes.
3. Branching tandems: a square of period `depth` that its next word doesn't carry on has both halves' suffixes in
   the interval, in two children. So for every suffix i of all children but the largest, the ranks of i + depth
   and i - depth are looked up: are they in the interval, and do the words behind the halves differ? Each suffix
   is in a smaller child at most log2(n) times.
4. A branching square ends its run. It is rotated to the left, a power of two of words at a time, as long as words
   `depth` apart are equal. Squares that fill the same stretch are one run, with the smallest period.

Only words that occur twice in their document, one word from the last ones at least, can be part of a run; others
are never tied and cost one sort.

Defined results: null and empty texts have no words and no runs; a null text stays null in `remove_runs`; rows are
taken one by one, so repeated rows have equal results; an empty table gives no rows; a very long text is a slice of
its own (some 80 bytes a word, and 4 more for each doubling while words of it are tied). Other columns are carried
along in the struct `row`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, text_slices, utf8

MIN_WORDS = 12


def sorted_suffixes(letters: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The starts of all suffixes in order, and for each round k the ranks by their first 2^k letters (equal ranks:
    equal letters). Only what is not yet told apart is sorted again."""
    n = len(letters)
    order = np.argsort(letters, kind="stable").astype(np.int32)
    ranked = letters[order]
    rank = np.empty(n, np.int32)
    place = np.arange(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(np.diff(ranked, prepend=ranked[:1] - 1) != 0, place, 0))
    rounds, reach = [rank.copy()], 1
    tied = place
    while True:
        held = rank[order[tied]]
        same = held[1:] == held[:-1]
        tied = tied[np.append(same, False) | np.append(False, same)]
        if not len(tied):
            return order, rounds
        at = order[tied]
        beyond = np.where(at + reach < n, rank[np.minimum(at + reach, n - 1)] + 1, 0)
        keys = rank[at].astype(np.int64) * (n + 1) + beyond
        again = np.argsort(keys, kind="stable")
        at, keys = at[again], keys[again]
        order[tied] = at
        rank[at] = tied[np.maximum.accumulate(np.where(np.diff(keys, prepend=-1) != 0, np.arange(len(keys)), 0))]
        rounds.append(rank.copy())
        reach *= 2


def common_prefixes(order: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """For each place in the order how many letters its suffix shares with the one before; -1 at both ends (n + 1)."""
    n = len(order)
    out = np.full(n + 1, -1, np.int32)
    if n < 2:
        return out
    first = rounds[0]
    near = np.flatnonzero(first[order[1:]] == first[order[:-1]])
    a, b = order[near].copy(), order[near + 1].copy()
    shared = np.zeros(len(near), np.int32)
    for k in range(len(rounds) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(a, b) < n)
        equal = inside[rounds[k][a[inside]] == rounds[k][b[inside]]]
        # equal ranks of 2^k letters: both have them, as no suffix is its own neighbour
        shared[equal] += 1 << k
        a[equal] += 1 << k
        b[equal] += 1 << k
    out[1:n] = 0
    out[near + 1] = shared
    return out


def _nearest(values: np.ndarray, bounds: np.ndarray, equal: bool) -> np.ndarray:
    """For each of `bounds` the nearest place before it with a smaller value (or with `equal` one that is no larger). A place
    jumps over all that the place it points to has jumped over. Every bound has a smaller value before it."""
    at = np.arange(-1, len(values) - 1, dtype=np.int32)
    still = bounds
    while len(still):
        seen = values[at[still]]
        still = still[(seen > values[still]) if equal else (seen >= values[still])]
        at[still] = at[at[still]]
    return at[bounds]


def branching_squares(letters: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares in `letters` that the next letter (of the same owner) doesn't carry on."""
    n = len(letters)
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not n:
        return none
    order, rounds = sorted_suffixes(letters)
    lcp = common_prefixes(order, rounds)
    del rounds
    # a bound k parts the suffixes at k - 1 and k; the interval of its depth is from the smaller value on its left to that
    # on its right, its children lie between neighbouring bounds of that depth
    bounds = np.flatnonzero(lcp > 0)
    if not len(bounds):
        return none
    mirrored, mirror = lcp[::-1], (n - bounds)[::-1]
    left, before = _nearest(lcp, bounds, False), _nearest(lcp, bounds, True)
    right, behind = (n - _nearest(mirrored, mirror, equal)[::-1] for equal in (False, True))
    last = np.flatnonzero(lcp[behind] < lcp[bounds])
    bound = np.concatenate([np.arange(len(bounds)), last])
    begin = np.concatenate([before, bounds[last]])
    size = np.concatenate([bounds, right[last]]) - begin
    # of each interval (its left edge and depth) all children but the largest
    interval = left[bound].astype(np.int64) * (n + 1) + lcp[bounds[bound]]
    group = np.lexsort((size, interval))
    smaller = group[:-1][interval[group[1:]] == interval[group[:-1]]]
    counts = size[smaller]
    child = np.repeat(smaller, counts)
    i = order[np.arange(len(child)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[child]].astype(np.int64)
    d = lcp[bounds[bound[child]]].astype(np.int64)
    first, beyond = left[bound[child]], right[bound[child]]
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n)

    def inside(j: np.ndarray) -> np.ndarray:
        at = rank[np.clip(j, 0, n - 1)]
        return np.flatnonzero((j >= 0) & (j < n) & (at >= first) & (at < beyond))

    def branching(start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half, end = start + period, start + 2 * period
        within = np.minimum(end, n - 1)
        stops = (end >= n) | (owner[start] != owner[within]) | (letters[half] != letters[within])
        return start[stops], period[stops]

    ahead, back = inside(i + d), inside(i - d)
    found = [branching(i[ahead], d[ahead]), branching(i[back] - d[back], d[back])]
    squares = np.unique(np.concatenate([start * (n + 1) + period for start, period in found]))
    return squares // (n + 1), squares % (n + 1)


def _rotated(letters: np.ndarray, start: int, period: int, begin: int) -> int:
    """How far a square can be rotated to the left: the first word of its run."""
    step = 1
    while start > begin:
        step = min(step, start - begin)
        same = letters[start - step : start] == letters[start - step + period : start + period]
        if not same.all():
            return start - step + int(np.flatnonzero(~same)[-1]) + 1
        start -= step
        step *= 2
    return start


def runs_of(letters: np.ndarray, owner: np.ndarray, begins: np.ndarray, least: int = MIN_WORDS) -> list[tuple[int, int, int, int]]:
    """owner, start (in its document), length and period of all runs of `least` words or more, by owner, start, period."""
    starts, periods = branching_squares(letters, owner)
    for k in range(1, least - 1):
        # squares under the least length must rotate so far at least
        short = 2 * periods + k <= least
        place = starts - k
        stays = ~short | (place >= begins[owner[starts]]) & (letters[place] == letters[place + periods])
        starts, periods = starts[stays], periods[stays]
    order = np.lexsort((periods, starts + 2 * periods))
    runs: list[tuple[int, int, int, int]] = []
    here: list[tuple[int, int]] = []
    last = -1
    for start, period in zip(starts[order].tolist(), periods[order].tolist(), strict=True):
        if (end := start + 2 * period) != last:
            last, here = end, []
        # squares of several periods of a run that ends here lie in it
        if any(period % q == 0 and start >= first for first, q in here):
            continue
        k = int(owner[start])
        first = _rotated(letters, start, period, int(begins[k]))
        here.append((first, period))
        runs.append((k, first - int(begins[k]), end - first, period))
    return sorted((r for r in runs if r[2] >= least), key=lambda r: (r[0], r[1], r[3]))


def _letters(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A letter for each word of each text, the text's number, and where each text begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = [w for t in texts for w in t]
    number = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    owner = np.repeat(np.arange(len(texts)), sizes)
    letters = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat)) + owner * max(1, len(number))
    return letters, owner, np.cumsum(sizes) - sizes


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = "runs array<struct<start:long,length:long,period:long>>"


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` (text, ...) as row (struct of all columns but text), text, n_words, runs (start, length and period in words, by
    start, then period) and collapsed: the words joined by spaces without those that a run contains after its first
    period."""
    limit_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = [t.split() for t in utf8(batch.column("text"))]
            found: list[list[dict]] = [[] for _ in texts]
            for k, start, length, period in runs_of(*_letters(texts), min_words):
                found[k].append({"start": start, "length": length, "period": period})
            kept = [b" ".join(_kept(t, r)).decode() for t, r in zip(texts, found, strict=True)]
            columns = [batch.column("row"), batch.column("text"), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "text", "n_words", "runs", "collapsed"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")
    return rows.mapInArrow(scan, f"row {rows.schema['row'].dataType.simpleString()}, text string, n_words long, {_RUNS}, collapsed string")


def _kept(words: list[bytes], runs: list[dict]) -> list[bytes]:
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for r in runs:
        keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
    return list(compress(words, keep.tolist()))


def remove_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with one period of each run; texts without runs stay byte for byte. n_chars, where there, follows the text."""
    found = find_runs(docs, min_words)
    text = F.when(F.size("runs") == 0, F.col("text")).otherwise(F.col("collapsed"))
    return found.select(*[
        text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ])
