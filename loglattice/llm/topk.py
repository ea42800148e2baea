"""Exact top-k search by inner product without random access to the lists.

Components become whole numbers, floor(2^bits * x). Rows are dealt into blocks of bounded bytes, queries into
blocks of their own, and every pair of a query block and a row block is one group. A group cuts its rows into
runs; in a run each dimension is a list of the rows in the order of their components. A query reads every list
from the end that its own component favours, a stride of entries at a time, many queries side by side. What a
row has gained from the entries read plus the most that the unread ones can give is its upper bound, with the
least that they can give its lower bound. A query's bar is the k-th largest lower bound of the run or the k-th
best score of earlier runs, whichever is higher. A query stops reading when few rows have an upper bound that
reaches its bar; those rows' final scores are then resolved, and those of all groups merged.

Bounds are kept in single precision, on values scaled by powers of two, and are widened by more than their
rounding can be. Final scores are exact: in double precision while all sums are below 2^53, else in Python's
whole numbers, so ties are ties.

Defined results: vectors that are null or empty, hold null or non-finite components, or differ in length from
the query take no part with it, nor do rows without a vec_id; every other row is a candidate, repeated rows
each for itself, but for those that bear the query's own vec_id; rows with one vec_id and different vectors are
queries of their own with ranks of their own, and repeated rows ask once; fewer candidates than k give fewer
rows; ties go to the smaller vec_id; a score beyond the range of long is given as its nearest long and ordered
by its double; other columns are not read. Rows are dealt by their place in the table too, so `table` must
give the same rows in the same order when it is read again, as files do.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_FOUND = "query_key long, query_id long, vec_id long, score long, rough double"

#: Rows of a run, queries side by side, strides into which a list is cut, and the share of a run's rows that may be resolved.
RUN_ROWS, SIDE, STRIDES, FEW = 1024, 256, 8, 0.02
_LONG = (1 << 63) - 1


def whole_vector(values: list[float], bits: int) -> list[int]:
    """floor(2^bits * x) of each component, exactly."""
    return [math.floor(math.ldexp(x, bits)) if abs(x) < 1e200 else int(x) << bits for x in values]


class Vectors:
    """Vectors of one length: their components for bounds, scaled by a power of two into [-1, 1], and for scores."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, bits: int):
        self.ids, self.raw, self.bits = ids, raw, bits
        most = float(np.abs(raw).max(initial=0))
        self.exponent = max(0, math.frexp(most)[1] + bits)
        self.small = self.exponent <= 50
        if self.small:
            self.whole = np.floor(np.ldexp(raw, bits))
            self.scaled = np.ldexp(self.whole, -self.exponent).astype(np.float32)
        else:
            self.scaled = np.ldexp(raw, bits - self.exponent).astype(np.float32)

    def exact(self, row: int) -> list[int]:
        return whole_vector(self.raw[row].tolist(), self.bits)


def inner_products(rows: Vectors, at: np.ndarray, queries: Vectors, of: np.ndarray) -> np.ndarray:
    """The exact scores of pairs of a row and a query; Python's whole numbers where a double could not hold a sum."""
    width = rows.raw.shape[1]
    if rows.small and queries.small and rows.exponent + queries.exponent + width.bit_length() <= 53:
        out = np.empty(len(at), np.int64)
        for k in range(0, len(at), 65_536):
            part = slice(k, k + 65_536)
            out[part] = np.einsum("ij,ij->i", rows.whole[at[part]], queries.whole[of[part]])
        return out
    row_of = {a: rows.exact(a) for a in set(at.tolist())}
    query_of = {q: queries.exact(q) for q in set(of.tolist())}
    return np.array([sum(map(int.__mul__, row_of[a], query_of[q])) for a, q in zip(at.tolist(), of.tolist(), strict=True)] + [0], object)[:-1]


class SortedLists:
    """The sorted lists of a run of rows, one for each dimension, read for many queries side by side."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray):
        self.n = len(rows)
        self.order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)
        self.values = np.take_along_axis(rows.T, self.order, axis=1)
        ranks = np.empty_like(self.order)
        np.put_along_axis(ranks, self.order, np.arange(self.n)[None, :], axis=1)
        self.ranks = np.ascontiguousarray(ranks.T)
        wanted = np.ascontiguousarray(queries.T)
        self.plus, self.minus = np.maximum(wanted, 0), np.minimum(wanted, 0)
        self.gained = np.zeros((self.n, len(queries)), np.float32)
        self.depth = self.entries = 0
        # more than rounding can add to a sum of as many products
        reach = np.abs(queries) @ np.abs(rows).max(axis=0, initial=0)
        self.slack = (reach * ((rows.shape[1] + 8) * 2.0**-22)).astype(np.float32)

    def read(self, stride: int) -> None:
        """The next entries of every list: the highest unread ones for queries with a positive component there, the
        lowest for the others."""
        a, b = self.depth, min(self.n, self.depth + stride)
        top, bottom = slice(self.n - b, self.n - a), slice(a, b)
        for order, values, plus, minus in zip(self.order, self.values, self.plus, self.minus, strict=True):
            self.gained[order[top]] += values[top, None] * plus
            self.gained[order[bottom]] += values[bottom, None] * minus
        self.depth = b
        self.entries += (b - a) * self.gained.shape[1] * len(self.order)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of every row's score for every query."""
        if self.depth == self.n:
            return self.gained, self.gained
        no_top = (self.ranks < self.n - self.depth).astype(np.float32)
        no_bottom = (self.ranks >= self.depth).astype(np.float32)
        next_top, next_bottom = self.values[:, self.n - self.depth - 1, None], self.values[:, self.depth, None]
        low, high = self.values[:, :1], self.values[:, -1:]
        upper = self.gained + no_top @ (self.plus * next_top) + no_bottom @ (self.minus * next_bottom)
        lower = self.gained + no_top @ (self.plus * low) + no_bottom @ (self.minus * high)
        return upper, lower

    def keep(self, columns: np.ndarray) -> None:
        """Goes on with these queries only."""
        self.plus, self.minus, self.gained, self.slack = (np.compress(columns, x, axis=-1) for x in (self.plus, self.minus, self.gained, self.slack))


def candidates(rows: np.ndarray, queries: np.ndarray, bar: np.ndarray, k: int, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (row, query) among which are all rows of a query's k best that reach its bar, and the number of entries
    read. `own`: pairs (row, query) that are no candidates."""
    lists = SortedLists(rows, queries)
    n = len(rows)
    stride = max(1, -(-n // STRIDES))
    left = np.arange(len(queries))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lists.read(stride)
    while len(left):
        lists.read(stride)
        upper, lower = lists.bounds()
        place = np.full(len(queries), -1)
        place[left] = np.arange(len(left))
        there = place[own[1]] >= 0
        own_at = own[0][there], place[own[1][there]]
        upper, lower = upper + lists.slack, lower - lists.slack
        upper[own_at] = lower[own_at] = -np.inf
        now = bar[left]
        if n >= k:
            now = np.maximum(now, np.partition(lower, n - k, axis=0)[n - k])
        viable = (upper >= now) & (upper > -np.inf)
        done = (np.count_nonzero(viable, axis=0) <= max(k, FEW * n)) if lists.depth < n else np.ones(len(left), bool)
        if done.any():
            at, of = np.nonzero(viable[:, done])
            found.append((at, left[done][of]))
            left = left[~done]
            lists.keep(~done)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), lists.entries


def _best(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k best, by query, score and id."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(of)), key=lambda i: (of[i], -scores[i], ids[i])), np.int64)
    else:
        order = np.lexsort((ids, -scores, of))
    begins = np.flatnonzero(np.diff(of[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    return order[rank < k]


def best_rows(rows: Vectors, queries: Vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best rows of each query, as indices of queries, ids, scores, and the number of entries read."""
    m, read = len(queries.ids), 0
    of, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    bar = np.full(m, -np.inf)
    shift = rows.exponent + queries.exponent
    order = np.argsort(queries.ids, kind="stable")
    for a in range(0, len(rows.ids), RUN_ROWS):
        run_ids = rows.ids[a : a + RUN_ROWS]
        low, high = np.searchsorted(queries.ids[order], run_ids), np.searchsorted(queries.ids[order], run_ids, "right")
        own_rows = np.repeat(np.arange(len(run_ids)), high - low)
        own_of = order[np.concatenate([np.arange(x, y) for x, y in zip(low, high, strict=True)]).astype(np.int64)]
        parts = [(of, ids, scores)]
        for q in range(0, m, SIDE):
            mine = (own_of >= q) & (own_of < q + SIDE)
            at, who, entries = candidates(rows.scaled[a : a + RUN_ROWS], queries.scaled[q : q + SIDE], bar[q : q + SIDE], k, (own_rows[mine], own_of[mine] - q))
            read += entries
            parts.append((who + q, run_ids[at], inner_products(rows, at + a, queries, who + q)))
        of, ids, scores = (np.concatenate([p[j] for p in parts]) for j in range(3))
        keep = _best(of, ids, scores, k)
        of, ids, scores = of[keep], ids[keep], scores[keep]
        last = np.flatnonzero(np.diff(of, append=-1))
        full = last[np.bincount(of, minlength=m)[of[last]] == k]
        bar[of[full]] = [s / (1 << shift) for s in scores[full].tolist()]
    return of, ids, scores, read


def _search(k: int, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], [], []]
        asked = _by_length(queries, bits)
        for length, (vectors, _) in _by_length(rows, bits).items():
            if length in asked:
                wanted, keys = asked[length]
                of, ids, scores, _ = best_rows(vectors, wanted, k)
                exact = scores.tolist()
                held = [max(-_LONG - 1, min(_LONG, s)) for s in exact]
                rough = [float(s) if abs(s) < 1 << 1023 else math.copysign(math.inf, s) for s in exact]
                for column, values in zip(found, (keys[of].tolist(), wanted.ids[of].tolist(), ids.tolist(), held, rough), strict=True):
                    column += values
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(found, types, strict=True)], ["query_key", "query_id", "vec_id", "score", "rough"])

    return search


def _by_length(part: pa.Table, bits: int) -> dict[int, tuple[Vectors, np.ndarray]]:
    """Vectors of each length, and their keys."""
    out = {}
    lists = part.column("vector").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        chosen = part.filter(pa.array(lengths == length))
        raw = chosen.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, length)
        out[length] = Vectors(chosen.column("vec_id").to_numpy(), raw, bits), chosen.column("key").to_numpy()
    return out


def taking_part(table: DataFrame) -> DataFrame:
    """vec_id and vector (array of double): the rows of `table` (vec_id, embedding) that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    good = table.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False)))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))


def top_k(table: DataFrame, query_step: int = 50, k: int = 5, bits: int = 8, row_bytes: int = 8 << 20, query_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by `query_step`. A group
    holds about `row_bytes` of rows and `query_bytes` of queries."""
    rows = taking_part(table)
    is_query = F.col("vec_id") % query_step == 0
    queries = rows.where(is_query)
    size = F.size("vector").cast("long") * 8
    sums = rows.agg(F.sum(size).alias("rows"), F.sum(F.when(is_query, size)).alias("queries")).first()
    row_blocks = max(1, math.ceil((sums.rows or 0) / row_bytes))
    query_blocks = max(1, math.ceil((sums.queries or 0) / query_bytes))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # repeated rows differ in their place, so no block gathers them
    place = F.xxhash64("vec_id", "vector", F.monotonically_increasing_id())
    key = F.xxhash64("vec_id", "vector")
    dealt_rows = rows.select("vec_id", "vector", F.lit(0).cast("long").alias("key"), F.pmod(place, F.lit(row_blocks)).cast("int").alias("row_block")).withColumn("query_block", every(query_blocks))
    asked = queries.select("vec_id", "vector", key.alias("key")).dropDuplicates(["vec_id", "key"])
    dealt_queries = asked.withColumn("row_block", every(row_blocks)).withColumn("query_block", F.pmod("key", F.lit(query_blocks)).cast("int"))
    blocks = ["row_block", "query_block"]
    found = dealt_queries.groupBy(*blocks).cogroup(dealt_rows.groupBy(*blocks)).applyInArrow(_search(k, bits), _FOUND)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), F.desc("rough"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
