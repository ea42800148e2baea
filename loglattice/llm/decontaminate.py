"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is built over word numbers. A document's words are streamed through it; at every word it
gives the longest suffix of the words read that occurs in an item. A window is `window` consecutive item
words, or a whole item of fewer words; a document word inside an occurrence of a window is hit.

Items are dealt into blocks of about `block_words` words; every block is one broadcast and one narrow pass over
the documents, so neither a task nor the driver holds more than one block however large the benchmark is. With
several blocks the documents are written once, with a number for each row; a pass reads numbers and texts and writes
the spans and items of the rows that are hit, and these are joined to the documents at the end. A benchmark of
1.2 MB is one block; one of 100 MB costs 84 readings of the texts, and no further copy of them.

Defined results: null and empty texts have no words and no hits; items without words have no windows;
repeated items count by their item_id once; repeated documents give one row each; other columns of the
documents are carried along untouched, also when they bear the names of results (they are kept in the
struct column `row`); items without an item_id are left out; an empty documents table gives no rows, an empty
benchmark no hits; very long texts are read whole.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, materialise, text_slices, utf8

#: Lower-cases A-Z and turns all bytes outside 0-9, a-z and 0x80-0xFF into spaces.
_NORMAL = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class ItemAutomaton:
    """A generalised suffix automaton over the word sequences of items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set[int]] = [set()]
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.shortest = window
        ends = []
        for name, words in items:
            last = 0
            for word in words:
                w = self.vocabulary.setdefault(word, len(self.vocabulary))
                last = self._extend(last, w, own)
                own[last].add(number[name])
            if 0 < len(words) < window:
                ends.append((last, len(words), number[name]))
                self.shortest = min(self.shortest, len(words))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for v in reversed(order):
            own[self.link[v]] |= own[v]
        # of each state: the items that hold the last `window` words, and the short items that may end here
        self.full: list[frozenset[int] | None] = [None] * len(self.link)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for v, length, item in ends:
            self.short[v] += ((length, item),)
        for v in order:
            up = self.link[v]
            self.short[v] += self.short[up]
            if self.length[v] >= window:
                self.full[v] = self.full[up] if self.length[up] >= window else frozenset(own[v])
        self.marked = [self.full[v] is not None or bool(self.short[v]) for v in range(len(self.link))]

    def _extend(self, last: int, w: int, own: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q, own)
        new = self._state(length[last] + 1, {}, 0, own)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q, own)
        return new

    def _state(self, length: int, arcs: dict[int, int], link: int, own: list[set[int]]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        own.append(set())
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int, own: list[set[int]]) -> int:
        """The part of state q that is reached by words of length[p] + 1 at most, as a state of its own."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], own)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int32, len(words))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of hit words, ascending and apart, and the items whose windows occur."""
        known = self.numbers(words)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.shortest:
                self._walk(known[a:b].tolist(), a, spans, items)
        return spans, items

    def _walk(self, numbers: list[int], at: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        nxt, link, length, marked = self.next, self.link, self.length, self.marked
        state = matched = 0
        for i, w in enumerate(numbers, at + 1):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w not in nxt[state]:
                continue
            state = nxt[state][w]
            matched += 1
            if not marked[state]:
                continue
            reach = 0
            if matched >= self.window:
                reach = self.window
                # the state may also stand for longer sequences; its last `window` words are the same
                items |= self.full[state] or frozenset()
            for size, item in self.short[state]:
                if size <= matched:
                    items.add(item)
                    reach = max(reach, size)
            if reach:
                start = i - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))


def _item_blocks(items: DataFrame, block_words: int) -> Iterator[tuple[list[tuple[str, list[bytes]]], bool]]:
    """The items of each block with their words, and whether it is the last. Six bytes count as a word."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    blocks = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / (6 * block_words)))
    if blocks > 1:
        rows = materialise(rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))))
    for k in range(blocks):
        block = rows.where(F.col("block") == k) if blocks > 1 else rows
        yield [(row.item_id, words_of(row.text.encode())) for row in block.select("item_id", "text").collect()], k == blocks - 1


_BUILT: dict[object, ItemAutomaton] = {}


def _automaton(shared, window: int) -> ItemAutomaton:
    """One automaton for each block and worker process."""
    if (shared.id, window) not in _BUILT:
        if len(_BUILT) > 3:
            _BUILT.clear()
        _BUILT[shared.id, window] = ItemAutomaton(shared.items.value, window)
    return _BUILT[shared.id, window]


class _Block:
    def __init__(self, items, key: str):
        self.items, self.id = items, key


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = 200_000) -> DataFrame:
    """`docs` (doc_id, text, ...) as columns row (struct of all columns), n_words, spans (array of
    struct<start, end>: hit words), items (array of string: items whose windows occur)."""
    return _scanned(docs, items, window, block_words).drop("kept")


_FOUND = "spans array<struct<start:int,end:int>>, items array<string>"


def _scanned(docs: DataFrame, items: DataFrame, window: int, block_words: int, cut: bool = False) -> DataFrame:
    """find_contamination, with the column kept: the text without its spans if `cut`, else null."""
    spark = docs.sparkSession
    limit_batches(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    blocks = _item_blocks(items, block_words)
    first, only = next(blocks)
    if only:
        told = rows.withColumn("spans", F.lit(None).cast("array<struct<start:int,end:int>>")).withColumn("items", F.lit(None).cast("array<string>"))
        return told.mapInArrow(_finished(_shared(spark, first), window, cut), _schema(rows))
    numbered = materialise(rows.withColumn("number", F.monotonically_increasing_id()))
    texts = numbered.select("number", F.col("row.text").alias("text"))
    hits = [materialise(texts.mapInArrow(_hit_rows(_shared(spark, block), window), f"number long, {_FOUND}")) for block in (first, *(block for block, _ in blocks))]
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    every = every.groupBy("number").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    told = numbered.join(every, "number", "left").select("row", "spans", "items")
    return told.mapInArrow(_finished(None, window, cut), _schema(rows))


def _shared(spark: SparkSession, block: list[tuple[str, list[bytes]]]) -> _Block:
    return _Block(spark.sparkContext.broadcast(block), uuid.uuid4().hex)


def _schema(rows: DataFrame) -> str:
    return f"row {rows.schema['row'].dataType.simpleString()}, n_words long, {_FOUND}, kept string"


def _hit_rows(shared: _Block, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Number, spans and items of the rows that windows of a block occur in."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared, window)
        for part in text_slices(batches):
            found = [automaton.hits(words_of(text)) for text in utf8(part.column("text"))]
            hit = [k for k, (spans, _) in enumerate(found) if spans]
            if hit:
                spans = pa.array([[{"start": a, "end": b} for a, b in found[k][0]] for k in hit], _SPANS)
                names = pa.array([[automaton.names[i] for i in found[k][1]] for k in hit], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("number").take(pa.array(hit)), spans, names], ["number", "spans", "items"])

    return scan


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _finished(shared: _Block | None, window: int, cut: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with all that is found in them: by this block, or by earlier passes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared, window) if shared else None
        for batch in batches:
            texts = batch.column("row").field("text")
            parts = text_slices(iter([pa.RecordBatch.from_arrays([texts, batch.column("spans"), batch.column("items")], ["text", "spans", "items"])]))
            counts, spans, found, kept = [], [], [], []
            for part in parts:
                for text, old_spans, old_items in zip(utf8(part.column("text")), part.column("spans").to_pylist(), part.column("items").to_pylist(), strict=True):
                    words = words_of(text)
                    new, got = automaton.hits(words) if automaton else ([], ())
                    counts.append(len(words))
                    spans.append(merged([(s["start"], s["end"]) for s in old_spans or ()], new))
                    found.append(sorted({*(old_items or ()), *(automaton.names[k] for k in got)} if automaton else set(old_items or ())))
                    kept.append(cut_words(text, spans[-1]) if cut else None)
            arrays = [batch.column("row"), pa.array(counts, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS), pa.array(found, pa.list_(pa.string())), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "n_words", "spans", "items", "kept"])

    return scan


def merged(one: list[tuple[int, int]], two: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans; `two` alone is in order and apart."""
    if not one:
        return two
    out: list[tuple[int, int]] = []
    for a, b in sorted(one + two):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def n_hit(spans: Column) -> Column:
    return F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"])), F.lit(0))


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.8) -> DataFrame:
    """`docs` without the spans of words that occur in test items: a window's words and what lies between
    them go; a document of which more than `max_coverage` of the words are hit goes as a whole.
    Untouched documents keep their text byte for byte; n_chars, where there, follows the text."""
    found = _scanned(docs, items, window, 200_000, cut=True)
    stay = found.where(n_hit(F.col("spans")) <= max_coverage * F.col("n_words"))
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    return stay.select(*[
        text.alias(c) if c == "text" else F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ])


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the bytes between them."""
    if not spans:
        return text.decode()
    plain = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], plain.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]]).decode()
