"""Substring dedup by relative Lempel-Ziv parsing.

Documents are dealt into blocks of about `block_bytes`. Every block is a reference block: its documents that
others may repeat are indexed by a suffix array over their words. A document is parsed greedily against the
index of every block with which it shares a window of `min_words` words: a factor is the longest run of words
from where the last factor ended that occurs in a document of the block with a smaller doc_id. Factors of
`min_words` words or more are duplicate spans; windows that cross a factor's end are parsed one by one in the
same way, so nothing that starts inside a factor is missed. Words are compared, not hashes.

Which stretches of a document meet which blocks comes from a filter, two exchanges of packed arrays between
blocks and hash buckets, each of which sends a window once for each block at most:

1. Anchors. A window's anchor is the least hash of its 7-word runs; equal windows have equal anchors. Only
   anchors that two documents hold come back.
2. Hashes of windows with such anchors, with the earliest document of the block. Back come, for those with an
   earlier holder elsewhere, that document and its block; holders learn that they are wanted.

Each block then sends every different stretch (the union of windows with the same block of earliest holders)
to that block, and its wanted documents to its own index. A block that gets more stretches than it has
documents in its index is split into parts, each with a copy of the index. The spans found are sent back to
the documents. The text itself is shuffled once; its exchange is used by all steps.

Removed are exactly the words inside some window that also starts in a document with a smaller doc_id: the
earliest holder of each such window is in a block that the stretch meets, and what is found there is a repeat.

Defined results: null texts count as having no words and stay null; repeated rows of one doc_id never
duplicate each other; a null doc_id counts as larger than all others; other columns are carried along
unread in the struct `row`; an empty table gives no rows; very long texts are a block of their own, parsed in time
proportional to their words and the logarithm of the block.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches

MIN_WORDS = 13
_ANCHOR_WORDS = 7
_LAST_DOC = (1 << 63) - 1
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: What a block tells a bucket of a window; what it hears of one; and a span of a row.
_WINDOW = np.dtype([("hash", "<u8"), ("doc", "<i8")])
_EARLIER = np.dtype([("step", "<u4"), ("doc", "<i8"), ("block", "<i8")])
_SPAN = np.dtype([("row", "<i4"), ("start", "<i4"), ("words", "<i4"), ("doc", "<i8"), ("pos", "<i4")])
_ANCHORS, _FIRSTS, _WANTED, _SPANS = range(4)
#: Places in the order of suffixes with one least doc.
_FEW, _MANY = 32, 1024


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def _runs(hashes: np.ndarray, words: int, odd: np.uint64) -> np.ndarray:
    """A hash of every run of `words` words."""
    n = len(hashes) - words + 1
    out = hashes[:n].copy()
    for k in range(1, words):
        out *= odd
        out += hashes[k : k + n]
    return _mixed(out)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n neighbours."""
    reach = 1
    while reach < n:
        step = min(reach, n - reach)
        x = np.minimum(x[:-step], x[step:])
        reach += step
    return x


class _Block:
    """The words of a block's documents, in the order of doc_id and text, one after the other, and their windows."""

    def __init__(self, docs: np.ndarray, texts: list[bytes], min_words: int, buckets: int):
        digest = xxhash.xxh3_64_digest
        parts = [b"".join(map(digest, text.split())) for text in texts]
        self.hashes = np.frombuffer(b"".join(parts), "<u8").astype(np.uint64)
        self.sizes = np.array([len(p) // 8 for p in parts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.docs, self.min_words, self.buckets = docs, min_words, np.uint64(buckets)
        n = np.maximum(self.sizes - min_words + 1, 0)
        self.owner = np.repeat(np.arange(len(texts)), n)  # of each window
        self.window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts, n)
        self.anchor = np.empty(0, np.uint64)
        if len(self.window):
            least = _least(_runs(self.hashes, _ANCHOR_WORDS, _ODD[0]), min_words - _ANCHOR_WORDS + 1)[self.window]
            # the bucket and 31 bits; the lowest bit is free
            least = _mixed(least * _ODD[1])
            self.anchor = (least >> np.uint64(32)) % self.buckets << np.uint64(32) | least & np.uint64(0xFFFFFFFE)

    def anchors(self) -> np.ndarray:
        """The different anchors; the lowest bit is set if two documents of the block hold one."""
        if not len(self.anchor):
            return self.anchor
        change = np.ones(len(self.anchor), bool)
        change[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.owner[1:] != self.owner[:-1])
        anchor, doc = self.anchor[change], self.docs[self.owner[change]]
        order = np.argsort(anchor, kind="stable")
        return _shared(anchor[order], doc[order])

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows whose anchor is shared; of different ones the first (so that of the smallest doc_id), in order,
        and its bucket, which comes from a second hash; and for each window the number of its first."""
        if not len(shared) or not len(self.anchor):
            return np.empty(0, np.int64), np.empty(0, _WINDOW), np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(shared, self.anchor), len(shared) - 1)
        chosen = np.flatnonzero(shared[at] == self.anchor)
        place = self.window[chosen]
        hashes = []
        for odd in _ODD:
            hashed = self.hashes[place]
            for k in range(1, self.min_words):
                hashed *= odd
                hashed += self.hashes[place + k]
            hashes.append(_mixed(hashed))
        order = np.lexsort(hashes[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([h[order[1:]] != h[order[:-1]] for h in hashes], axis=0)
        first = order[np.flatnonzero(new)]
        group = np.empty(len(chosen), np.int64)
        group[order] = np.cumsum(new) - 1
        place_of = np.empty(len(first), np.int64)
        ranked = np.argsort(first)
        place_of[ranked] = np.arange(len(first))
        first = first[ranked]
        found = np.empty(len(first), _WINDOW)
        found["hash"], found["doc"] = hashes[0][first], self.docs[self.owner[chosen[first]]]
        return chosen, found, (hashes[1][first] % self.buckets).astype(np.int64), place_of[group]


def _shared(anchor: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Of sorted anchors, each once; the lowest bit is set if it has two different owners."""
    first = np.ones(len(anchor), bool)
    first[1:] = anchor[1:] != anchor[:-1]
    differ = np.zeros(len(anchor), bool)
    differ[1:] = ~first[1:] & (who[1:] != who[:-1])
    return anchor[first] | np.logical_or.reduceat(differ, np.flatnonzero(first)).astype(np.uint64)


def _pack(values: np.ndarray) -> bytes:
    """An array with its bytes in planes, compressed: the high bytes of ids and places are mostly zero."""
    planes = values.view(np.uint8).reshape(len(values), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes, kind: np.dtype | str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket and the indices of its entries, in their order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if len(order) else []
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(bucket[order[a]]), order[a:b]


_PACKED = "bucket long, block long, kind int, packed binary"


def _packed(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = ["bucket", "block", "kind", "packed"]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _documents(part: pa.Table) -> tuple[pa.Array, np.ndarray, list[bytes | None]]:
    """The rows of a block in the order of doc_id (null last) and text, which is the same in all steps."""
    row = part.column("row").combine_chunks()
    docs = row.field("doc_id").cast(pa.int64()).fill_null(_LAST_DOC).to_numpy(zero_copy_only=False)
    texts = row.field("text").cast(pa.binary()).to_pylist()
    order = sorted(range(len(texts)), key=lambda k: (docs[k], texts[k] or b""))
    return row.take(pa.array(order, pa.int64())), docs[order], [texts[k] for k in order]


def _block_of(part: pa.Table, min_words: int, buckets: int) -> tuple[_Block, list[bytes]]:
    _, docs, texts = _documents(part)
    plain = [t or b"" for t in texts]
    return _Block(docs, plain, min_words, buckets), plain


def _received(back: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    return [(b, p) for b, k, p in zip(back.column("bucket").to_pylist(), back.column("kind").to_pylist(), back.column("packed").to_pylist(), strict=True) if k == kind]


def _sorted_anchors(back: pa.Table) -> np.ndarray:
    found = [_unpack(p, "<u8") for _, p in _received(back, _ANCHORS)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _send_anchors(min_words: int, buckets: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def send(key: tuple[pa.Scalar], part: pa.Table) -> pa.Table:
        found = _block_of(part, min_words, buckets)[0].anchors()
        return _packed([(b, key[0].as_py(), _ANCHORS, _pack(found[at])) for b, at in _by_bucket((found >> np.uint64(32)).astype(np.int64))])

    return send


def _meet_anchors(part: pa.Table) -> pa.Table:
    """Sends each block those of its anchors that two documents hold."""
    parts = [_unpack(p, "<u8") for p in part.column("packed").to_pylist()]
    values = np.concatenate(parts)
    who = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    anchor, marked = values & ~np.uint64(1), values[(values & np.uint64(1)) == 1]
    order = np.argsort(anchor, kind="stable")
    both = _shared(anchor[order], who[order])
    shared = np.union1d(both[(both & np.uint64(1)) == 1], marked) & ~np.uint64(1)
    rows = []
    for block, own in zip(part.column("block").to_pylist(), parts, strict=True):
        own = own & ~np.uint64(1)
        if len(shared):
            at = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
            if (held := own[shared[at] == own]).size:
                rows.append((0, block, _ANCHORS, _pack(held)))
    return _packed(rows)


def _send_windows(min_words: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def send(part: pa.Table, back: pa.Table) -> pa.Table:
        if not part.num_rows or not back.num_rows:
            return _packed([])
        block = _block_of(part, min_words, buckets)[0]
        _, firsts, bucket, _ = block.candidates(_sorted_anchors(back))
        name = part.column("block")[0].as_py()
        return _packed([(b, name, _FIRSTS, _pack(firsts[at])) for b, at in _by_bucket(bucket)])

    return send


def _meet_windows(part: pa.Table) -> pa.Table:
    """Tells each block which of its windows have an earlier holder in another block, and which of its documents are
    the earliest holders for other blocks."""
    parts = [_unpack(p, _WINDOW) for p in part.column("packed").to_pylist()]
    blocks = np.array(part.column("block").to_pylist(), np.int64)
    bucket = part.column("bucket")[0].as_py()
    every = np.concatenate(parts)
    who = np.repeat(blocks, [len(p) for p in parts])
    order = np.lexsort((who, every["doc"], every["hash"]))
    begins = np.flatnonzero(np.append(True, np.diff(every["hash"][order]) != 0))
    first = np.empty(len(every), np.int64)
    first[order] = np.repeat(order[begins], np.diff(np.append(begins, len(order))))
    rows, at = [], 0
    for block, own in zip(blocks.tolist(), parts, strict=True):
        mine = first[at : at + len(own)]
        at += len(own)
        later = np.flatnonzero(every["doc"][mine] < own["doc"])
        if len(later):
            told = np.empty(len(later), _EARLIER)
            told["step"], told["doc"], told["block"] = np.diff(later, prepend=0), every["doc"][mine[later]], who[mine[later]]
            rows.append((bucket, block, _FIRSTS, _pack(told)))
    wanted = np.unique(first[every["doc"][first] < every["doc"]])
    for block, index in _by_bucket(who[wanted]):
        rows.append((bucket, block, _WANTED, _pack(np.unique(every["doc"][wanted[index]]))))
    return _packed(rows)


_STRETCHES = "block long, home long, doc long, words binary, places array<struct<row:int,start:int>>"


def _send_stretches(min_words: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Stretches of the block's documents for the blocks that hold their windows earlier (with their places), and the
    block's wanted documents for its own index (without)."""

    def send(part: pa.Table, back: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if part.num_rows and back.num_rows:
            block, texts = _block_of(part, min_words, buckets)
            home = part.column("block")[0].as_py()
            chosen, firsts, buckets_of, place = block.candidates(_sorted_anchors(back))
            holder, where = firsts["doc"].copy(), np.full(len(firsts), home)
            sent = dict(_by_bucket(buckets_of))
            for bucket, packed in _received(back, _FIRSTS):
                told = _unpack(packed, _EARLIER)
                at = sent[bucket][np.cumsum(told["step"], dtype=np.int64)]
                holder[at], where[at] = told["doc"], told["block"]
            own = block.owner[chosen]
            hit = np.flatnonzero(holder[place] < block.docs[own])
            wanted = [_unpack(p, "<i8") for _, p in _received(back, _WANTED)]
            wanted = np.unique(np.concatenate([*wanted, holder[place[hit]][where[place[hit]] == home]]))
            words: dict[int, list[bytes]] = {}
            for k in np.flatnonzero(np.isin(block.docs, wanted)).tolist():
                words[k] = texts[k].split()
                rows.append((home, home, int(block.docs[k]), b" ".join(words[k]), None))
            # by block of the holder, then by place
            target, window, who = where[place[hit]], block.window[chosen[hit]], own[hit]
            order = np.lexsort((window, target))
            target, window, who = target[order], window[order], who[order]
            begins = np.ones(len(order), bool)
            begins[1:] = (np.diff(target) != 0) | (np.diff(who) != 0) | (np.diff(window) >= min_words)
            edges = np.flatnonzero(begins)
            lasts = np.append(edges[1:], len(order)) - 1 if len(edges) else edges
            places: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
            for to, k, a, b in zip(target[edges].tolist(), who[edges].tolist(), window[edges].tolist(), window[lasts].tolist(), strict=True):
                if k not in words:
                    words[k] = texts[k].split()
                a -= int(block.starts[k])
                b -= int(block.starts[k])
                places.setdefault((to, b" ".join(words[k][a : b + min_words])), []).append((k, a))
            # equal stretches are parsed once, for the smallest doc_id: all their windows have earlier holders than that
            rows += [(to, home, int(block.docs[min(k for k, _ in at)]), stretch, [{"row": k, "start": a} for k, a in at]) for (to, stretch), at in places.items()]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("row", pa.int32()), ("start", pa.int32())]))]
        names = ["block", "home", "doc", "words", "places"]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return send


def suffix_array(letters: np.ndarray) -> np.ndarray:
    """The starts of all suffixes in their order, by doubling; only what is not yet told apart is sorted again."""
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    ranked = letters[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.diff(ranked, prepend=-1) != 0, np.arange(n), 0))
    reach = 1
    while True:
        sorted_rank = rank[order]
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(tied):
            return order
        at = order[tied]
        beyond = np.where(at + reach < n, rank[np.minimum(at + reach, n - 1)] + 1, 0)
        keys = rank[at] * (n + 1) + beyond
        again = np.argsort(keys, kind="stable")
        at, keys = at[again], keys[again]
        order[tied] = at
        rank[at] = tied[np.maximum.accumulate(np.where(np.diff(keys, prepend=-1) != 0, np.arange(len(keys)), 0))]
        reach *= 2


class ReferenceIndex:
    """The documents of a reference block with the suffix array of their words."""

    def __init__(self, docs: list[int], texts: list[bytes]):
        lists = [t.split(b" ") for t in texts]
        flat = [w for words in lists for w in (*words, b"")]  # b"" ends a document
        self.number = {w: k for k, w in enumerate(dict.fromkeys([b"", *flat]))}
        letters = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        sizes = [len(words) + 1 for words in lists]
        self.starts = np.cumsum(sizes) - sizes
        self.docs = docs
        order = suffix_array(letters)
        owner = np.repeat(np.arange(len(docs)), sizes)[order]
        self.order, self.owner, self.doc_at = order.tolist(), owner.tolist(), np.array(docs, np.int64)[owner].tolist()
        self.letters = letters.astype(">u4").tobytes()
        #: The least doc of each few places in the order, and of each many.
        self.low = {size: np.minimum.reduceat(np.array(self.doc_at), np.arange(0, len(order), size)).tolist() for size in (_FEW, _MANY)}

    def coded(self, stretch: bytes) -> bytes:
        missing = len(self.number)
        words = stretch.split(b" ")
        return np.fromiter((self.number.get(w, missing) for w in words), ">u4", len(words)).tobytes()

    def longest(self, coded: bytes, at: int, below: int) -> tuple[int, int]:
        """The most words from `at` on that a document under `below` holds, and where in the order it does. In the order
        of suffixes its neighbours share the most with it: the nearest of such documents on either side are compared. The
        place is sought with a few words first, then with twice as many among those that have these."""
        letters, order = self.letters, self.order
        low, high, words = 0, len(order), 16
        while True:
            probe = coded[4 * at : 4 * (at + words)]
            size = len(probe)
            key = lambda p: letters[4 * p : 4 * p + size]  # noqa: B023, E731
            low = bisect_left(order, probe, low, high, key=key)
            if size < 4 * words:
                break
            high = bisect_right(order, probe, low, high, key=key)
            if low == high:
                break
            words *= 2
        best, where = 0, -1
        for k in (self._ahead(low, below), self._behind(low - 1, below)):
            if k >= 0 and (n := _common(coded, at, letters, order[k])) > best:
                best, where = n, k
        return best, where

    def _ahead(self, k: int, below: int) -> int:
        """The first place from k on with a doc under `below`, or -1."""
        docs, few, many = self.doc_at, self.low[_FEW], self.low[_MANY]
        while k < len(docs):
            if not k % _MANY and many[k // _MANY] >= below:
                k += _MANY
            elif not k % _FEW and few[k // _FEW] >= below:
                k += _FEW
            elif docs[k] < below:
                return k
            else:
                k += 1
        return -1

    def _behind(self, k: int, below: int) -> int:
        """The last place up to k with a doc under `below`, or -1."""
        docs, few, many = self.doc_at, self.low[_FEW], self.low[_MANY]
        while k >= 0:
            if not (k + 1) % _MANY and many[k // _MANY] >= below:
                k -= _MANY
            elif not (k + 1) % _FEW and few[k // _FEW] >= below:
                k -= _FEW
            elif docs[k] < below:
                return k
            else:
                k -= 1
        return -1

    def factors(self, stretch: bytes, below: int, min_words: int) -> list[tuple[int, int, int, int]]:
        """start, words, doc and pos of all factors of the stretch of `min_words` words or more."""
        coded = self.coded(stretch)
        n, at = len(coded) // 4, 0
        found = []

        def parsed(start: int) -> int:
            words, k = self.longest(coded, start, below)
            if words >= min_words:
                found.append((start, words, self.doc_at[k], self.order[k] - int(self.starts[self.owner[k]])))
            return words

        while at <= n - min_words:
            end = at + max(1, parsed(at))
            # the windows that cross the factor's end
            cross = max(at + 1, end - min_words + 1)
            while cross < min(end, n - min_words + 1):
                cross += max(1, parsed(cross) - min_words + 1)
            at = end
        return found


def _common(one: bytes, a: int, two: bytes, b: int) -> int:
    """How many letters of four bytes both have in common from their a-th and b-th on; twice as many are compared each time."""
    found, step = 0, 16
    while True:
        x, y = one[4 * (a + found) : 4 * (a + found + step)], two[4 * (b + found) : 4 * (b + found + step)]
        if x != y or len(x) < 4 * step:
            n = min(len(x), len(y)) // 4
            differ = np.frombuffer(x, "<u4", n) != np.frombuffer(y, "<u4", n)
            return found + (int(differ.argmax()) if differ.any() else n)
        found += step
        step *= 2


def _factor(min_words: int) -> Callable[[pa.Table], pa.Table]:
    def factor(part: pa.Table) -> pa.Table:
        homes, docs, texts, places = (part.column(c).to_pylist() for c in ("home", "doc", "words", "places"))
        if part.column("places").null_count == len(docs):
            return _packed([])
        index = sorted((docs[k], texts[k]) for k in range(len(docs)) if places[k] is None)
        index = ReferenceIndex([d for d, _ in index], [t for _, t in index])
        found: dict[int, list[tuple]] = {}
        for home, doc, stretch, at in zip(homes, docs, texts, places, strict=True):
            if at is not None:
                spans = index.factors(stretch, doc, min_words)
                found.setdefault(home, []).extend((p["row"], p["start"] + a, n, d, pos) for p in at for a, n, d, pos in spans)
        return _packed([(0, home, _SPANS, _pack(np.array(spans, _SPAN))) for home, spans in found.items() if spans])

    return factor


def _remove(layout: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The documents of a block without the words of their factors."""

    def remove(part: pa.Table, back: pa.Table) -> pa.Table:
        if not part.num_rows:
            return part.select(["row"]).append_column("n_words", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64())).append_column("factors", pa.array([], _FACTORS)).append_column("kept", pa.array([], pa.string()))
        row, _, texts = _documents(part)
        got = [_unpack(p, _SPAN) for _, p in _received(back, _SPANS)]
        spans = np.concatenate(got) if got else np.empty(0, _SPAN)
        spans = spans[np.lexsort((spans["words"], spans["start"], spans["row"]))]
        first = np.searchsorted(spans["row"], np.arange(len(texts) + 1))
        counts, removed, factors, kept = [], [], [], []
        for k, text in enumerate(texts):
            words, mine = (text or b"").split(), spans[first[k] : first[k + 1]]
            counts.append(len(words))
            factors.append([{"start": a, "words": n, "doc": d, "pos": p} for _, a, n, d, p in mine.tolist()])
            if not len(mine):
                removed.append(0)
                kept.append(text if layout else b" ".join(words))
                continue
            change = np.zeros(len(words) + 1, np.int32)
            np.add.at(change, mine["start"], 1)
            np.add.at(change, mine["start"] + mine["words"], -1)
            keep = np.cumsum(change[:-1]) == 0
            removed.append(len(words) - int(np.count_nonzero(keep)))
            kept.append(_cut(text, keep) if layout else b" ".join(compress(words, keep.tolist())))
        columns = [row, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(factors, _FACTORS), pa.array([None if x is None else x.decode() for x in kept], pa.string())]
        return pa.table(columns, ["row", "n_words", "n_removed", "factors", "kept"])

    return remove


_FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("doc", pa.int64()), ("pos", pa.int32())]))


def _cut(text: bytes, keep: np.ndarray) -> bytes:
    """The text without the other words and the white space between them; what is kept stays as it is."""
    space = np.isin(np.frombuffer(text, np.uint8), [0x20, 9, 10, 11, 12, 13])
    edges = np.flatnonzero(np.diff(np.concatenate(([1], space.view(np.int8), [1]))))
    starts, ends = edges[::2], edges[1::2]
    drop = np.flatnonzero(np.diff(np.concatenate(([0], (~keep).view(np.int8), [0]))))
    out, at = [], 0
    for a, b in zip(drop[::2], drop[1::2], strict=True):
        out.append(text[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, text[at:]])


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS, layout: bool = False, block_bytes: int = 4 << 20) -> DataFrame:
    """`docs` (doc_id, text, ...) as row (struct of all columns), n_words, n_removed, factors (start and number
    of words; doc and pos of what they repeat) and kept: the words that stay, joined by spaces, or with
    `layout` the text as it is without the words of factors and what lies between them."""
    if min_words < _ANCHOR_WORDS:
        raise ValueError(f"min_words must be {_ANCHOR_WORDS} at least")
    limit_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    buckets = max(8, math.ceil(total / (4 * block_bytes)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    dealt = docs.select(row, F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).alias("block"))
    by_block = dealt.groupBy("block")
    anchors = by_block.applyInArrow(_send_anchors(min_words, buckets), _PACKED)
    shared = anchors.groupBy("bucket").applyInArrow(_meet_anchors, _PACKED)
    windows = by_block.cogroup(shared.groupBy("block")).applyInArrow(_send_windows(min_words, buckets), _PACKED)
    earlier = windows.groupBy("bucket").applyInArrow(_meet_windows, _PACKED)
    back = shared.unionByName(earlier).groupBy("block")
    stretches = by_block.cogroup(back).applyInArrow(_send_stretches(min_words, buckets), _STRETCHES).repartition("block", "home")
    # a block's index is copied only for as many bytes of stretches as it has itself, or a part's least; all columns
    # are read here, so that this and the parse share one exchange of the stretches
    size, index = F.octet_length("words"), F.col("places").isNull()
    used = F.max(F.xxhash64(*stretches.columns)).alias("used")
    sizes = stretches.groupBy("block").agg(F.sum(F.when(index, size)).alias("index"), F.sum(F.when(~index, size)).alias("asked"), used).where("asked > 0 and used is not null")
    parts = sizes.select("block", F.ceil(F.col("asked") / F.greatest(F.col("index"), F.lit(block_bytes // 8))).cast("int").alias("parts"))
    own = F.array(F.pmod(F.xxhash64("home", "words"), F.col("parts")).cast("int"))
    split = stretches.join(parts, "block").withColumn("part", F.explode(F.when(F.col("places").isNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    spans = split.drop("parts").groupBy("block", "part").applyInArrow(_factor(min_words), _PACKED)
    schema = f"row {dealt.schema['row'].dataType.simpleString()}, n_words long, n_removed long, factors array<struct<start:int,words:int,doc:long,pos:int>>, kept string"
    return by_block.cogroup(spans.groupBy("block")).applyInArrow(_remove(layout), schema)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` without words that a document with a smaller doc_id has in the same run of `min_words`; texts
    without any stay byte for byte. n_chars, where there, follows the text."""
    found = find_repeats(docs, min_words, layout=True)
    return found.select(*[
        F.col("kept").alias(c) if c == "text" else F.length("kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ])
