"""Phrase counts and collocations by vertical partitioning of word suffixes.

1. Texts are cut into pieces and words once. What is written is, for each language and half a million words, the list
   of different words and their numbers in the order of the text (0 ends a piece).
2. Vertical partitioning: occurrences of every word are counted. A prefix that begins more suffixes than `budget` is
   extended by one word, counted again and so on, until every prefix fits or has `max_words` words. Prefixes of a
   sixteenth of the budget or more are packed into groups by their counts, the many small ones by a hash into as many
   groups as their total asks for. No list of all prefixes is ever in one place: the longer ones are some sixteen for
   each `budget`, which is never under a `1 / MOST_GROUPS` of all words.
3. Each task sorts the suffixes of its words, cut after `max_words` words, adds up equal ones and sends each group
   those with its prefixes. A group sorts what it gets, which is its suffix subtree: suffixes are leaves, and
   neighbours that share k words are under one node at depth k. A phrase's count is the total of its node's leaves.
   Groups know nothing of each other.

Counts of at least `min_count` are kept: all parts of such a phrase are among them. Scores are joins on that table.

Defined results: null texts are empty and have no words; a null lang is the language `und`; repeated rows count
as often as they are there; phrases never cross pieces or documents; an empty table gives no rows; a very long text is
cut into stretches of half a million words that overlap by a phrase. No other column is read, whatever its name. Ties in
score go to the larger count, then to the smaller phrase by UTF-8 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import limit_batches, materialise, pack_array, text_slices, unpack_array, utf8

#: The budget is never less than this share of all words, so that prefixes over it are few.
MOST_GROUPS = 50_000
_STRETCH = (1 << 19) - 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Every mark that ends a piece becomes a full stop; A-Z become a-z.
_MARKS = b".,;:!?\n\x0b\x0c\r"
_LETTERS = bytes.maketrans(_MARKS + bytes(range(65, 91)), b"." * len(_MARKS) + bytes(range(97, 123)))

_ENCODED = "lang string, own int, n long, words binary, ids binary"
_COUNTED = "lang string, phrase binary, f long"
_SENT = "group long, lang string, words binary, columns binary"
_PHRASES = "lang string, phrase string, words int, f long"

#: For each language and length the prefixes that are extended.
Hot = dict[str, list[list[bytes]]]


def _tokens(text: bytes) -> list[bytes]:
    """Words, and full stops between pieces."""
    return text.translate(_LETTERS).replace(b".", b" . ").split()


def _encode(max_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}

        def leave(lang: str) -> Iterator[pa.RecordBatch]:
            tokens = held.pop(lang)
            for at in range(0, len(tokens), _STRETCH):
                yield _encoded(lang, tokens[at : at + _STRETCH + max_words - 1], _STRETCH)

        for batch in text_slices(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                held.setdefault(lang, []).extend(_tokens(b".".join([*texts, b""])))
            # a task holds about two stretches, however many languages there are
            while sum(map(len, held.values())) >= 2 * _STRETCH:
                yield from leave(max(held, key=lambda lang: len(held[lang])))
        for lang in list(held):
            yield from leave(lang)

    return encode


def _encoded(lang: str, tokens: list[bytes], most: int) -> pa.RecordBatch:
    """A stretch: phrases begin at its first `own` tokens, the others only end them."""
    own = min(most, len(tokens))
    number = {w: k for k, w in enumerate(dict.fromkeys([b".", *tokens]))}
    ids = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
    words = b" ".join(w for w in number if w != b".")
    rows = [lang], [own], [int(np.count_nonzero(ids[:own]))], [words], [pack_array(ids)]
    types = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], ["lang", "own", "n", "words", "ids"])


class _Stretch:
    """The words of a stretch and, for each place, how long the prefix is that decides its group."""

    def __init__(self, words: bytes, ids: bytes, own: int, hot: list[list[bytes]], max_words: int):
        self.words = [b".", *words.split()]
        self.own = own
        # behind the end there are breaks
        self.ids = np.append(unpack_array(ids, "<i4"), np.zeros(max_words, np.int32))
        #: Of places that begin a word: those whose first k words (k = levels) are extended ones all, with the number of
        #: that prefix, and the word behind it.
        self.at = np.flatnonzero(self.ids[:own])
        self.length = np.zeros(own, np.int8)
        self.length[self.at] = 1
        number = {w: k for k, w in enumerate(self.words)} if hot else {}
        self.prefix, self.last = np.zeros(len(self.at), np.int64), self.ids[self.at]
        known: dict[bytes, int] = {b"": 0}
        for k, phrases in enumerate(hot, 1):
            codes: dict[int, int] = {}
            ranks: dict[bytes, int] = {}
            for rank, phrase in enumerate(phrases):
                head, _, tail = phrase.rpartition(b" ")
                if head in known and tail in number:
                    codes[known[head] * len(self.words) + number[tail]] = ranks[phrase] = rank
            keys = np.array(sorted(codes), np.int64)
            code = self.prefix * len(self.words) + self.last
            place = np.minimum(np.searchsorted(keys, code), max(0, len(keys) - 1))
            chosen = np.flatnonzero(keys[place] == code) if len(keys) else np.empty(0, np.int64)
            rank_of = np.array([codes[c] for c in keys.tolist()], np.int64)
            self.at, self.prefix = self.at[chosen], rank_of[place[chosen]]
            self.last = self.ids[self.at + k]
            # a piece that ends with an extended prefix: counted with that prefix
            self.length[self.at] = np.where(self.last > 0, k + 1, 0)
            going = self.last > 0
            self.at, self.prefix, self.last = self.at[going], self.prefix[going], self.last[going]
            known = ranks

    def extended(self, hot: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
        """The extensions by one word of the longest extended prefixes, and how often they are there."""
        codes, counts = np.unique(self.prefix * len(self.words) + self.last, return_counts=True)
        heads = hot[-1] if hot else [b""]
        pairs = zip((codes // len(self.words)).tolist(), (codes % len(self.words)).tolist(), strict=True)
        return [heads[h] + b" " + self.words[w] if hot else self.words[w] for h, w in pairs], counts


def _stretches(batches: Iterator[pa.RecordBatch], hot: Hot, max_words: int) -> Iterator[tuple[str, _Stretch]]:
    for batch in batches:
        for lang, own, words, ids in zip(*(batch.column(c).to_pylist() for c in ("lang", "own", "words", "ids")), strict=True):
            yield lang, _Stretch(words, ids, own, hot.get(lang, []), max_words)


def _count(hot: Hot, level: int, max_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of words, or of the extensions of hot prefixes of level - 1 words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, stretch in _stretches(batches, hot, max_words):
            levels = hot.get(lang, [])
            if len(levels) == level - 1 and len(stretch.at):
                phrases, counts = stretch.extended(levels)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64())], ["lang", "phrase", "f"])

    return count


def _send(hot: Hot, placed: dict[tuple[str, bytes], int], hashed: int, max_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each group's suffixes of a stretch, equal ones added up. The first groups are those of `placed` prefixes, `hashed` more
    have the others."""
    first = max(placed.values(), default=-1) + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word: dict[tuple[str, bytes], list[tuple[list[bytes], int]]] = {}
        for (lang, phrase), group in placed.items():
            parts = phrase.split(b" ")
            by_word.setdefault((lang, parts[0]), []).append((parts, group))
        for lang, stretch in _stretches(batches, hot, max_words):
            suffixes, lengths, counts = _suffixes(stretch, max_words)
            if not len(counts):
                continue
            seed = xxhash.xxh64_intdigest(lang.encode())
            hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in stretch.words], np.uint64)
            prefix = np.zeros(len(counts), np.uint64)
            for k in range(max_words):
                more = lengths > k
                prefix[more] = (prefix[more] ^ hashes[suffixes[k][more]]) * _MIX
                prefix ^= prefix >> np.uint64(29)
            group = (prefix % np.uint64(max(1, hashed))).astype(np.int64) + first
            _place(group, suffixes, lengths, stretch.words, [p for w in stretch.words for p in by_word.get((lang, w), ())])
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.diff(group[order], prepend=-1))
            mark, new = np.zeros(len(stretch.words), bool), np.zeros(len(stretch.words), np.int32)
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
                at = order[a:b]
                own = [c[at] for c in suffixes]
                mark[0] = True
                for c in own:
                    mark[c] = True
                used = np.flatnonzero(mark)
                mark[used] = False
                new[used] = np.arange(len(used))
                columns = np.stack([*[new[c] for c in own], lengths[at], counts[at]]).astype("<i4")
                words = b" ".join([stretch.words[w] for w in used[1:].tolist()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group[at[0]]], pa.int64()), pa.array([lang]), pa.array([words], pa.binary()), pa.array([pack_array(columns.ravel())], pa.binary())],
                    ["group", "lang", "words", "columns"],
                )

    return send


def _suffixes(stretch: _Stretch, max_words: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The different suffixes as columns of words, with the lengths of their prefixes and their counts. Those whose prefix
    has `max_words` words are counted already."""
    at = np.flatnonzero((stretch.length > 0) & (stretch.length < max_words))
    columns, going = [], np.ones(len(at), bool)
    for k in range(max_words):
        word = np.where(going, stretch.ids[at + k], 0)
        going = word > 0
        columns.append(word)
    order = np.lexsort(_keys(columns, len(stretch.words)))
    columns = [c[order] for c in columns]
    new = np.flatnonzero(_shared(columns) < max_words)
    return [c[new] for c in columns], stretch.length[at][order][new], np.diff(np.append(new, len(at)))


def _keys(columns: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Sort keys, the last one first, with as many columns in each as fit."""
    fit = max(1, 62 // max(1, size).bit_length())
    keys = []
    for k in range(0, len(columns), fit):
        key = columns[k].astype(np.int64)
        for c in columns[k + 1 : k + fit]:
            key = key * (size + 1) + c
        keys.append(key)
    return keys[::-1]


def _shared(columns: list[np.ndarray]) -> np.ndarray:
    """How many words each suffix shares with the one before; 0 for the first."""
    shared = np.zeros(len(columns[0]), np.int8)
    same = np.ones(max(0, len(shared) - 1), bool)
    for c in columns:
        same &= c[1:] == c[:-1]
        shared[1:] += same
    return shared


def _place(group: np.ndarray, suffixes: list[np.ndarray], lengths: np.ndarray, words: list[bytes], placed: list[tuple[list[bytes], int]]) -> None:
    """Gives suffixes with placed prefixes their groups. Suffixes are sorted, so a prefix is a stretch of them."""
    number = {w: k for k, w in enumerate(words)}
    for parts, target in placed:
        if any(w not in number for w in parts):
            continue
        a, b = 0, len(group)
        for column, w in zip(suffixes, parts, strict=False):
            a, b = a + int(np.searchsorted(column[a:b], number[w])), a + int(np.searchsorted(column[a:b], number[w], side="right"))
        if a < b and lengths[a] == len(parts):
            group[a:b] = target


def _subtrees(max_words: int, min_count: int) -> Callable[[pa.Table], pa.Table]:
    """The phrases of a group with their counts, from the sorted suffixes of each language."""

    def subtrees(part: pa.Table) -> pa.Table:
        found: list[tuple] = []
        messages: dict[str, list[tuple[bytes, bytes]]] = {}
        for lang, words, columns in zip(*(part.column(c).to_pylist() for c in ("lang", "words", "columns")), strict=True):
            messages.setdefault(lang, []).append((words, columns))
        for lang, own in messages.items():
            number: dict[bytes, int] = {b"": 0}
            parts = []
            for words, packed in own:
                local = np.array([0, *[number.setdefault(w, len(number)) for w in words.split()]], np.int32)
                columns = unpack_array(packed, "<i4").reshape(max_words + 2, -1)
                parts.append([*[local[c] for c in columns[:max_words]], *columns[max_words:]])
            *suffixes, lengths, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort(_keys(suffixes, len(number)))
            suffixes = [c[order] for c in suffixes]
            lengths, total = lengths[order], np.append(0, np.cumsum(counts[order].astype(np.int64)))
            shared, names = _shared(suffixes), list(number)
            for k in range(1, max_words + 1):
                # nodes at depth k, with their leaves from one start to the next
                nodes = np.flatnonzero(shared < k)
                leaves = total[np.append(nodes[1:], len(order))] - total[nodes]
                real = nodes[(leaves >= min_count) & (suffixes[k - 1][nodes] > 0) & (lengths[nodes] <= k)]
                sums = leaves[np.searchsorted(nodes, real)]
                for at, f in zip(real.tolist(), sums.tolist(), strict=True):
                    found.append((lang, b" ".join([names[c[at]] for c in suffixes[:k]]).decode(), k, f))
        types = [pa.string(), pa.string(), pa.int32(), pa.int64()]
        return pa.table([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], ["lang", "phrase", "words", "f"])

    return subtrees


def _packed_groups(prefixes: list[tuple[str, bytes, int]], budget: int) -> dict[tuple[str, bytes], int]:
    """Prefixes in groups of at most `budget` suffixes, the largest first, each group filled in turn."""
    groups, group, room = {}, -1, 0
    for lang, phrase, f in sorted(prefixes, key=lambda p: (-p[2], p[0], p[1])):
        if f > room:
            group, room = group + 1, budget
        groups[lang, phrase] = group
        room -= f
    return groups


def phrase_counts(docs: DataFrame, min_count: int = 100, max_words: int = 5, budget: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) for every phrase of up to `max_words` words that is in the pieces of `docs` (lang, text, ...)
    `min_count` times or more, and (lang, n) with the number of all words."""
    limit_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    encoded = materialise(texts.mapInArrow(_encode(max_words), _ENCODED))
    sizes = encoded.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")
    budget = max(budget, (sizes.agg(F.sum("n")).first()[0] or 0) // MOST_GROUPS)
    hot: Hot = {}
    large, small, counted = [], 0, []
    for level in range(1, max_words + 1):
        parts = encoded.mapInArrow(_count(hot, level, max_words), _COUNTED)
        table = materialise(parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
        read = ["lang", F.decode("phrase", "UTF-8").alias("phrase"), F.lit(level).alias("words"), "f"]
        if level == max_words:
            counted.append(table.where(F.col("f") >= min_count).select(*read))
            break
        counted.append(table.where((F.col("f") > budget) & (F.col("f") >= min_count)).select(*read))
        small += table.where(F.col("f") <= budget // 16).agg(F.sum("f")).first()[0] or 0
        larger = [(r.lang, bytes(r.phrase), r.f) for r in table.where(F.col("f") > budget // 16).collect()]
        large += [p for p in larger if p[2] <= budget]
        longer = [p for p in larger if p[2] > budget]
        for lang, phrase, _ in longer:
            if len(levels := hot.setdefault(lang, [])) < level:
                levels.append([])
            levels[-1].append(phrase)
        if not longer:
            break
    placed, hashed = _packed_groups(large, budget), math.ceil(small / max(1, budget // 2))
    groups = len(set(placed.values())) + max(1, hashed)
    # a task for each group, however many there are
    sent = encoded.mapInArrow(_send(hot, placed, hashed, max_words), _SENT).repartition(groups, "group")
    trees = sent.groupBy("group").applyInArrow(_subtrees(max_words, min_count), _PHRASES)
    for rows in counted:
        trees = trees.unionByName(rows)
    return materialise(trees), sizes


def mine_collocations(docs: DataFrame, min_count: int = 100, max_words: int = 5, top: int = 2000, budget: int = 1 << 20) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `max_words` words with a >= `min_count`
    occurrences, by the least score of their cuts. A cut's score is floor(1000 a n / (l r)) with the counts l and r of its
    parts and n words in all. A phrase inside a longer one that is as frequent is left out."""
    return rank_phrases(*phrase_counts(docs, min_count, max_words, budget), top)


def rank_phrases(counts: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """The collocations of a table of phrase counts."""
    words, size = F.split("phrase", " "), F.col("words")
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")
    # one word more at a time: a longer phrase with the same count has all those between with that count
    longer = counts.where("words > 2").select("lang", F.explode(F.array(part(F.lit(1), size - 1), part(F.lit(2), size - 1))).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = counts.where("words > 1").join(longer, ["lang", "phrase"], "left").where("longer is null or longer < f")
    cuts = kept.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, size - F.col("cut")).alias("right"))
    side = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(sizes, "lang")
    # up to 1,000 times the square of all words, over 64 bits
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    scored = scored.withColumn("above", wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("below", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("above div below"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best"))
    # the first of each part of a language, then the first of those
    parts, order = F.pmod(F.xxhash64("phrase"), F.lit(256)), (F.desc("score"), F.desc("a"), "phrase")
    first = best.select("lang", "phrase", "best.*").withColumn("rank", F.row_number().over(Window.partitionBy("lang", parts).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
