"""Language identification by cross-parsing entropy.

Each language's sample of labelled text becomes a suffix automaton. A text is parsed greedily against each:
a phrase is the longest run of its letters that occurs in the sample (or one letter that never occurs), and
the language with the fewest phrases for each letter wins; ties go to the first by name. The score is the
share of phrases that the winner saves against the second.

Texts are lower-cased; what is not a letter becomes one space. They are parsed in segments of `SEGMENT` letters
side by side, so a task's arrays stay small and long texts are no special case; where a phrase runs on into the
next segment, that one is parsed again from there until both parses begin a phrase at the same letter, so the
phrases are those of the whole text. Training: up to `max_docs` labelled documents of each language (the smallest
hashes of doc_id), whole ones, as long as they add up to `max_chars` at most (the shortest alone if none is so
short), of every language. All letters of the samples count: arcs of the most frequent ones are a dense table of
bounded size, the others sorted keys, as many as the samples have arcs.
Languages are parsed `PASS` at a time; where there are more, each pass hands its best and second counts to the next.

Defined results: null texts and texts without a letter, and all texts if nothing was learned, are `und` with
score 0; a single language wins with score 1; documents without a language don't train; repeated rows are
predicted one by one and learned from once; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import limit_batches, materialise, text_slices

SEGMENT = 512
UNKNOWN = "und"
#: Languages whose automata a Python worker holds at a time.
PASS = 64


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; 0x20 for each run of others than letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    top = int(points.max(initial=0)) + 1
    if top <= 0x3000:
        table = _LETTERS[:top]
        kept = np.where(table[points], points, 0x20)
    else:
        kept = np.array([p if chr(p).isalpha() else 0x20 for p in points.tolist()], np.uint32)
    gap = kept == 0x20
    return kept[~(gap & np.concatenate(([True], gap[:-1])))] if len(kept) else kept


_LETTERS = np.array([chr(p).isalpha() for p in range(0x3000)])


class SuffixAutomaton:
    """Arcs of the suffix automaton of a sequence, built letter by letter."""

    def __init__(self, sequence: list[int]):
        self.arcs: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for letter in sequence:
            last = self._add(last, letter)

    def _state(self, length: int, arcs: dict[int, int], link: int) -> int:
        self.arcs.append(arcs)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _add(self, last: int, letter: int) -> int:
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and letter not in self.arcs[p]:
            self.arcs[p][letter] = new
            p = self.link[p]
        if p >= 0:
            q = self.arcs[p][letter]
            if self.length[q] != self.length[p] + 1:
                copy = self._state(self.length[p] + 1, dict(self.arcs[q]), self.link[q])
                self.link[q] = copy
                while p >= 0 and self.arcs[p].get(letter) == q:
                    self.arcs[p][letter] = copy
                    p = self.link[p]
                q = copy
            self.link[new] = q
        return new


class Parser:
    """Counts phrases against the automata of all languages at once."""

    def __init__(self, samples: dict[str, list[str]], dense: int = 63, dense_bytes: int = 128 << 20):
        self.names = sorted(samples)
        parts = {name: [letters_of(t) for t in samples[name]] for name in self.names}
        seen = Counter()
        for texts in parts.values():
            for t in texts:
                seen.update(dict(zip(*(x.tolist() for x in np.unique(t, return_counts=True)), strict=True)))
        known = sorted(seen, key=lambda p: (-seen[p], p))
        self.unknown = len(known)  # the last code: a letter that no arc has
        self.code = np.full(0x3000, self.unknown, np.int32)
        self.rare = {}
        for k, p in enumerate(known):
            if p < 0x3000:
                self.code[p] = k
            self.rare[p] = k
        found, self.roots = [], []
        base = 0
        for name in self.names:
            sequence: list[int] = []
            for t in parts[name]:
                sequence += [*self.codes(t).tolist(), self.unknown]  # no phrase crosses a text's end
            automaton = SuffixAutomaton(sequence)
            arcs = [(base + state, letter, base + to) for state, out in enumerate(automaton.arcs) for letter, to in out.items() if letter < self.unknown]
            found.append(np.array(arcs, np.int32).reshape(-1, 3))
            self.roots.append(base)
            base += len(automaton.arcs)
        # codes under `dense` have a column; the last column is of all others
        self.dense = min(dense, self.unknown, max(0, dense_bytes // (4 * max(1, base)) - 1))
        state, letter, to = np.concatenate(found).T if found else np.empty((3, 0), np.int32)
        table = np.full((base, self.dense + 1), -1, np.int32)
        often = letter < self.dense
        table[state[often], letter[often]] = to[often]
        self.arcs = table.ravel()
        self.root = np.array(self.roots, np.int32)[:, None]
        self.first = table[self.roots] if self.roots else table[:0]
        keys = state[~often].astype(np.int64) * self.unknown + letter[~often]
        order = np.argsort(keys)
        self.keys, self.ends = keys[order], to[~often][order]

    def _sparse(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Where arcs of letters without a column lead; -1 where there is none."""
        key = state.astype(np.int64) * self.unknown + letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ends[at], -1)

    def codes(self, points: np.ndarray) -> np.ndarray:
        if len(points) and points.max() >= 0x3000:
            return np.array([self.rare.get(p, self.unknown) for p in points.tolist()], np.int32)
        return self.code[points]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """For each coded text and each language the number of phrases."""
        cuts = [(k, t[a : a + SEGMENT]) for k, t in enumerate(texts) for a in range(0, len(t), SEGMENT)]
        owner = np.array([k for k, _ in cuts], np.int64)
        counts, ends = self._parsed([c for _, c in cuts], np.repeat(self.root, len(cuts), axis=1))
        # each later segment begins in the state in which the one before ends
        todo = np.flatnonzero(owner[1:] == owner[:-1]) + 1 if len(cuts) else np.empty(0, np.int64)
        used = np.repeat(self.root, len(cuts), axis=1)
        alone, real = ends.copy(), ends
        corrected = counts.copy()
        while len(todo):
            used[:, todo] = real[:, todo - 1]
            more, ends, together = self._carried([cuts[k][1] for k in todo.tolist()], used[:, todo])
            corrected[:, todo] = counts[:, todo] + more
            real[:, todo] = np.where(together, alone[:, todo], ends)
            following = todo[todo + 1 < len(cuts)] + 1
            following = following[owner[following] == owner[following - 1]]
            todo = following[(real[:, following - 1] != used[:, following]).any(axis=0)]
        out = np.zeros((len(texts), len(self.names)), np.int64)
        np.add.at(out, owner, corrected.T)
        return out

    def _step(self, state: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a letter, and where a phrase begins with it."""
        root = self.root
        column = np.minimum(letters, self.dense)
        to, fresh = self.arcs[state * (self.dense + 1) + column], np.take(self.first, column, axis=1)
        if len(self.keys) and len(rare := np.flatnonzero((letters >= self.dense) & (letters < self.unknown))):
            to[:, rare] = self._sparse(state[:, rare], letters[rare])
            fresh[:, rare] = self._sparse(root, letters[rare])
        end = to < 0
        # a letter that the language never has is a phrase of its own
        return np.where(end, np.where(fresh < 0, root, fresh), to), end | (state == root)

    def _parsed(self, cuts: list[np.ndarray], states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each cut, and the states at its end."""
        counts, ends = np.zeros(states.shape, np.int64), states.copy()
        order = sorted(range(len(cuts)), key=lambda k: -len(cuts[k]))
        for at in range(0, len(order), 2048):
            group = order[at : at + 2048]
            grid, live = self._grid([cuts[k] for k in group])
            state, count = np.ascontiguousarray(states[:, group]), np.zeros((len(states), len(group)), np.int32)
            for letters, n in zip(grid, live, strict=True):
                state[:, :n], begins = self._step(state[:, :n], letters[:n])
                count[:, :n] += begins
            counts[:, group], ends[:, group] = count, state
        return counts, ends

    def _step_each(self, state: np.ndarray, letters: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_step for single states, each with its letter and the number of its language."""
        root, column = self.root[language, 0], np.minimum(letters, self.dense)
        to, fresh = self.arcs[state * (self.dense + 1) + column], self.first[language, column]
        if len(self.keys) and len(rare := np.flatnonzero((letters >= self.dense) & (letters < self.unknown))):
            to[rare], fresh[rare] = self._sparse(state[rare], letters[rare]), self._sparse(root[rare], letters[rare])
        end = to < 0
        return np.where(end, np.where(fresh < 0, root, fresh), to), end | (state == root)

    def _carried(self, cuts: list[np.ndarray], states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of cuts that begin in these states: how many phrases more begin there than in a parse from the root, the
        states at the end, and whether both parses begin a phrase at the same letter (then the states are the other's)."""
        more, ends, together = np.zeros(states.shape, np.int64), states.copy(), states == self.root
        flat, starts = np.concatenate(cuts), np.cumsum([len(c) for c in cuts]) - [len(c) for c in cuts]
        sizes = np.array([len(c) for c in cuts])
        language, cut = np.nonzero(~together)
        real, alone, extra = states[language, cut], self.root[language, 0], np.zeros(len(cut), np.int64)
        at = 0
        while len(cut):
            letters = flat[starts[cut] + at]
            state, begins = self._step_each(np.concatenate([real, alone]), np.concatenate([letters, letters]), np.concatenate([language, language]))
            real, alone = state[: len(cut)], state[len(cut) :]
            one, other = begins[: len(cut)], begins[len(cut) :]
            met = one & other
            extra += np.where(met, 0, one.astype(np.int64) - other)
            at += 1
            stay = ~met & (sizes[cut] > at)
            if not stay.all():
                gone = np.flatnonzero(~stay)
                place = language[gone], cut[gone]
                more[place], ends[place], together[place] = extra[gone], real[gone], met[gone]
                language, cut, real, alone, extra = (x[stay] for x in (language, cut, real, alone, extra))
        return more, ends, together

    def _grid(self, cuts: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
        """Cuts of falling length as columns, and how many of them each row has."""
        sizes = np.array([len(c) for c in cuts])
        grid = np.full((sizes[0], len(cuts)), self.unknown, np.int32)
        for column, c in enumerate(cuts):
            grid[: len(c), column] = c
        return grid, np.searchsorted(-sizes, -np.arange(1, len(grid) + 1), side="right").tolist()


def sample(docs: DataFrame, fold: Column, max_docs: int = 24, max_chars: int = 40_000) -> dict[str, list[str]]:
    """Texts of each language from the rows of `docs` (doc_id, text, lang) for which `fold` holds: at most `max_docs` of a
    language come to the driver, of repeated rows one."""
    keyed = docs.where(F.col("lang").isNotNull() & fold & (F.length("text") > 0)).select("lang", F.xxhash64("doc_id").alias("order"), F.xxhash64("text").alias("own"), F.length("text").alias("size"), "text")
    # repeated rows are learned from once
    known = keyed.groupBy("lang", "order", "own", "size").agg(F.count("*").alias("rows"))
    long = F.when(F.col("size") > max_chars, F.col("size"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(long.asc_nulls_first(), "order", "own"))
    chosen = known.withColumn("rank", rank).where(F.col("rank") <= max_docs).where((F.col("rank") == 1) | (F.col("size") <= max_chars))
    texts = keyed.join(F.broadcast(chosen.drop("rows")), ["lang", "order", "own", "size"]).groupBy("lang", "rank").agg(F.min("text").alias("text"), F.min("size").alias("size"))
    found: dict[str, list[str]] = {}
    room: dict[str, int] = {}
    for row in sorted(texts.collect(), key=lambda r: (r.lang, r.rank)):
        if row.lang not in found or row.size <= room[row.lang]:
            found.setdefault(row.lang, []).append(row.text)
            room[row.lang] = room.get(row.lang, max_chars) - row.size
    return found


#: The parser that a worker process has built, by the name of its samples.
_PARSERS: dict[str, Parser] = {}


def identify(docs: DataFrame, samples: dict[str, list[str]], per_pass: int = PASS) -> DataFrame:
    """doc_id, lang_pred and score of each row of `docs` (doc_id, text)."""
    limit_batches(docs.sparkSession)
    names = sorted(samples)
    rows = docs.select("doc_id", "text")
    for at in range(0, max(1, len(names)), per_pass):
        last = at + per_pass >= len(names)
        rows = _passed(rows, {name: samples[name] for name in names[at : at + per_pass]}, at == 0, last)
        rows = rows if last else materialise(rows)
    return rows


def _passed(rows: DataFrame, samples: dict[str, list[str]], first: bool, last: bool) -> DataFrame:
    """`rows` with the best language so far, its phrases and those of the second; after the last pass, the result."""
    shared, name = rows.sparkSession.sparkContext.broadcast(samples), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[name] = Parser(shared.value)
        parser = _PARSERS[name]
        for batch in text_slices(batches, limit=1 << 20):
            points = [letters_of(t or "") for t in batch.column("text").to_pylist()]
            counts = parser.phrases([parser.codes(p) for p in points]) if parser.names else np.zeros((len(points), 0), np.int64)
            before = [(None, None, None)] * len(points) if first else zip(*(batch.column(c).to_pylist() for c in ("best", "least", "second")), strict=True)
            found: list[tuple] = []
            for p, row, (best, least, second) in zip(points, counts.tolist(), before, strict=True):
                if not len(p[p != 0x20]) or not row:
                    found.append((UNKNOWN, 0.0) if last else (None, None, None))
                    continue
                k = min(range(len(row)), key=row.__getitem__)
                rest = [*row[:k], *row[k + 1 :], *([] if second is None else [second])]
                # ties go to the first by name, and earlier passes have those
                if least is None or row[k] < least:
                    best, least, rest = parser.names[k], row[k], rest + ([] if least is None else [least])
                else:
                    rest.append(row[k])
                second = min(rest, default=None)
                found.append((best, 1.0 if second is None else 1.0 - least / second) if last else (best, least, second))
            columns = [[f[k] for f in found] for k in range(2 if last else 3)]
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64())], ["doc_id", "lang_pred", "score"])
            else:
                held = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *held], ["doc_id", "text", "best", "least", "second"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, lang_pred string, score double" if last else f"doc_id {kind}, text string, best string, least long, second long")
