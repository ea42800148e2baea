"""Phrase counts and collocations by brute force, whatever the budget."""

import random
import re
from collections import Counter

import pytest
from loglattice.llm import collocations

SCHEMA = "doc_id long, lang string, text string, phrase string, f int, words string"


def _rows():
    random.seed(5)
    kinds = [f"w{k}" for k in range(9)] + ["Über", "日本", "x y", "a'b", "-"]
    weights = [9 - min(8, k) for k in range(len(kinds))]
    rows = []
    for k in range(160):
        have = random.choices(kinds, weights, k=random.randint(0, 60))
        glue = [random.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ! ", "\r\n"]) for _ in have]
        rows.append((k, random.choice(["en", "en", "de", None]), "".join(w + g for w, g in zip(have, glue, strict=True)), "p", 1, "w"))
    return [*rows, (200, "en", None, "p", 1, "w"), (201, "fr", "", "p", 1, "w"), (202, "fr", " .\n. ", "p", 1, "w"), *[(203, "en", "one two THREE four five six", "p", 1, "w")] * 5, (None, "en", "w0 w1", None, None, None)]


def _pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [found for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered) if (found := re.findall(r"[^\x20\x09]+", piece))]


def _expected(rows, least, most, top):
    counts, sizes = Counter(), Counter()
    for _, lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        for have in _pieces(text):
            sizes[lang] += len(have)
            counts.update((lang, tuple(have[a:b])) for a in range(len(have)) for b in range(a + 1, min(len(have), a + most) + 1))
    often = {key: f for key, f in counts.items() if f >= least}
    inside = set()
    for (lang, x), f in often.items():
        inside |= {(lang, x[a:b], f) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if b - a < len(x)}
    found = []
    for (lang, x), a in often.items():
        if len(x) > 1 and (lang, x, a) not in inside:
            scores = [(1000 * a * sizes[lang] // (often[lang, x[:k]] * often[lang, x[k:]]), k) for k in range(1, len(x))]
            score, k = min(scores)
            found.append((lang, -score, -a, " ".join(x).encode(), a, often[lang, x[:k]], often[lang, x[k:]], sizes[lang], score))
    ranks, out = Counter(), set()
    for lang, _, _, phrase, *numbers in sorted(found):
        ranks[lang] += 1
        if ranks[lang] <= top:
            out.add((lang, ranks[lang], phrase.decode(), *numbers))
    return out, {(lang, " ".join(x), len(x), f) for (lang, x), f in often.items()}, dict(sizes)


@pytest.mark.parametrize("budget", [1 << 21, 200, 40, 3])
def test_collocations_by_brute_force(spark, budget):
    """Small budgets extend prefixes up to the longest phrases, and make many groups."""
    rows = _rows()
    best, phrases, sizes = _expected(rows, 5, 5, 20)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    counts, words = collocations.phrase_counts(docs, min_count=5, budget=budget)
    found = counts.collect()
    assert {tuple(r) for r in found} == phrases and len(found) == len(phrases)
    assert {r.lang: r.n for r in words.collect()} == sizes
    got = collocations.mine_collocations(docs, min_count=5, top=20, budget=budget).collect()
    assert {tuple(r) for r in got} == best and len(got) == len(best) > 30


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    """Stretches of 50 words: phrases across their ends are counted once."""
    monkeypatch.setattr(collocations, "_STRETCH", 50)
    text = " ".join(random.Random(2).choices("abcd", k=1000))
    encoded = list(collocations._encode(5)(iter([_batch(text)])))
    assert len(encoded) == 21
    counts = Counter()
    for batch in encoded:
        stretch = collocations._Stretch(batch["words"][0].as_py(), batch["ids"][0].as_py(), batch["own"][0].as_py(), [], 5)
        columns, _, sums = collocations._suffixes(stretch, 5)
        for row, n in zip(zip(*columns, strict=True), sums, strict=True):
            counts[b" ".join(stretch.words[w] for w in row if w).decode()] += int(n)
    have = text.split()
    assert counts == Counter(" ".join(have[k : k + 5]) for k in range(1000))


def _batch(text):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})


def test_exact_over_64_bits(spark):
    """A product over 2^63: the score is exact all the same."""
    rows = [("en", "a b", 3_000_000_001), ("en", "a", 3_000_000_007), ("en", "b", 3_000_000_019)]
    counts = spark.createDataFrame([(lang, p, len(p.split()), f) for lang, p, f in rows], "lang string, phrase string, words int, f long")
    n = 6_000_000_123
    got = collocations.rank_phrases(counts, spark.createDataFrame([("en", n)], "lang string, n long"), 10).collect()
    assert [r.score for r in got] == [1000 * rows[0][2] * n // (rows[1][2] * rows[2][2])]


def test_no_words(spark):
    for rows in ([], [(1, None, None, None, None, None), (2, "en", " . ", "", 0, "")]):
        docs = spark.createDataFrame(rows, SCHEMA)
        assert collocations.mine_collocations(docs, min_count=1).count() == 0
