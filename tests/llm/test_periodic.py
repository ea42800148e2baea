"""Periodic runs: suffixes, squares and runs by brute force, and the query as it is registered."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from loglattice.llm import periodic, queries
from loglattice.llm.common import table

from .cases import frame, texts, words

SF = "/root/testdata/sf0.001"


def _runs(have, least):
    """Every stretch of words that equal those q before them, for every q; the smallest q of each stretch."""
    found = {}
    for q in range(1, len(have) // 2 + 1):
        begin = q
        for k in range(q, len(have) + 1):
            if k == len(have) or have[k] != have[k - q]:
                if k - begin >= q and k - begin + q >= least:
                    found.setdefault((begin - q, k - begin + q), q)
                begin = k + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def _repeating(seed):
    random.seed(seed)
    docs = []
    for _ in range(random.randint(1, 6)):
        n, kinds = random.choice([0, 1, 2, 5, 30, 70]), random.choice([1, 2, 3, 8])
        have = [b"w%d" % random.randrange(kinds) for _ in range(n)]
        if n > 4 and random.random() < 0.5:
            a, p = random.randrange(n), random.randint(1, n // 2)
            have = [have[k] if k < a else have[a + (k - a) % p] for k in range(n)]
        docs.append(have)
    return docs


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_by_brute_force(least):
    for seed in range(150):
        docs = _repeating(seed)
        got = periodic.runs_of(*periodic._letters(docs), least)
        assert got == [(k, *run) for k, have in enumerate(docs) for run in _runs(have, least)]


def test_suffixes_and_common_prefixes():
    letters = np.random.default_rng(3).integers(0, 3, 400)
    letters[200:300] = letters[100:200]
    order, rounds = periodic.sorted_suffixes(letters)
    plain = sorted(range(400), key=lambda k: letters[k:].tolist())
    assert order.tolist() == plain
    shared = periodic.common_prefixes(order, rounds)
    for k in range(1, 400):
        a, b = letters[plain[k - 1] :].tolist(), letters[plain[k] :].tolist()
        assert shared[k] == next((m for m, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_long_texts_do_not_stall():
    for have in ([b"a", b"b", b"c"] * 100_000, [b"x"] * 300_000):
        assert periodic.runs_of(*periodic._letters([have])) == [(0, 0, 300_000, len(set(have)))]


def test_runs_of_documents(spark):
    rows = [*texts(), (20, "again " * 50), (20, "again " * 50), (21, words(9, 1) + " x y z" * 6 + " x\n" + words(9, 2)), (22, "été  été\t" * 7)]
    found = periodic.find_runs(frame(spark, rows))
    got = sorted(((r.row.doc_id, r.text, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()), key=str)
    want = []
    for doc_id, text in rows:
        have = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = _runs(have, 12)
        gone = {k for start, length, q in runs for k in range(start + q, start + length)}
        want.append((doc_id, text, len(have), runs, " ".join(w for k, w in enumerate(have) if k not in gone)))
    assert got == sorted(want, key=str)
    docs = frame(spark, rows)
    kept = periodic.remove_runs(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=str) == sorted(((d, c if runs else t, len(c if runs else t) if t is not None else None) for d, t, _, runs, c in want), key=str)
    assert periodic.find_runs(frame(spark, [])).count() == periodic.remove_runs(frame(spark, [])).count() == 0


def test_query(spark):
    want = set()
    for row in table(spark, SF, "documents").collect():
        have = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        h, n = zlib.crc32(str(row.doc_id).encode()), len(have)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            have = [w if k < a else have[a + (k - a) % p] for k, w in enumerate(have)]
        runs = _runs(have, 12) if n < 4000 else [r[1:] for r in periodic.runs_of(*periodic._letters([[w.encode() for w in have]]))]
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        gone = {k for start, length, q in runs for k in range(start + q, start + length)}
        numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = " ".join(w for k, w in enumerate(have) if k not in gone)
        want.add((row.doc_id, len(runs), *numbers, sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest()))
    got = queries.op12_periodic(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    assert {tuple(r) for r in got.collect()} == want
