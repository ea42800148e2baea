"""Exact dedup: the code, the exchange, and groups by brute force."""

from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from loglattice.llm import exact

from .cases import frame, texts


@pytest.mark.parametrize(("n", "bits"), [(0, 48), (1, 48), (1000, 48), (100_000, 48), (60, 6), (64, 6)])
def test_golomb_code_is_exact(n, bits):
    values = np.sort(np.random.default_rng(n).choice(1 << bits, n, replace=False)) if bits < 20 else np.unique(np.random.default_rng(n).integers(0, 1 << bits, n))
    coded = exact.golomb_encode(values, 1 << bits)
    assert (exact.golomb_decode(coded) == values).all()
    if n == 100_000:
        assert len(coded) < n * (48 - 16 + 1.6) / 8  # near the bound of log2(span / n) + 1.5 bits each


def _check(rows, found):
    """`found` (doc_id, keep_id, group_size, kept, sha) against groups of the texts as they are."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[sha256((text or "").encode()).hexdigest()].append(doc_id)
    got = defaultdict(list)
    for r in found:
        got[r.text_sha256].append(r)
    assert got.keys() == groups.keys()
    for digest, docs in groups.items():
        have, known = got[digest], [d for d in docs if d is not None]
        key = lambda d: (d is not None, d or 0)
        assert sorted((r.doc_id for r in have), key=key) == sorted(docs, key=key)
        best = max(known) if known else None
        assert {(r.keep_id, r.group_size) for r in have} == {(best, len(docs))}
        assert [r.doc_id for r in have if r.kept] == [best]


ROWS = [*texts(), *[(1000 + k, "the same again") for k in range(700)], *[(5, "one id, one text")] * 40, (None, "no id"), (None, "no id"), (None, "mixed"), (2, "mixed")]


@pytest.mark.parametrize("small", [{}, {"block_rows": 9, "owner_rows": 40}, {"block_rows": 9, "owner_rows": 40, "bits": 5}])
def test_groups_by_brute_force(spark, small):
    """The last case has 32 fingerprints only: nearly all texts are suspects, and only bytes tell them apart."""
    found = exact.exact_groups(frame(spark, ROWS).repartition(3), **small)
    assert found.columns == ["row", "keep_id", "group_size", "kept", "text_sha256"]
    _check(ROWS, found.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_rows_that_stay_are_whole(spark):
    docs = frame(spark, ROWS)
    kept = exact.remove_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    rows = [tuple(r) for r in kept.collect()]
    assert {r[0] for r in rows if not r[1]} == {7}  # null and empty are one group, the largest id has its own text
    assert len({r[1] for r in rows}) == len(rows) == len({t or "" for _, t in ROWS})
    assert set(rows) <= {tuple(r) for r in docs.collect()}
    assert exact.remove_exact_duplicates(frame(spark, [])).count() == 0
    assert [r.text for r in exact.remove_exact_duplicates(frame(spark, [(1, ""), (2, None)])).collect()] == [None]
