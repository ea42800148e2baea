"""Fingerprints, components, near-duplicates and top-k against brute force."""

import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loglattice.llm import simhash, topk
from loglattice.llm.components import connected_components

from .cases import frame, texts, words


def _components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(4)
    chain = [(k, k + 1) for k in range(50)]
    star = [(1000, 1000 + k) for k in random.sample(range(1, 300), 100)]
    mixed = [(random.randint(2000, 2300), random.randint(2000, 2300)) for _ in range(200)]
    edges = [*chain, *star, *mixed, (7, 7), (7, 8)]
    random.shuffle(edges)
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()
    want = _components({x for e in edges for x in e}, edges)
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _bits(text):
    have = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(have[k : k + 4]) for k in range(max(1, len(have) - 3))] if have else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprint_groups_by_brute_force(spark):
    rows = [r for r in texts() if r[0] is not None]
    prints = {}
    for k, (_, text) in enumerate(rows):
        prints[k] = _bits(text)
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    group = _components(prints, linked)
    smallest = {}
    for k, g in group.items():
        smallest[g] = min(smallest.get(g, math.inf), rows[k][0])
    got = simhash.simhash_groups(frame(spark, rows)).select("doc_id", simhash.hex_print(F.col("fp")).alias("p"), "component_id").collect()
    assert sorted(tuple(r) for r in got) == sorted((rows[k][0], f"{prints[k]:016x}", smallest[group[k]]) for k in prints)
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("tile", [4096, 3])
def test_links_of_fingerprints(spark, tile):
    random.seed(6)
    values = set()
    for _ in range(12):
        base = random.getrandbits(64)
        for _ in range(12):
            x = base
            for bit in random.sample(range(64), random.randint(0, 7)):
                x ^= 1 << bit
            values.add(x - (1 << 64) if x >> 63 else x)
    edges = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long"), tile=tile).collect()
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = _components(values, [(a, b) for a in values for b in values if a < b and apart(a, b) <= 4])
    assert _components(values, [(r.a, r.b) for r in edges]) == want


@pytest.mark.parametrize("radius", [0, 1, 4, 7, 18])
def test_close_pairs(radius):
    random.seed(radius)
    base = random.getrandbits(63)
    values = np.array([base ^ sum(1 << b for b in random.sample(range(63), random.randint(0, 12))) for _ in range(150)], np.int64)
    got = {(a, b) for x, y in simhash.close_pairs(values, values, radius) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == {(a, b) for a in range(150) for b in range(150) if (int(values[a]) ^ int(values[b])).bit_count() <= radius}


def test_more_fingerprints_take_longer_keys():
    sizes = [len(simhash._choices(n, 4)[0]) for n in (1_000, 10_000_000, 10**10)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1]


@pytest.mark.parametrize("shared", [8, 160])
def test_minima_are_independent(shared):
    """Isolated pairs at Jaccard 0.8: any k of the orders all miss as often as 0.2 ** k says."""
    random = np.random.default_rng(11)
    own, pairs = shared // 8, 20_000
    missed = np.zeros((pairs, simhash._MINIMA), bool)
    for k in range(pairs):
        x = random.integers(0, 1 << 64, shared + 2 * own, np.uint64)
        missed[k] = np.not_equal(simhash._minima(x[: shared + own]), simhash._minima(np.concatenate([x[:shared], x[shared + own :]])))
    for k, most in ((1, 1.05), (2, 1.1), (3, 1.3), (5, 2.5)):
        assert missed[:, :k].all(axis=1).mean() < most * 0.2**k
    assert missed.all(axis=1).sum() <= 1


@pytest.mark.parametrize(("tile", "exact"), [(16_384, False), (4, False), (16_384, True)])
def test_near_duplicates_by_brute_force(spark, tile, exact):
    random.seed(8)
    rows = [r for r in texts() if r[0] is not None]
    for family in range(4):
        base = words(150, 50 + family).split()
        for k in range(9):
            changed = list(base)
            for _ in range(k):
                changed[random.randrange(150)] = f"c{random.random()}"
            rows.append((100 + 10 * family + k, " ".join(changed)))
    sets = {}
    for k, (_, text) in enumerate(rows):
        have = (text or "").encode().lower().split()
        sets[k] = {tuple(have[j : j + 5]) for j in range(max(1, len(have) - 4))} if have else set()
    alike = lambda a, b: (not a and not b) or (bool(a | b) and len(a & b) >= 0.8 * len(a | b))
    group = _components(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    smallest = {}
    for k, g in group.items():
        smallest[g] = min(smallest.get(g, math.inf), rows[k][0])
    got = simhash.near_duplicate_groups(frame(spark, rows), tile=tile, tile_bytes=32 << 20 if tile > 4 else 3000, exact=exact).collect()
    assert sorted(tuple(r) for r in got) == sorted((rows[k][0], smallest[group[k]]) for k in sets)
    kept = simhash.remove_near_duplicates(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {smallest[g] for g in smallest}


def test_near_duplicates_far_apart_in_bits(spark):
    """Pairs over 0.8 by sets, of which one repeats a passage or both are small: fingerprints say little there."""
    rows = []
    for k in range(20):
        base = words(150, 900 + k, 10**6).split()
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base + base[-16:] * 60))]
    for k in range(20, 220):
        base = words(9, 900 + k, 10**6).split()
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base[:8]))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(frame(spark, rows)).collect()}
    assert got == {d: d - d % 10 for d, _ in rows}


def test_exact_groups_without_a_common_minimum(spark, monkeypatch):
    """Minima that never agree leave every pair to the prefixes."""
    rows = [(d, t) for d, t in texts() if d is not None]
    for k in range(30):
        base = words(40 + 7 * k, 300 + k, 10**6).split()
        cut = len(base) // 12
        rows += [(100 + 10 * k, " ".join(base)), (101 + 10 * k, " ".join(base[cut:])), (102 + 10 * k, " ".join(base[: len(base) // 2]))]
    want = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(frame(spark, rows)).collect()}
    assert sum(want[100 + 10 * k] == want[101 + 10 * k] for k in range(30)) == 30
    keyed = simhash._similar_pairs
    monkeypatch.setattr(simhash, "_similar_pairs", lambda docs, nodes, keys, *rest: keyed(docs, nodes, keys.where(F.col("part") == simhash._MINIMA), *rest))
    missed = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(frame(spark, rows)).collect()}
    assert missed[101] == 101
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(frame(spark, rows), exact=True).collect()} == want


def test_no_similar_pair_is_ruled_out():
    random = np.random.default_rng(12)
    sets = []
    for size in (1, 4, 5, 40, 300, 500, 512, 600, 640, 1100, 1300):
        base = random.integers(0, 1 << 64, size, np.uint64)
        for _ in range(12):
            kept = base[random.random(size) > random.choice([0, 0.05, 0.1, 0.2])]
            sets.append(np.unique(np.concatenate([kept, random.integers(0, 1 << 64, random.integers(0, size // 8 + 1), np.uint64)])))
    n, parities = np.array([len(x) for x in sets]), [simhash._parities(x) for x in sets]
    held = [set(x.tolist()) for x in sets]
    want = {(a, b) for a, x in enumerate(held) for b, y in enumerate(held) if x and y and len(x & y) >= 0.8 * len(x | y)}
    assert len({len(p) for p in parities}) > 2 and len(want) > 2 * len(sets)
    for mine in (None, np.arange(0, len(sets), 3)):
        got = {pair for a, b in simhash._possible(parities, n, 0.8, mine) for pair in zip(a.tolist(), b.tolist(), strict=True)}
        assert {p for p in want if mine is None or p[0] % 3 == 0} <= got
        assert len(got) < 0.2 * len(sets) ** 2 and (mine is None or all(a % 3 == 0 for a, _ in got))


@pytest.mark.parametrize("exact", [False, True])
def test_rows_of_one_id_with_different_texts(spark, exact):
    one, two = words(150, 71), words(150, 72)
    near = lambda t: t.replace(t.split()[70], "changed", 1)
    rows = [(1, one), (1, two), (2, near(one)), (3, near(two)), (4, words(150, 73)), (5, None), (6, " "), (1, one)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(frame(spark, rows), exact=exact).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    kept = sorted(r.doc_id for r in simhash.remove_near_duplicates(frame(spark, rows), exact=exact).collect())
    assert kept == [1, 1, 1, 4, 5]


def _best_by_brute_force(rows, step, k):
    whole = lambda v: [math.floor(x * 256) if abs(x) < 1e300 else int(x) * 256 for x in v]
    good = [(i, whole(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for query, q in {(i, tuple(v)) for i, v in good if i % step == 0}:
        scores = sorted((-sum(map(int.__mul__, q, v)), i) for i, v in good if i != query and len(v) == len(q))
        want += [(query, rank, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(want)


@pytest.mark.parametrize("sizes", [(8 << 20, 16 << 20), (1200, 600)])
@pytest.mark.parametrize("large", [1.0, 1e7, 3e9, 1e300])
def test_top_k_by_brute_force(spark, sizes, large):
    random.seed(9)
    rows = [(k, [random.gauss(0, 1) for _ in range(6)]) for k in range(300)]
    rows += [(k, list(rows[7][1])) for k in range(300, 340)]  # one vector many times
    rows += [(50, list(rows[3][1])), (12, list(rows[12][1])), (12, list(rows[12][1]))]  # an id twice, a row three times
    rows += [(400, None), (401, [1.0, None, 0, 0, 0, 0]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (404, []), (None, [1.0] * 6)]
    rows += [(450, [1.0, 2.0]), (451, [2.0, 1.0]), (500, [0.0] * 6), (501, [large, 0.0, 0, 0, 0, 0]), (550, [-large, large, 1, 0, 0, 0])]
    table = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 1, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = topk.top_k(table, row_bytes=sizes[0], query_bytes=sizes[1])
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == _best_by_brute_force(rows, 50, 5)
    assert topk.top_k(table.limit(0)).count() == 0


def test_lists_are_not_read_to_their_ends():
    """Vectors as those of the tables: unit length, 64 components."""
    random = np.random.default_rng(3)
    raw = random.normal(size=(6000, 64))
    raw /= np.linalg.norm(raw, axis=1, keepdims=True)
    ids = np.arange(6000)
    rows, queries = topk.Vectors(ids, raw, 8), topk.Vectors(ids[::50], raw[::50], 8)
    of, found, scores, read = topk.best_rows(rows, queries, 5)
    assert read < 0.8 * len(rows.ids) * len(queries.ids) * 64
    exact = rows.whole @ queries.whole.T
    for k, query in enumerate(queries.ids.tolist()):
        order = [i for i in np.lexsort((ids, -exact[:, k])).tolist() if i != query][:5]
        assert found[of == k].tolist() == order and scores[of == k].tolist() == exact[order, k].tolist()
