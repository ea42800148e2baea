"""The numbered queries and the pipeline's stages as they are registered, on the smallest tables, against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from loglattice.llm import language, packing, quality, queries, toxicity
from loglattice.llm.common import crc_bucket, materialise, table
from loglattice.llm.tokens import default_tokenizer
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def _fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def _components(nodes, linked):
    root = {n: n for n in nodes}
    for a, b in linked:
        a, b = root[a], root[b]
        if a != b:
            for n in nodes:
                if root[n] == max(a, b):
                    root[n] = min(a, b)
    return root


def _features(text):
    """Every n-gram of its letters hashed alone, by whole numbers."""
    letters = b" " + re.sub(rb"[^0-9a-z\x80-\xff]", b" ", text.encode().lower()) + b" "
    found = set()
    for n in toxicity.LENGTHS:
        for k in range(len(letters) - n + 1):
            rolling = letters[k]
            for m, letter in enumerate(letters[k + 1 : k + n], 2):
                rolling = (rolling * 0x9E3779B1 + letter + m) % (1 << 32)
            found.add(((rolling ^ rolling >> 15) * 0x85EBCA6B % (1 << 32)) >> (32 - toxicity.BITS))
    return sorted(found)


def test_toxicity_query(spark, texts):
    got = queries.op3_toxicity(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    weights, bias = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"), "toxic", crc_bucket("doc_id", 5) > 0)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows.keys() == texts.keys()
    for doc_id, row in rows.items():
        assert row.held_out == (_fold(doc_id, 5) == 0) and row.predicted == int(row.score >= 0.5)
    for doc_id in sorted(texts, key=lambda d: len(texts[d]))[:60]:
        features = _features(texts[doc_id])
        margin = float(weights[features].astype(float).sum()) / max(1, len(features)) ** toxicity.POWER + bias
        assert rows[doc_id].score == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-4)


def test_toxicity_fit_is_the_least_loss():
    random = np.random.default_rng(5)
    labels = np.array([0, 1] * 60)
    rows = [np.unique(random.integers(0, 24, 12) + 4 * label).astype(np.int32) for label in labels.tolist()]
    ratios = toxicity.log_ratios(rows, labels, 6)
    dense = np.zeros((len(rows), 64))
    for k, row in enumerate(rows):
        dense[k, row] = ratios[row] * len(row) ** -toxicity.POWER
    weights, bias = toxicity.fit(rows, labels, bits=6, penalty=1e-2, steps=20_000)
    own = np.divide(weights, ratios, out=np.zeros(64), where=ratios != 0)
    error = 1 / (1 + np.exp(-(dense @ own + bias))) - labels
    assert (ratios != 0).sum() > 3 and np.abs(error.mean()) < 1e-4 and np.abs(dense.T @ error / len(rows) + 1e-2 * own).max() < 1e-4


def test_quality_query(spark, texts):
    got = queries.op10_quality(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    fold = crc_bucket("doc_id", 3)
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"), "quality", (fold >= 0) & (fold != 1))
    for row in got.collect():
        statistics = quality.statistics_of(texts[row.doc_id].encode())
        holds = [w for rule, w in model.rules if all((statistics[c.statistic] > c.threshold) == c.above for c in rule)]
        assert row.score == pytest.approx(1 / (1 + np.exp(-(sum(holds) + model.bias))), abs=1e-6)
        assert row.held_out == (_fold(row.doc_id, 3) == 1) and row.predicted == int(row.score >= 0.5)


def test_lasso_is_the_least_loss():
    random = np.random.default_rng(2)
    design = (random.random((300, 20)) < 0.4).astype(np.float32)
    labels = (design[:, 0] + design[:, 3] - design[:, 7] + random.normal(0, 0.6, 300) > 0.5).astype(float)
    weights, bias = quality._lasso(design, labels, 2e-2, steps=20_000)
    slope = design.T @ (1 / (1 + np.exp(-(design @ weights + bias))) - labels) / len(labels)
    zero = weights == 0
    assert 0 < zero.sum() < 20 and np.abs(slope[zero]).max() <= 2e-2 + 1e-4
    assert np.abs(slope[~zero] + 2e-2 * np.sign(weights[~zero])).max() < 1e-4


def test_language_query(spark, texts):
    got = {r.doc_id: r for r in queries.op5_language(spark, SF).collect()}
    assert got.keys() == texts.keys() and all(r.held_out == (_fold(d, 4) == 2) for d, r in got.items())
    fold = crc_bucket("doc_id", 4)
    samples = language.sample(table(spark, SF, "documents"), (fold >= 0) & (fold != 2))
    plain = lambda t: "".join(map(chr, language.letters_of(t).tolist()))
    held = {name: "\n".join(map(plain, parts)) for name, parts in samples.items()}
    for doc_id in sorted(texts, key=lambda d: len(texts[d]))[:80]:
        text, counts = plain(texts[doc_id]), {}
        if not text.strip():
            assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
            continue
        for name in sorted(held):
            at = counts[name] = 0
            while at < len(text):
                size = 1
                while at + size < len(text) and text[at : at + size + 1] in held[name]:
                    size += 1
                at, counts[name] = at + size, counts[name] + 1
        best, second = sorted(counts.values())[:2]
        assert got[doc_id].lang_pred == min(counts, key=counts.get) and got[doc_id].score == pytest.approx(1 - best / second)


def test_simhash_query(spark, texts):
    prints = {}
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else []
        bits = np.array([[h >> b & 1 for b in range(64)] for h in hashes]).reshape(-1, 64).sum(axis=0)
        prints[doc_id] = sum(1 << b for b in range(64) if bits[b] * 2 > len(hashes))
    group = _components(sorted(prints), [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    got = queries.op6_simhash(spark, SF)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()} == {(d, f"{prints[d]:016x}", group[d]) for d in texts}


def test_token_file_query(spark, texts, tokenizer):
    want, start = set(), 0
    for doc_id in sorted(texts):
        ids = [*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        want.add((doc_id, start, len(ids), _crc(ids)))
        start += len(ids)
    got = queries.op7_token_files(spark, SF)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()} == want


def _pieces(texts, tokenizer):
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            yield doc_id, k, a, b - a, _crc(ids[a:b])


def _check_packing(rows, texts, tokenizer):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(_pieces(texts, tokenizer))
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= packing.lower_bound(np.array([r.length for r in rows]), 1024) + 1


def test_packing_query(spark, texts, tokenizer):
    _check_packing(queries.op8_packing(spark, SF).collect(), texts, tokenizer)


def test_stages_by_brute_force(spark, tokenizer):
    """Each stage against what its decisions should be, on what the stage before it kept."""
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    model = quality.train(docs, table(spark, SF, "labels"), "quality", crc_bucket("doc_id", 1) >= 0)
    good = {r[0] for r in quality.score(docs, model).where("score >= 0.5").select("row.doc_id").collect()}
    after = materialise(stages["quality classifier"](spark, docs, SF))
    before, now = read(docs), read(after)
    assert now == {d: t for d, t in before.items() if d in good}

    after = materialise(stages["simhash near-dedup"](spark, after, SF))
    before, now, sets = now, read(after), {}
    for doc_id, text in before.items():
        words = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    group = _components(sorted(sets), [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    assert now == {d: t for d, t in before.items() if group[d] == d}

    after = materialise(stages["substring dedup"](spark, after, SF))
    before, now, first = now, read(after), {}
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in before.items()}
    for doc_id in sorted(words):
        for k in range(len(words[doc_id]) - 12):
            first.setdefault(tuple(words[doc_id][k : k + 13]), doc_id)
    for doc_id, have in words.items():
        keep = [True] * len(have)
        for k in range(len(have) - 12):
            if first[tuple(have[k : k + 13])] < doc_id:
                keep[k : k + 13] = [False] * 13
        assert (now[doc_id] or "").split() == [w for w, stays in zip(have, keep, strict=True) if stays]
        assert not all(keep) or now[doc_id] == before[doc_id]

    after = materialise(stages["benchmark decontamination"](spark, after, SF))
    before, now = now, read(after)
    normal = lambda t: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + min(10, len(w))]) for w in (normal(r.text) for r in table(spark, SF, "benchmark").collect()) if w for k in range(len(w) - min(10, len(w)) + 1)}
    for doc_id, text in before.items():
        have = normal(text)
        hit = {k + j for size in {len(w) for w in windows} for k in range(len(have) - size + 1) if tuple(have[k : k + size]) in windows for j in range(size)}
        if len(hit) > 0.8 * len(have):
            assert doc_id not in now
        else:
            assert normal(now[doc_id]) == [w for k, w in enumerate(have) if k not in hit] and (hit or now[doc_id] == text)
    _check_packing(stages["best-fit packing"](spark, after, SF).collect(), now, tokenizer)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_without_documents(spark, stage):
    docs = table(spark, SF, "documents")
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), SF).count() == 0
