"""Decontamination, substrings, tokens, files and packing against brute force over odd documents."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loglattice.llm import decontaminate, packing, substrings, token_files
from loglattice.llm.tokens import Encoder, default_tokenizer

from .cases import frame, texts, words


def _bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _hits(rows, items, window=10):
    out = Counter()
    for doc, text in rows:
        have = _bench_words(text)
        hit, found = set(), set()
        for name, item in items:
            if name is None or item is None:
                continue
            item = _bench_words(item)
            size = min(window, len(item))
            wanted = {tuple(item[k : k + size]) for k in range(len(item) - size + 1)} if size else set()
            for k in range(len(have) - size + 1):
                if tuple(have[k : k + size]) in wanted:
                    hit.update(range(k, k + size))
                    found.add(str(name))
        out[doc, len(have), len(hit), tuple(sorted(found))] += 1
    return out


@pytest.mark.parametrize("block_words", [200_000, 30])
def test_contamination_by_brute_force(spark, block_words):
    rows = texts()
    base = rows[0][1]
    items = [(1, " ".join(base.split()[10:35])), (2, "ONE"), (3, None), (4, ""), (5, words(13, 7)), (6, "日本 x"), (7, " ".join(base.split()[20:31])), (None, base), (5, words(13, 7))]
    found = decontaminate.find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    got = Counter((r.doc_id, r.n_words, r.hit, tuple(r["items"])) for r in found.select("row.doc_id", "n_words", decontaminate.n_hit(F.col("spans")).alias("hit"), "items").collect())
    assert got == _hits(rows, items)


def test_contamination_is_cut(spark):
    item = words(25, 9)
    rows = [(1, f"clean  start {item} {'clean ' * 20}\nend"), (2, "clean  only\n"), (3, item), (4, None), (5, "")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in decontaminate.remove_contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 4, 5} and got[2].text == "clean  only\n" and got[4].text is None
    assert got[1].text.split() == ["clean", "start", *["clean"] * 20, "end"] and got[1].n_chars == len(got[1].text)
    assert decontaminate.remove_contamination(docs, docs.limit(0).select(F.col("doc_id").alias("item_id"), "text")).columns == docs.columns


def _kept(rows, size):
    first = {}
    split = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text in rows]
    order = lambda d: float("inf") if d is None else d
    for doc, have in split:
        for k in range(len(have) - size + 1):
            w = tuple(have[k : k + size])
            first[w] = min(first.get(w, float("inf")), order(doc))
    out = Counter()
    for doc, have in split:
        keep = [True] * len(have)
        for k in range(len(have) - size + 1):
            if first[tuple(have[k : k + size])] < order(doc):
                keep[k : k + size] = [False] * size
        out[doc, len(have), keep.count(False), " ".join(w for w, k in zip(have, keep, strict=True) if k)] += 1
    return out


@pytest.mark.parametrize("block_bytes", [4 << 20, 2000])
def test_repeats_by_brute_force(spark, block_bytes):
    rows = texts()
    found = substrings.find_repeats(frame(spark, rows), block_bytes=block_bytes)
    got = found.select("row.doc_id", "n_words", "n_removed", "kept", "factors").collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == _kept(rows, 13)
    # every factor is a copy of what it points to
    have = {d: (t or "").split() for d, t in rows}
    for r in got:
        for f in r.factors:
            assert have[r.doc_id][f.start : f.start + f.words] == have[f.doc][f.pos : f.pos + f.words] and f.words >= 13


def test_repeats_keep_layout(spark):
    got = {r.doc_id: r.text for r in substrings.remove_repeats(frame(spark, texts()[:10])).collect()}
    rows = dict(texts()[:10])
    assert got[1] == rows[1] and got[4] == rows[4] and got[6] is None and got[8] == " \n\t "
    assert got[2] == "" and got[5].split() == rows[5].split()[:20]
    assert substrings.find_repeats(frame(spark, [])).count() == 0


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(default_tokenizer())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(ids):
    odd = ["a b", " a", "a ", "\na", "a\n", "a\n\nb", "a \nb", "a\n b", "a   b", "it's we'll", "x, y. z!", "é à ñ", "日本 語", "1 2a b3", "a\tb", "\r\n", "<|endoftext|> a", "a b", " x", "don't\nstop, now", "''s", "a\x00b"]
    for words_held in (200_000, 2):
        encode = Encoder(default_tokenizer(), words_held).encode
        for text in [*odd, *(t for _, t in texts() if t), *odd]:
            assert np.frombuffer(encode(text), "<u4").tolist() == ids(text), text[:40]
    assert encode(None) == encode("") == b""


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    random = np.random.default_rng(1)
    for top in (1, 2, 256, 50_257, 1 << 20, 1 << 32):
        for n in (0, 1, 7, 1000):
            block = random.integers(0, top, n, dtype=np.uint64).astype("<u4").tobytes()
            assert token_files.unshuffle_planes(token_files.shuffle_planes(block, bits), n) == block
    with pytest.raises(ValueError):
        token_files.unshuffle_planes(b"nothing", 1)


@pytest.mark.parametrize("block_ids", [64, 1 << 16])
def test_files_read_back(spark, tmp_path, ids, block_ids):
    rows = [r for r in texts() if r[0] is not None]
    path = f"{tmp_path}/files"
    token_files.write_token_files(frame(spark, rows), path, default_tokenizer(), block_ids=block_ids, bits=block_ids == 64, shard_bytes=4000 if block_ids == 64 else 1 << 30)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    want, at = [], 0
    for doc, text in sorted(rows, key=lambda r: r[0]):
        have = [*ids(text), 0]
        want.append((doc, at, len(have), zlib.crc32(np.array(have, "<u4").tobytes())))
        at += len(have)
    assert [tuple(r) for r in got] == want
    token_files.write_token_files(frame(spark, []), f"{tmp_path}/none", default_tokenizer())
    assert token_files.read_token_files(spark, f"{tmp_path}/none").count() == 0


def test_equal_rows_fill_several_shards(spark, tmp_path, ids):
    docs = spark.createDataFrame([(7, "the same text again")] * 300 + [(None, "x")] * 3, "doc_id long, text string").repartition(3)
    token_files.write_token_files(docs, str(tmp_path / "files"), default_tokenizer(), shard_bytes=600)
    assert spark.read.parquet(str(tmp_path / "files")).select("shard").distinct().count() > 3
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_token_files(spark, str(tmp_path / "files")).collect())
    one, other = len(ids("x")) + 1, len(ids("the same text again")) + 1
    assert got == [*((k * one, None, one) for k in range(3)), *((3 * one + k * other, 7, other) for k in range(300))]


@pytest.mark.parametrize("partition_items", [5, 100_000])
def test_packing(spark, ids, partition_items):
    rows = texts()
    got = packing.pack_documents(frame(spark, rows), default_tokenizer(), partition_items=partition_items).collect()
    want = Counter()
    for doc, text in rows:
        have = [*ids(text), 2]
        cut = len(have) % 1024 or 1024
        edges = [0, *range(cut, len(have) + 1, 1024)]
        want.update((doc, k, a, b - a, zlib.crc32(np.array(have[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 1024
    bound = packing.lower_bound(np.array([r.length for r in got]), 1024)
    assert bound <= len(bins) <= bound + (1 if partition_items > 5 else 4)
    assert packing.pack_documents(frame(spark, []), default_tokenizer()).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_exchanges_close_gaps(spark, seed):
    """With the parameters of the query: partitions with a gap alone, none when their documents have met."""
    random = np.random.default_rng(seed)
    sizes = np.concatenate([random.integers(180, 400, 700), random.integers(500, 860, 150), [1024] * 5])
    items = spark.createDataFrame([(k, int(n)) for k, n in enumerate(sizes)], "doc_id long, length long")
    packed = packing.pack(items, 1024)
    rows, told = packed.collect(), packing.certificate(packed, 1024).first()
    assert sorted((r.doc_id, r.length) for r in rows) == [(k, n) for k, n in enumerate(sizes.tolist())]
    assert told.bound == packing.lower_bound(sizes, 1024) and told.sequences == len({r.sequence_id for r in rows}) == told.bound + told.gap
    first = {(r.partition_bins, r.partition_bound) for r in rows if r.round == 0}
    assert any(bins > bound for bins, bound in first) and len({r.round for r in rows}) > 1
    # fewer than the partitions of the first round needed each by itself
    assert told.gap < sum(bins - bound for bins, bound in first) + len(first)
    _, _, fill = packing.best_fit_decreasing(sizes, 1024)
    assert told.sequences <= len(fill) + 1
    assert packing.certificate(packed.limit(0), 1024).first().sequences == 0


def test_bounds_never_pass_the_optimum():
    random = np.random.default_rng(5)
    for _ in range(200):
        sizes = random.integers(1, 21, random.integers(0, 40))
        _, _, fill = packing.best_fit_decreasing(sizes, 20)
        assert -(-int(sizes.sum()) // 20) <= packing.lower_bound(sizes, 20) <= len(fill) and all(f <= 20 for f in fill)
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    # items of over a third: at most two to a bin
    assert packing.lower_bound(np.array([4] * 9), 10) == 5




@pytest.mark.parametrize("vocabulary", [2, 5, 300])
def test_factors_cover_every_repeat(vocabulary):
    random.seed(vocabulary)
    texts = [(doc, [b"w%d" % random.randrange(vocabulary) for _ in range(random.choice([3, 40, 200]))]) for doc in range(12)]
    texts += [(20, texts[3][1] + texts[7][1]), (21, texts[5][1]), (5, texts[2][1])]
    index = substrings.ReferenceIndex([d for d, _ in texts], [b" ".join(w) for _, w in texts])
    letters = np.frombuffer(index.letters, ">u4").tolist()
    assert index.order == sorted(range(len(letters)), key=lambda k: letters[k:])
    for below, words in [(21, texts[5][1][10:] + [b"new"] + texts[8][1]), *texts]:
        held = {tuple(w[k : k + 6]) for d, w in texts if d < below for k in range(len(w) - 5)}
        want = {k + j for k in range(len(words) - 5) if tuple(words[k : k + 6]) in held for j in range(6)}
        found = index.factors(b" ".join(words), below, 6)
        assert {k for a, n, _, _ in found for k in range(a, a + n)} == want
        assert all(any(d == doc and w[pos : pos + n] == words[a : a + n] for d, w in texts) and doc < below for a, n, doc, pos in found)
