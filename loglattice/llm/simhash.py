"""SimHash near-dedup with bit-sliced comparison.

A fingerprint has one bit for each bit of the shingles' hashes: 1 if it is set in over half of them.
Documents with equal fingerprints fall together first (one row for each fingerprint from each task).

Which fingerprints are compared: the 64 bits are cut into blocks; within `radius` differing bits, some
`blocks - radius` blocks agree, so fingerprints that agree in such a choice of blocks meet in a bucket. More
blocks, and so longer keys, are taken as the number of fingerprints grows; every choice finds all links. A
bucket of more than `tile` fingerprints is cut into tiles, and every pair of tiles is a group of its own.

How: a group stores its fingerprints vertically, 64 planes with one bit for each fingerprint. A whole row of
distances is counted at a time by carry-save counters, bit by bit; a block of fingerprints all of whose
counters have passed the radius is abandoned. A group reports a forest of its links (each fingerprint with
the smallest one that it is joined to within the group), never all pairs.

Defined results: texts without words (null, empty, white space) have fingerprint zero and link like any
other; repeated rows give one row each; an empty table gives no rows; very long texts are a slice of their own;
other columns are carried along by `remove_near_duplicates` only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import limit_batches, materialise, text_slices, utf8
from .components import connected_components

SEED = 42


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of `words` lower-cased words joined by spaces, or of all if there are fewer."""
    found = text.lower().split()
    if not found:
        return np.empty(0, ">u8")
    joined = b" ".join(found)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    ends = [*gaps.tolist(), len(joined)]
    starts = [0, *(gaps + 1).tolist()]
    digest = xxhash.xxh64_digest
    last = min(words, len(found)) - 1
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[last:], strict=False)]), ">u8")


def fingerprint(hashes: np.ndarray) -> bytes:
    """The bits that over half of the hashes have, as 8 bytes."""
    if not len(hashes):
        return bytes(8)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(np.add.reduce(bits, axis=0, dtype=np.uint32) * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (long) for each row of `docs`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            prints = b"".join([fingerprint(shingle_hashes(t, words)) for t in utf8(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.frombuffer(prints, ">i8").astype(np.int64))], ["doc_id", "fp"])

    limit_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, fp long")


def close_pairs(prints: np.ndarray, others: np.ndarray, radius: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (into prints, into others) of those that differ in at most `radius` bits, block by block."""
    width = max(1, radius.bit_length())
    n = len(others)
    bits = np.unpackbits(others.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
    padded = np.zeros((64, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")
    own = -np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T.astype(np.uint64)
    beyond = [np.uint64(0xFFFFFFFFFFFFFFFF) if (radius >> k) & 1 else np.uint64(0) for k in range(width)]
    for row in range(0, len(prints), block):
        mine = own[:, row : row + block, None]
        lanes = np.arange(planes.shape[1])
        live = planes
        # vertical counters: bit k of all counts in counters[k]; those past 2^width - 1 stay in `over`
        counters = [np.zeros((mine.shape[1], len(lanes)), np.uint64) for _ in range(width)]
        over = np.zeros_like(counters[0])
        for j in range(0, 64, 3):
            # three planes at a time: a full adder makes one bit of weight 1 and one of weight 2
            a = live[j] ^ mine[j]
            if j + 2 < 64:
                b, c = live[j + 1] ^ mine[j + 1], live[j + 2] ^ mine[j + 2]
                half = a ^ b
                adds = [(0, half ^ c), (1, (a & b) | (half & c))]
            else:
                adds = [(0, a)]
            for k, carry in adds:
                for at in range(k, width):
                    counters[at], carry = counters[at] ^ carry, counters[at] & carry
                over |= carry
            if j % 12 == 9 and j < 60:
                done = _past(counters, over, beyond) == np.uint64(0xFFFFFFFFFFFFFFFF)
                if (gone := done.all(axis=0)).any():
                    stay = np.flatnonzero(~gone)
                    lanes, live = lanes[stay], live[:, stay]
                    counters, over = [x[:, stay] for x in counters], over[:, stay]
                if not len(lanes):
                    break
        if len(lanes):
            near = ~_past(counters, over, beyond)
            at, lane = np.nonzero(near)
            if len(at):
                hit = np.unpackbits(near[at, lane].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                which, bit = np.nonzero(hit)
                index = lanes[lane[which]] * 64 + bit
                real = index < n
                yield at[which][real] + row, index[real]


def _past(counters: list[np.ndarray], over: np.ndarray, radius_bits: list[np.uint64]) -> np.ndarray:
    """Lanes whose count is over the radius: compared from the highest bit down."""
    past, same = over.copy(), ~over
    for count, bit in zip(reversed(counters), reversed(radius_bits), strict=True):
        past |= same & count & ~bit
        same &= ~(count ^ bit)
    return past


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the smallest index that it is joined to."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            differ = ra != rb
            if not differ.any():
                break
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    return root


def _choices(count: int, radius: int) -> list[tuple[int, ...]]:
    """The choices of bit positions that make a key, for `count` fingerprints."""
    agree = 1
    while agree < 4 and count > 1000 * 2 ** (64 * agree // (radius + agree)):
        agree += 1
    blocks = radius + agree
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [tuple(bit for k in chosen for bit in range(edges[k], edges[k + 1])) for chosen in itertools.combinations(range(blocks), agree)]


def _masks(choices: list[tuple[int, ...]]) -> list[int]:
    return [int.from_bytes(sum(1 << bit for bit in choice).to_bytes(8, "big"), "big", signed=True) for choice in choices]


def link_fingerprints(prints: DataFrame, radius: int = 4, tile: int = 4096) -> DataFrame:
    """`prints` (fp, distinct) as edges (a, b) that join all fingerprints within `radius` bits."""
    masks = _masks(_choices(prints.count(), radius))
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("part", "key"))
    sizes = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1").select("part", "key", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    sized = keyed.join(sizes, ["part", "key"])
    # small buckets: many to a group; large ones: a group for each pair of tiles
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    paired = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    grouped = paired.select("fp", "part", "key", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("tiles") > 1).alias("large"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in _pools(_runs(batches, ["part", "key", "low", "high"])):
            roots = forest(len(values), close_pairs(values, values, radius))
            moved = roots != np.arange(len(values))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(values[roots[moved]]), pa.array(values[moved])], ["a", "b"])

    order = ["part", "key", "low", "high"]
    dealt = grouped.repartition(*order).sortWithinPartitions(*order)
    return dealt.select("fp", *order).mapInArrow(compare, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[bytes]:
    """The values of fp of each run of equal keys in sorted batches."""
    held: list[bytes] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        values = batch.column("fp").to_numpy(zero_copy_only=False)
        change = np.zeros(len(values), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = first != last
        edges = [*np.flatnonzero(change).tolist(), len(values)]
        if edges[0]:
            held.append(values[: edges[0]].tobytes())
        for a, b in itertools.pairwise(edges):
            if held:
                yield b"".join(held)
            held = [values[a:b].tobytes()]
        last = tuple(c[-1] for c in columns)
    if held:
        yield b"".join(held)


def _pools(groups: Iterator[bytes], least: int = 256) -> Iterator[np.ndarray]:
    """Small groups side by side: a call compares 256 fingerprints or more. Links that are found across
    groups are links all the same."""
    held, size = [], 0
    for group in groups:
        held.append(group)
        size += len(group) // 8
        if size >= least:
            yield np.unique(np.frombuffer(b"".join(held), np.int64))
            held, size = [], 0
    if held:
        yield np.unique(np.frombuffer(b"".join(held), np.int64))


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) for each row of `docs`."""
    found = materialise(fingerprints(docs, words))
    nodes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    joined = connected_components(link_fingerprints(nodes.select("fp"), radius))
    labelled = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "first_doc", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    by_print = labelled.join(smallest, "component").select("fp", "component_id")
    return found.join(by_print, "fp").select("doc_id", "fp", "component_id")


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Near-duplicates by similarity: fingerprints find most pairs soon, shingles decide all.

_MINIMA = 8
_SEEDS = np.array([[xxhash.xxh64_intdigest(k.to_bytes(8, "big"), SEED)] for k in range(_MINIMA)], np.uint64)


def _minima(hashes: np.ndarray) -> list[int]:
    """For each of several independent orders of all hashes (a full 64-bit finaliser behind a seed) the least one (as a
    signed number)."""
    least = np.full(_MINIMA, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 8192):
        x = hashes[at : at + 8192] ^ _SEEDS
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(31)
        least = np.minimum(least, x.min(axis=1))
    return least.astype(np.int64).tolist()


def _parities(hashes: np.ndarray) -> bytes:
    """A bit for each value of the hashes' last bits: whether an odd number of them has it. Two sets differ in at least as
    many elements as these differ in bits. 512 bits, doubled until there are as many bits as hashes."""
    size = 1 << max(9, (len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _total(hashes: np.ndarray) -> bytes:
    """128 bits that tell a sorted set of hashes from all others."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _node(hashes: np.ndarray) -> int:
    """The first half of these, as a signed number: sets of one doc_id and size are told apart by it."""
    return int.from_bytes(_total(hashes)[:8], "big", signed=True)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """Of each row, from its different shingles: fingerprint, parities, number and digest (equal for equal sets) and minima."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            prints, parities, totals, sizes, minima = [], [], [], [], []
            for text in utf8(batch.column("text")):
                different = np.unique(shingle_hashes(text, words).astype(np.uint64))
                prints.append(fingerprint(different.astype(">u8")))
                parities.append(_parities(different))
                sizes.append(len(different))
                totals.append(_total(different))
                minima.append(_minima(different))
            fp = pa.array(np.frombuffer(b"".join(prints), ">i8").astype(np.int64))
            columns = [fp, pa.array(parities, pa.binary()), pa.array(totals, pa.binary()), pa.array(sizes, pa.int32()), pa.array(minima, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "fp", "parities", "total", "n", "minima"])

    limit_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, fp long, parities binary, total binary, n int, minima array<long>")


_GROUP = ["part", "key", "low", "high"]


def _slices(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = tuple(c[0] for c in columns) != last
        edges = [*np.flatnonzero(change).tolist(), batch.num_rows]
        if edges[0]:
            held.append(batch.slice(0, edges[0]))
        for a, b in itertools.pairwise(edges):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _in_groups(keyed: DataFrame, columns: list[str], weight: Column, tile: int) -> DataFrame:
    """Rows (part, key, doc_id, columns) dealt into groups that fit a task, sorted by group: buckets of two rows or more,
    those whose weights add up to more than `tile` as all pairs of tiles."""
    total = keyed.groupBy("part", "key").agg(F.count("*").alias("rows"), F.sum(weight).alias("weight")).where("rows > 1")
    sizes = total.select("part", "key", F.ceil(F.col("weight") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    paired = keyed.join(sizes, ["part", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    grouped = paired.select("part", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "doc_id", *columns)
    return grouped.repartition(*_GROUP).sortWithinPartitions(*_GROUP)


def _possible(parities: list[bytes], n: np.ndarray, similarity: float, mine: np.ndarray | None = None, block: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (into mine, or else all; into all) of the pairs whose numbers of shingles and parities allow the similarity.
    It is a bound: no pair that has the similarity is left out."""
    sizes = np.array([len(p) for p in parities], np.int64)
    wanted = np.ones(len(n), bool)
    if mine is not None:
        wanted[:] = False
        wanted[mine] = True
    share = (1 - similarity) / (1 + similarity)
    for size in np.unique(sizes).tolist():
        reach = [size]
        while (8 * reach[-1] + 1) * similarity <= 8 * size:  # longer parities whose sets may still be near enough in number
            reach.append(2 * reach[-1])
        at = np.flatnonzero(np.isin(sizes, reach))
        rows = np.empty((len(at), size // 8), np.uint64)
        for length in reach:
            own = np.flatnonzero(sizes[at] == length)
            if len(own):
                bits = np.frombuffer(b"".join([parities[k] for k in at[own].tolist()]), np.uint64).reshape(len(own), -1, size // 8)
                rows[own] = np.bitwise_xor.reduce(bits, axis=1)
        planes, count = np.ascontiguousarray(rows.T), n[at]
        # pairs of which one has this length, and of which one is wanted
        for first, second in ((sizes[at] == size, np.ones(len(at), bool)), (sizes[at] > size, sizes[at] == size)):
            left, right = np.flatnonzero(first & wanted[at]), np.flatnonzero(second)
            if not len(left) or not len(right):
                continue
            others = planes[:, right]
            for row in range(0, len(left), block):
                part = left[row : row + block]
                apart = np.zeros((len(part), len(right)), np.uint32)
                for plane, other in zip(planes[:, part], others, strict=True):
                    apart += np.bitwise_count(plane[:, None] ^ other)
                both = count[part][:, None] + count[right]
                near = (apart <= share * both + 1e-6) & (np.minimum(count[part][:, None], count[right]) >= similarity * np.maximum(count[part][:, None], count[right]))
                one, two = np.nonzero(near)
                if len(one):
                    yield at[part[one]], at[right[two]]


def _alive(similarity: float):
    """Of each group the rows with a partner that may have the similarity."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[pa.Table] = []
        held = 0

        def compared() -> pa.RecordBatch:
            table = pa.concat_tables(pool).combine_chunks()
            group = np.repeat(np.arange(len(pool)), [p.num_rows for p in pool])
            n = table.column("n").to_numpy().astype(np.int64)
            close = np.zeros(len(n), bool)
            for a, b in _possible(table.column("parities").to_pylist(), n, similarity):
                real = (a != b) & (group[a] == group[b])
                close[a[real]] = True
            return table.select(["part", "key", "doc_id"]).filter(pa.array(close)).combine_chunks().to_batches()

        for table in _slices(batches, _GROUP):
            pool.append(table)
            held += table.num_rows
            if held >= 256:
                yield from compared()
                pool, held = [], 0
        if pool:
            yield from compared()

    return scan


def _verified(radius: int, similarity: float):
    """Of each group a forest of the pairs that have the similarity by their sets of shingles. Pairs within the radius come
    first; then all others that may have it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches, _GROUP):
            docs, prints = table.column("doc_id").to_numpy(), table.column("fp").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
            held = _Sets(sets)
            roots = _forest_of_similar(held, close_pairs(prints, prints, radius), similarity, np.arange(len(docs)))
            kinds, sizes = np.unique(roots, return_counts=True)
            if len(kinds) > 1:
                # of two rows that are not joined, one at least is outside the largest tree
                rest = np.flatnonzero(roots != kinds[sizes.argmax()])
                roots = _forest_of_similar(held, _possible(table.column("parities").to_pylist(), held.sizes, similarity, rest), similarity, roots)
            moved = np.flatnonzero(roots != np.arange(len(docs)))
            if len(moved):
                a, b = docs[roots[moved]], docs[moved]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return scan


class _Sets:
    """The sets of a group as bits, one column for each element that two sets have (others are in no intersection);
    as they are where that would take more than `most` bytes."""

    def __init__(self, sets: list[np.ndarray], most: int = 64 << 20):
        self.sets, self.sizes = sets, np.array([len(x) for x in sets], np.int64)
        self.bits = None
        if self.sizes.sum() > most // 16:
            return
        _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[number]
        width = int(np.count_nonzero(count > 1))
        if len(sets) * width > 8 * most:
            return
        owner = np.repeat(np.arange(len(sets)), self.sizes)[place >= 0]
        place = place[place >= 0]
        bits = np.zeros((len(sets), max(1, -(-width // 64)) * 8), np.uint8)
        np.bitwise_or.at(bits, (owner, place >> 3), np.left_shift(1, place & 7).astype(np.uint8))
        self.bits = bits.view(np.uint64)

    def similar(self, a: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the others have at least this Jaccard similarity with set a."""
        if self.bits is None:
            both = np.array([len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True)) for b in others.tolist()], np.int64)
        else:
            both = np.concatenate([np.bitwise_count(self.bits[others[k : k + 2048]] & self.bits[a]).sum(axis=1, dtype=np.int64) for k in range(0, len(others), 2048)])
        return both >= similarity * (self.sizes[a] + self.sizes[others] - both)


def _forest_of_similar(held: _Sets, pairs: Iterator[tuple[np.ndarray, np.ndarray]], similarity: float, root: np.ndarray) -> np.ndarray:
    """`root`, for each set the smallest one that it is joined to, carried on by pairs of that similarity. Pairs whose
    ends are joined already are not looked at."""
    for one, two in pairs:
        order = np.argsort(one, kind="stable")
        one, two = one[order], two[order]
        edges = [*np.flatnonzero(np.diff(one, prepend=-1)).tolist(), len(one)]
        for at, to in itertools.pairwise(edges):
            a, others = int(one[at]), two[at:to]
            others = others[root[others] != root[a]]
            if len(others) and len(others := others[held.similar(a, others, similarity)]):
                joined = np.unique(np.append(root[others], root[a]))
                root[np.isin(root, joined)] = joined[0]
    return root


def _prefix_keys(docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, part and key (a shingle), so that every pair of `nodes` at the similarity has a row of the same key each.

    Prefix filtering: in one order of all shingles, the first n - ceil(similarity * n) + 1 of two such sets have one in
    common. Shingles that few nodes hold come first. Those of one node alone meet nobody, but take up places: a node
    with enough of them has no partner and no row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [np.unique(shingle_hashes(t, words).astype(np.uint64)) for t in utf8(batch.column("text"))]
            own = [len(x) == n and _total(x) == total for x, n, total in zip(found, batch.column("n").to_pylist(), batch.column("total").to_pylist(), strict=True)]
            for doc, x, mine in zip(batch.column("doc_id").to_pylist(), found, own, strict=True):
                for at in range(0, len(x) if mine else 0, 100_000):
                    part = x[at : at + 100_000].view(np.int64)
                    columns = [np.full(len(part), doc), np.full(len(part), _node(x)), np.full(len(part), len(x), np.int32), part]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "node", "n", "key"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(nodes.where("n > 0").select("doc_id", "total", "n"), "doc_id")
    shingles = materialise(texts.mapInArrow(scan, "doc_id long, node long, n int, key long"))
    # repeated rows repeat their shingles, and one doc_id may have several sets: each id counts once
    held = shingles.groupBy("key").agg(F.count_distinct("doc_id").alias("holders")).where("holders > 1")
    shared = shingles.distinct().join(held, "key")
    of_doc = Window.partitionBy("doc_id", "node", "n")
    ranked = shared.withColumn("place", F.row_number().over(of_doc.orderBy("holders", "key")) + F.col("n") - F.count("*").over(of_doc))
    return ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1).select("doc_id", F.lit(_MINIMA).alias("part"), "key").distinct()


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 18, tile: int = 16_384, tile_bytes: int = 32 << 20, exact: bool = False) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable) of each row of `docs` with a doc_id, where documents are
    linked whose sets of shingles of `words` words have at least this Jaccard similarity.

    Documents with equal sets fall together, also all those without words; rows of one doc_id with different texts are one
    node with the links of each. The others meet where one of eight minima over their shingles
    agrees (all eight miss a pair at 0.8 once in 390,000 times); the sets themselves decide all
    pairs there whose ends are not joined already: first those whose fingerprints, compared bit-sliced, are within
    `radius` bits, then all that sizes and parities allow (a bound that no pair at the similarity fails). Sets are
    built only for documents that have such a partner. Large buckets are cut by rows, then by bytes.

    With `exact` no pair is missed: documents also meet by prefixes of their sets, in those buckets that hold more than
    one of the groups found so far. Every shingle is then shuffled twice, some three to four times the bytes of the texts."""
    found = materialise(_sketches(docs, words).where("doc_id is not null"))
    nodes = materialise(found.groupBy("total", "n").agg(F.min("doc_id").alias("doc_id"), F.min_by("fp", "doc_id").alias("fp"), F.min_by("parities", "doc_id").alias("parities"), F.min_by("minima", "doc_id").alias("minima")))
    edges = _similar_pairs(docs, nodes, nodes.where("n > 0").select("doc_id", "parities", "n", F.posexplode("minima").alias("part", "key")), words, similarity, radius, tile, tile_bytes)
    joined = connected_components(edges)
    if exact:
        groups = nodes.select("doc_id").distinct().join(joined, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
        keys = materialise(_prefix_keys(docs, nodes, words, similarity).join(groups, "doc_id"))
        mixed = keys.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
        keyed = keys.join(mixed, "key").join(nodes.where("n > 0").select("doc_id", "parities", "n"), "doc_id").select("doc_id", "parities", "n", "part", "key")
        more = _similar_pairs(docs, nodes, keyed, words, similarity, radius, tile, tile_bytes)
        joined = connected_components(joined.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))
    grouped = nodes.join(joined, nodes.doc_id == joined.node, "left").select("total", "n", F.coalesce("component", "doc_id").alias("component_id"))
    return found.select("doc_id", "total", "n").join(grouped, ["total", "n"]).select("doc_id", "component_id")


def _similar_pairs(docs: DataFrame, nodes: DataFrame, keyed: DataFrame, words: int, similarity: float, radius: int, tile: int, tile_bytes: int) -> DataFrame:
    """Edges (a, b) that join all pairs of nodes at the similarity that meet in a bucket (part, key) of `keyed`."""
    near = _in_groups(keyed, ["parities", "n"], F.expr("octet_length(parities) div 64"), tile).mapInArrow(_alive(similarity), "part int, key long, doc_id long")
    near = materialise(near.distinct())
    chosen = near.select("doc_id").distinct()

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [np.unique(shingle_hashes(t, words).astype(np.uint64)) for t in utf8(batch.column("text"))]
            # of the rows of a doc_id those whose set it is
            own = [len(x) == n and _total(x) == total for x, n, total in zip(found, batch.column("n").to_pylist(), batch.column("total").to_pylist(), strict=True)]
            sets = pa.array([x.tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sets], [*kept, "shingles"]).filter(pa.array(own, pa.bool_()))

    kept = ["doc_id", "fp", "parities", "total", "n"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(nodes.select(*kept).join(chosen, "doc_id"), "doc_id").select(*kept, "text")
    sets = texts.mapInArrow(shingles, "doc_id long, fp long, parities binary, total binary, n int, shingles binary")
    sets = materialise(sets.dropDuplicates(["doc_id", "total", "n"]).drop("total", "n"))
    return _in_groups(near.join(sets, "doc_id"), ["fp", "parities", "shingles"], F.octet_length("shingles") + F.octet_length("parities"), tile_bytes).mapInArrow(_verified(radius, similarity), "a long, b long")


def remove_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, exact: bool = False) -> DataFrame:
    """`docs` with one document of each group of near-duplicates: that with the smallest doc_id. Texts
    without words (null, empty, white space) are one group. Rows without a doc_id stay; rows that repeat a doc_id stay or
    go together."""
    gone = near_duplicate_groups(docs, words, similarity, exact=exact).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("gone"), "left_anti").select(*docs.columns)
