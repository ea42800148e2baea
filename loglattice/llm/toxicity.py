"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased, everything but letters and digits becomes a space, and byte n-grams of several
lengths, hashed into `2^bits` features, count once for a document (a letter outside ASCII is two to four bytes, so some
n-grams begin or end within one). Over the training rows, feature f has the
log ratio r_f of its smoothed share of the counts under label 1 and under label 0; features that few rows have
get none. A logistic regression with an L2 penalty is fitted on the vectors of r_f, each divided by a power
of its number of features so that long texts don't drown in chance. Margins of rows that took part in no fit (three folds)
set the scale and the bias of the final scores, since those of training rows are too sure.

Training: labelled rows, at most `max_rows` of them (the smallest hashes of doc_id) and whole texts of at most
`max_bytes` together (those that would pass it are left out), read by tasks and fitted in one task of that bounded
size; the weights, `2^bits` floats, are broadcast. Scoring reads whole texts, however long.

Defined results: null and empty texts have no features and get the score of the bias alone; rows without a
label (or null) don't train; of several labels of a doc_id the largest counts; without training rows, or with one
label only, all scores are the share of label 1 (0.5 without rows); repeated rows are scored one by one, and of
the rows of one doc_id that with the least features trains; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, utf8
from .decontaminate import _NORMAL

LENGTHS = (4, 6, 8)
BITS = 20
#: A text's sum of weights is divided by its number of features to this power.
POWER = 0.3
_ODD = np.uint32(0x9E3779B1)


class Features:
    """The different n-grams of a text as feature numbers."""

    def __init__(self, lengths: tuple[int, ...] = LENGTHS, bits: int = BITS):
        self.lengths, self.shift = lengths, np.uint32(32 - bits)
        self.stamp = np.zeros(1 << bits, np.int64)
        self.turn = 0

    def of(self, text: bytes) -> np.ndarray:
        letters = np.frombuffer(b" " + text.translate(_NORMAL) + b" ", np.uint8).astype(np.uint32)
        found = []
        rolling = letters
        for n in range(2, max(self.lengths) + 1):
            if len(letters) < n:
                break
            rolling = rolling[:-1] * _ODD + letters[n - 1 :] + np.uint32(n)
            if n in self.lengths:
                mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                found.append((mixed >> self.shift).astype(np.intp))
        if not found:
            return np.empty(0, np.intp)
        every = np.concatenate(found)
        # of equal numbers the last to write its mark stays
        marks = np.arange(self.turn + 1, self.turn + 1 + len(every))
        self.turn += len(every)
        self.stamp[every] = marks
        return every[self.stamp[every] == marks]


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, bits: int, least: int = 4, alpha: float = 1.0, weakest: float = 1.0) -> np.ndarray:
    """The naive Bayes log-count ratio of each feature; 0 for those of fewer than `least` rows."""
    counts = np.zeros((2, 1 << bits))
    for row, label in zip(rows, labels.tolist(), strict=True):
        counts[label][row] += 1
    share = [(c + alpha) / (c.sum() + alpha * len(c)) for c in counts]
    ratios = np.log(share[1] / share[0])
    ratios[(counts.sum(axis=0) < least) | (np.abs(ratios) < weakest)] = 0
    return ratios


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, power: float = POWER, penalty: float = 1e-4, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights (with the ratios folded in) and bias."""
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(1 << bits, np.float32), math.log(share / (1 - share))
    ratios = log_ratios(rows, labels, bits)
    used = np.flatnonzero(ratios)
    place = np.full(1 << bits, -1, np.int32)
    place[used] = np.arange(len(used))
    index = [p[p >= 0] for p in (place[r] for r in rows)]
    counts = np.array([len(i) for i in index])
    flat = np.concatenate(index)
    del index
    ends = np.cumsum(counts)
    value = ratios[used].astype(np.float32)
    scale = np.array([max(1, len(r)) for r in rows], float) ** -power
    # the products of a few rows at a time
    parts = [(a, min(len(rows), a + 256)) for a in range(0, len(rows), 256)]

    def by_feature(of_row: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each feature the sum of of_row over the rows that have it, times its value."""
        out = np.zeros(len(used))
        for a, b in parts:
            out += np.bincount(flat[ends[a] - counts[a] : ends[b - 1]], np.repeat(of_row[a:b], counts[a:b]), len(used))
        return out * values

    def by_row(values: np.ndarray) -> np.ndarray:
        """For each row the sum of its features' values."""
        out = np.zeros(len(rows))
        for a, b in parts:
            low, high = ends[a] - counts[a], ends[b - 1]
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), counts[a:b]), values[flat[low:high]], b - a)
        return out

    weight, bias = np.zeros(len(used)), math.log(labels.mean() / (1 - labels.mean()))
    # gradient steps, each coordinate by its own curvature and with momentum
    curve = by_feature(scale * scale, value.astype(float) ** 2) / (4 * len(rows)) + penalty
    step = 1.0 / (curve * (1 + counts.max(initial=1) ** 0.5))
    ahead, ahead_bias = weight.copy(), bias
    for turn in range(steps):
        margin = scale * by_row(value * ahead) + ahead_bias
        error = (1 / (1 + np.exp(-margin)) - labels) / len(rows)
        fresh = ahead - step * (by_feature(scale * error, value) + penalty * ahead)
        fresh_bias = ahead_bias - 2 * error.sum()
        speed = turn / (turn + 3)
        ahead, ahead_bias = fresh + speed * (fresh - weight), fresh_bias + speed * (fresh_bias - bias)
        weight, bias = fresh, fresh_bias
    out = np.zeros(1 << bits, np.float32)
    out[used] = weight * ratios[used]
    return out, float(bias)


def margins(rows: list[np.ndarray], weights: np.ndarray, bias: float, power: float = POWER) -> np.ndarray:
    return np.array([float(weights[r].sum()) * max(1, len(r)) ** -power + bias for r in rows])


def fit_calibrated(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, folds: int = 3) -> tuple[np.ndarray, float]:
    """fit() on all rows, its margins scaled and shifted as those of left-out rows ask for."""
    weights, bias = fit(rows, labels, bits)
    out = np.zeros(len(rows))
    fold = np.arange(len(rows)) % folds
    for k in range(folds):
        if len(set(labels[fold != k].tolist())) < 2:
            return weights, bias
        train = [r for r, f in zip(rows, fold.tolist(), strict=True) if f != k]
        out[fold == k] = margins([r for r, f in zip(rows, fold.tolist(), strict=True) if f == k], *fit(train, labels[fold != k], bits))
    scale, shift = _platt(out, labels)
    return (weights * scale).astype(np.float32), bias * scale + shift


def _platt(margin: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The logistic regression of the labels on one margin, by Newton steps, slightly drawn to (1, 0)."""
    at = np.array([1.0, 0.0])
    design = np.stack([margin, np.ones(len(margin))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ design, -30, 30)))
        slope = design @ (p - labels) + 0.1 * (at - [1.0, 0.0])
        curve = (design * (p * (1 - p))) @ design.T + 0.1 * np.eye(2)
        move = np.linalg.solve(curve, slope)
        at = at - np.clip(move, -2, 2)
    return float(at[0]), float(at[1])


def _views(features: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows' feature numbers where Arrow holds them, without a copy."""
    found = []
    for chunk in features.chunks:
        _, offsets, data = chunk.buffers()
        edges = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        every = np.frombuffer(data or b"", np.int32)
        found += [every[a // 4 : b // 4] for a, b in zip(edges, edges[1:], strict=False)]
    return found


def _chosen(docs: DataFrame, known: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """doc_id and label of the rows that train."""
    first = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(first), "doc_id").groupBy("doc_id").agg(F.sum("size").alias("size"), F.max("label").alias("label"))
    room, kept = max_bytes, []
    for row in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if (row["size"] or 0) <= room:
            room -= row["size"] or 0
            kept.append((row.doc_id, row.label))
    return docs.sparkSession.createDataFrame(kept, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int")


def train(docs: DataFrame, labels: DataFrame, label: str, fold: Column, max_rows: int = 8000, max_bytes: int = 32 << 20, lengths: tuple[int, ...] = LENGTHS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias from the rows of `docs` (doc_id, text) for which `fold` holds and `labels` (doc_id,
    `label` 0 or 1) has a label."""
    known = labels.where(F.col(label).isin(0, 1) & fold).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = _chosen(docs, known, max_rows, max_bytes)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lengths, bits)
        for batch in batches:
            found = [features.of(t).astype(np.int32).tobytes() for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "features"])

    def fit_all(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("doc_id").to_numpy(), kind="stable")
        rows = _views(part.column("features"))
        rows, labels = [rows[k] for k in order.tolist()], part.column("label").to_numpy().astype(np.int64)[order]
        weights, bias = fit_calibrated(rows, labels, bits)
        return pa.table([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    limit_batches(docs.sparkSession)
    read = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    rows = read.mapInArrow(featurise, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, features binary")
    # repeated rows of a document train once
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("label", "features")).alias("row")).select("doc_id", "row.*")
    model = rows.groupBy(F.lit(0).alias("all")).applyInArrow(fit_all, "weights binary, bias double").first()
    return (np.frombuffer(model.weights, np.float32), model.bias) if model else (np.zeros(1 << bits, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], lengths: tuple[int, ...] = LENGTHS, bits: int = BITS) -> DataFrame:
    """doc_id and score (0 to 1) of each row of `docs`."""
    limit_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lengths, bits)
        weights, bias = shared.value
        for batch in batches:
            found = np.array([margins([features.of(t)], weights, bias)[0] for t in utf8(batch.column("text"))], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-found)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
