"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into column expressions.

Boosted small trees are grown over the statistics of labelled texts; every path from a root to a node is a
conjunction of comparisons, a rule; a logistic regression with an L1 penalty over all rules keeps a few. The
model is the list of kept rules with their weights, and scoring is one Spark expression over the columns of
statistics: a sum of weights of those rules that hold, through the logistic function.

Training: labelled rows, at most `max_rows` of them (the smallest hashes of doc_id), of which only the
statistics reach the driver. Statistics are of whole texts.

Defined results: null and empty texts have statistics of zero and are scored like others; very long texts are no
special case; an empty table gives no rows; rows without a label (or null) don't train; of several labels of a
doc_id the largest counts, and of its rows that with the least statistics; without training rows, or with one label only, all scores are the share of
label 1 (0.5 without rows); repeated rows are scored one by one; other columns are carried along unread.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import limit_batches

STATISTICS = (
    "log_words",
    "mean_word_bytes",
    "unique_word_share",
    "repeated_word_share",
    "upper_share",
    "digit_share",
    "sentence_mark_share",
    "exclamation_share",
    "bar_share",
    "symbol_share",
    "other_byte_share",
    "words_per_line",
    "repeated_line_share",
)
_CLASSES = np.zeros((256, 7))
for _k, _bytes in enumerate((range(0x41, 0x5B), range(0x30, 0x3A), b".,;:?'\"()-", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~", range(0x80, 0x100))):
    _CLASSES[list(_bytes), _k] = 1


def statistics_of(text: bytes) -> tuple[float, ...]:
    """The statistics of one text, in the order of STATISTICS; shares of bytes are of those that aren't white space."""
    words = text.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x]
    n = len(words)
    return (
        math.log1p(n),
        solid / n,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        *(counts @ _CLASSES / solid).tolist(),
        n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
    )


@pandas_udf(StructType([StructField(name, DoubleType()) for name in STATISTICS]))
def text_statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics_of((t or "").encode()) for t in texts], columns=list(STATISTICS), dtype=float)


@dataclass(frozen=True)
class Condition:
    """A statistic above a threshold, or at most that."""

    statistic: int
    above: bool
    threshold: float

    def holds(self, table: np.ndarray) -> np.ndarray:
        return (table[:, self.statistic] > self.threshold) == self.above

    def column(self, stats: str) -> Column:
        value = F.col(f"{stats}.{STATISTICS[self.statistic]}")
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleModel:
    rules: list[tuple[Rule, float]]
    bias: float

    def score(self, stats: str) -> Column:
        """The model as a Spark expression over the struct column of statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = rule[0].column(stats)
            for condition in rule[1:]:
                holds = holds & condition.column(stats)
            total = total + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _grow(table: np.ndarray, bins: np.ndarray, edges: list[np.ndarray], target: np.ndarray, depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """A regression tree: its paths as rules, and its fitted values."""
    rules: list[Rule] = []
    fitted = np.zeros(len(target))
    todo: list[tuple[np.ndarray, Rule]] = [(np.arange(len(target)), ())]
    while todo:
        rows, path = todo.pop()
        fitted[rows] = target[rows].mean()
        if path:
            rules.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            continue
        best = (1e-9, -1, 0)
        total, n = target[rows].sum(), len(rows)
        for j, cuts in enumerate(edges):
            if not len(cuts):
                continue
            b = bins[rows, j]
            left_n = np.cumsum(np.bincount(b, minlength=len(cuts) + 1))[:-1]
            left = np.cumsum(np.bincount(b, target[rows], len(cuts) + 1))[:-1]
            fair = (left_n >= least) & (n - left_n >= least)
            gain = np.where(fair, left**2 / np.maximum(left_n, 1) + (total - left) ** 2 / np.maximum(n - left_n, 1) - total**2 / n, 0)
            if gain.max() > best[0]:
                best = (float(gain.max()), j, int(gain.argmax()))
        if best[1] < 0:
            continue
        _, j, k = best
        high = bins[rows, j] > k
        threshold = float(edges[j][k])
        todo += [(rows[high], (*path, Condition(j, True, threshold))), (rows[~high], (*path, Condition(j, False, threshold)))]
    return rules, fitted


def _simplified(rule: Rule) -> Rule:
    """Of several bounds on one side of a statistic the tightest."""
    tight: dict[tuple[int, bool], float] = {}
    for c in rule:
        key = (c.statistic, c.above)
        tight[key] = (max if c.above else min)(tight.get(key, c.threshold), c.threshold)
    return tuple(Condition(j, above, t) for (j, above), t in sorted(tight.items()))


def fit_rules(table: np.ndarray, labels: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1e-3, seed: int = 7) -> RuleModel:
    if not len(labels) or labels.min() == labels.max():
        share = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-6), 1 - 1e-6)
        return RuleModel([], math.log(share / (1 - share)))
    random = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 63))) for c in table.T]
    # between two values that occur, so that a text just like one of training falls on its side
    edges = [np.array([(e + c[c > e].min()) / 2 for e in es if (c > e).any()]) for es, c in zip(edges, table.T, strict=True)]
    bins = np.stack([np.searchsorted(e, c) for e, c in zip(edges, table.T, strict=True)], axis=1)
    margin = np.full(len(labels), math.log(labels.mean() / (1 - labels.mean())))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        residual = labels - 1 / (1 + np.exp(-margin))
        drawn = random.random(len(labels)) < 0.6
        open_edges = [e if keep else e[:0] for e, keep in zip(edges, random.random(len(edges)) < 0.7, strict=True)]
        if not drawn.any():
            continue
        grown, fitted = _grow(table[drawn], bins[drawn], open_edges, residual[drawn], depth, least=max(3, len(labels) // 500))
        rules.update(dict.fromkeys(map(_simplified, grown)))
        margin[drawn] += rate * 4 * fitted
    every = list(rules)
    if not every:
        return RuleModel([], float(margin[0]))
    holds = np.stack([np.all([c.holds(table) for c in rule], axis=0) for rule in every], axis=1).astype(np.float32)
    weights, bias = _lasso(holds, labels, penalty)
    return RuleModel([(rule, float(w)) for rule, w in zip(every, weights, strict=True) if w], bias)


def _lasso(design: np.ndarray, labels: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty on all but the bias, by accelerated proximal gradient steps."""
    n = len(labels)
    power = np.ones(design.shape[1], np.float32)
    for _ in range(20):
        power = design.T @ (design @ power)
        power /= np.linalg.norm(power)
    step = 4 * n / (float(np.linalg.norm(design.T @ (design @ power))) + n)
    weight, bias = np.zeros(design.shape[1]), math.log(labels.mean() / (1 - labels.mean()))
    ahead, ahead_bias = weight, bias
    for turn in range(steps):
        error = (1 / (1 + np.exp(-(design @ ahead.astype(np.float32) + ahead_bias))) - labels) / n
        fresh = ahead - step * (design.T @ error.astype(np.float32))
        fresh = np.sign(fresh) * np.maximum(np.abs(fresh) - step * penalty, 0)
        fresh_bias = ahead_bias - step * error.sum()
        speed = turn / (turn + 3)
        ahead, ahead_bias = fresh + speed * (fresh - weight), fresh_bias + speed * (fresh_bias - bias)
        weight, bias = fresh, fresh_bias
    return weight, float(bias)


def train(docs: DataFrame, labels: DataFrame, label: str, fold: Column, max_rows: int = 8000) -> RuleModel:
    """A model from the rows of `docs` (doc_id, text) for which `fold` holds and `labels` has a label of 0 or 1."""
    limit_batches(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & fold).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", text_statistics("text").alias("stats"))
    # repeated rows of a document train once, so max_rows bounds what the driver holds
    found = rows.groupBy("doc_id").agg(F.min(F.struct("label", "stats")).alias("row")).orderBy("doc_id").select("row.label", "row.stats.*").toPandas()
    return fit_rules(found[list(STATISTICS)].to_numpy(float), found["label"].to_numpy(float))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """`docs` with the columns of the input in the struct `row`, and score (0 to 1)."""
    limit_batches(docs.sparkSession)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return held.withColumn("stats", text_statistics("row.text")).select("row", model.score("stats").alias("score"))


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that score `threshold` or more, with their own columns."""
    return score(docs, model).where(F.col("score") >= threshold).select("row.*")
