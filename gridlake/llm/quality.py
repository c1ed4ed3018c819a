"""Quality rules learned by gradient-boosted trees over document statistics.

Trees are grown on histograms of the statistics of a bounded sample of labelled documents and
flattened into numpy node arrays; a batch of documents walks all trees at once.  For chosen
statistics the score may only fall (or rise) when the statistic grows: a split against its
direction is not made, and the values below a split are bounded by its middle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.statistics import COUNTS, LEAST_WORDS, REPEAT_PERCENT, SHARES, base_rules, document_statistics, measure
from gridlake.session import bounded_batches, give_back, stage

#: direction of the score in a statistic: more of these is never better, more of those never worse
MONOTONE = {"symbols_per_word": -1, "dup_lines": -1, "repeat_words": -1, "marked_words": -1, "letters": 1}
SAMPLE = 20_000


class BoostedTrees:
    """Binary classifier; ``score`` gives the probability of label 1."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 5.0, ridge: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, rows: np.ndarray, labels: np.ndarray, directions: list[int]) -> "BoostedTrees":
        rows, labels = np.asarray(rows, float), np.asarray(labels, float)
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 0.5
        self.start = float(np.log(share / (1 - share)))
        self.feature, self.limit, self.low, self.high, self.value, self.roots = [], [], [], [], [], []
        if len(labels) and 0 < labels.sum() < len(labels):
            cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(rows.shape[1])]
            binned = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
            raw = np.full(len(labels), self.start)
            for _ in range(self.trees):
                p = 1 / (1 + np.exp(-raw))
                first = len(self.feature)
                self.roots.append(first)
                self._grow(binned, cuts, directions, labels - p, p * (1 - p), np.arange(len(labels)), raw, self.depth,
                           -np.inf, np.inf)
        for name, kind in (("feature", int), ("limit", float), ("low", int), ("high", int), ("value", float), ("roots", int)):
            setattr(self, name, np.array(getattr(self, name), dtype=kind))
        return self

    def _best(self, binned, cuts, directions, grad, hess, rows, floor, roof):
        total_g, total_h = grad[rows].sum(), hess[rows].sum()
        worth = lambda g, h, v: 2 * g * v - (h + self.ridge) * v * v  # noqa: E731  gain of a leaf with value v
        here = worth(total_g, total_h, np.clip(total_g / (total_h + self.ridge), floor, roof))
        best = None
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            g = np.cumsum(np.bincount(binned[rows, f], grad[rows], len(cut) + 1))[:-1]
            h = np.cumsum(np.bincount(binned[rows, f], hess[rows], len(cut) + 1))[:-1]
            n = np.cumsum(np.bincount(binned[rows, f], minlength=len(cut) + 1))[:-1]
            left = np.clip(g / (h + self.ridge), floor, roof)
            right = np.clip((total_g - g) / (total_h - h + self.ridge), floor, roof)
            gain = worth(g, h, left) + worth(total_g - g, total_h - h, right) - here
            allowed = (n >= self.least) & (len(rows) - n >= self.least) & (directions[f] * (right - left) >= 0)
            gain = np.where(allowed, gain, -np.inf)
            at = int(gain.argmax())
            if gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                best = gain[at], f, at, left[at], right[at]
        return best

    def _grow(self, binned, cuts, directions, grad, hess, rows, raw, depth, floor, roof) -> int:
        node = len(self.feature)
        value = float(np.clip(grad[rows].sum() / (hess[rows].sum() + self.ridge), floor, roof)) * self.rate
        for part, v in zip((self.feature, self.limit, self.low, self.high, self.value), (-1, 0.0, node, node, value)):
            part.append(v)
        best = self._best(binned, cuts, directions, grad, hess, rows, floor, roof) if depth else None
        if best is None:
            raw[rows] += value
            return node
        _, f, at, left, right = best
        goes = binned[rows, f] <= at
        middle = (left + right) / 2
        sides = [(floor, roof), (floor, roof)]
        if directions[f]:
            sides = [(floor, middle), (middle, roof)] if directions[f] > 0 else [(middle, roof), (floor, middle)]
        self.feature[node], self.limit[node] = f, float(cuts[f][at])
        args = (binned, cuts, directions, grad, hess)
        self.low[node] = self._grow(*args, rows[goes], raw, depth - 1, *sides[0])
        self.high[node] = self._grow(*args, rows[~goes], raw, depth - 1, *sides[1])
        return node

    def score(self, rows: np.ndarray) -> np.ndarray:
        rows = np.asarray(rows, float)
        if not len(self.roots):
            return np.full(len(rows), 1 / (1 + np.exp(-self.start)))
        at = np.tile(self.roots, (len(rows), 1))
        index = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            lower = rows[index, np.maximum(f, 0)] <= self.limit[at]
            at = np.where(f < 0, at, np.where(lower, self.low[at], self.high[at]))
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def train(statistics: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BoostedTrees:
    """Fit on at most ``sample`` labelled documents, chosen by a hash of their id; of rows with
    one id the smallest counts.

    Null labels and labels of unknown documents do not count; without both labels the model
    gives one score to all.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    known = known.filter("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = statistics.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*SHARES)).alias("one"))
    rows = met.select("label", "one.*").toPandas().sort_values([*SHARES, "label"])
    directions = [MONOTONE.get(c, 0) for c in SHARES]
    return BoostedTrees().fit(rows[list(SHARES)].to_numpy(), rows["label"].to_numpy() > 0, directions)


def apply(statistics: DataFrame, model: BoostedTrees, threshold: float = 0.5) -> DataFrame:
    """Adds ``score``, ``base_failed`` and ``kept`` to statistics."""
    names = list(statistics.columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in statistics.schema.fields) + ", score double"

    def score(batches):
        for batch in batches:
            rows = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in SHARES], axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.score(rows), pa.float64())], names=[*names, "score"]
            )

    failed = base_rules()
    return statistics.mapInArrow(score, schema).withColumns({
        "base_failed": failed, "kept": ~failed & (F.col("score") >= threshold),
    })


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Statistics, score and verdict of every document.

    Null and empty texts have no words and fail the fixed rules; repeated rows stay.
    """
    bounded_batches(docs.sparkSession)
    statistics = stage(document_statistics(docs), "quality-statistics")
    return apply(statistics, train(statistics, labels, sample), threshold).select(
        "doc_id", *COUNTS, "base_failed", "kept", "score"
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The documents that pass, with their own columns.

    The verdict is taken row by row and not joined back, so rows with null or repeated ids keep
    their own.  Only the documents of the bounded sample are measured for training.
    """
    bounded_batches(docs.sparkSession)
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("known"))
    chosen = known.distinct().orderBy(F.xxhash64("known"), "known").limit(sample)
    learned = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["known"], "left_semi")
    return keep_scored(docs, train(document_statistics(learned), labels, sample), threshold)


def keep_scored(docs: DataFrame, model: BoostedTrees, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    def choose(batches):
        n = len(COUNTS)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [measure(t) for t in batch[text_column].to_pylist()]
            score = model.score(np.array([r[n:] for r in rows]))
            passed = [
                r[0] >= LEAST_WORDS and 100 * r[4] <= REPEAT_PERCENT * r[0] and s >= threshold for r, s in zip(rows, score.tolist())
            ]
            yield batch.filter(pa.array(passed, pa.bool_()))
        give_back()

    return docs.mapInArrow(choose, docs.schema)
