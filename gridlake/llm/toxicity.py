"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words and word beginnings of four to six letters, each hashed.  The
machine adds a weight per term and, for every pair of terms in a text, the product of their
factors, so words that offend only together count as well.  It is trained on a bounded sample of
labelled documents over the terms that tell the labels apart best; tasks look up only those.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.session import bounded_batches, give_back

DIMENSIONS = 1 << 26
TERMS = 4096
SAMPLE = {1: 4000, 0: 8000}
THRESHOLD = 0.3
CACHED_WORDS = 120_000
_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> tuple[int, ...]:
    """Hashed terms of one word in lower case."""
    raw = [b"w" + word.encode()]
    raw += [b"p" + word[:k].encode() for k in (4, 5, 6) if len(word) > k]
    return tuple(zlib.crc32(t) % DIMENSIONS for t in raw)


def terms(text: str | None) -> set[int]:
    found: set[int] = set()
    for word in set(_WORD.findall((text or "").lower())):
        found.update(word_terms(word))
    return found


class FactorizationMachine:
    """Weights and factors over chosen terms; features are 1 where a text has the term."""

    def __init__(self, factors: int = 4, rounds: int = 400, rate: float = 0.1,
                 ridge: tuple[float, float] = (2e-5, 1e-3), seed: int = 7):
        self.factors, self.rounds, self.rate, self.ridge, self.seed = factors, rounds, rate, ridge, seed
        self.place: dict[int, int] = {}
        self.bias, self.weight, self.factor = -3.0, np.zeros(0), np.zeros((0, factors))

    def choose(self, texts: list[np.ndarray], labels: np.ndarray, keep: int = TERMS) -> None:
        """The terms with the largest G-statistic against the label."""
        counts = []
        for side in (labels, ~labels):
            found = [t for t, mine in zip(texts, side) if mine]
            counts.append(np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, "<u4"), np.zeros(0)))
        names = np.union1d(counts[0][0], counts[1][0])
        ones, zeros = np.zeros(len(names)), np.zeros(len(names))
        for column, (found, n) in zip((ones, zeros), counts):
            column[np.searchsorted(names, found)] = n
        n1, n0 = max(labels.sum(), 1), max((~labels).sum(), 1)
        p, q = (ones + 0.5) / (n1 + 1), (zeros + 0.5) / (n0 + 1)
        both = (ones + zeros + 1) / (n1 + n0 + 2)
        gain = n1 * (p * np.log(p / both) + (1 - p) * np.log((1 - p) / (1 - both)))
        gain += n0 * (q * np.log(q / both) + (1 - q) * np.log((1 - q) / (1 - both)))
        seen = np.flatnonzero((ones + zeros >= 3) & (gain > 1.3 * np.log(len(texts))))
        best = seen[np.lexsort((seen, -gain[seen]))][:keep]
        self.place = {int(t): i for i, t in enumerate(np.sort(names[best]))}

    def features(self, found) -> list[int]:
        return [self.place[t] for t in found if t in self.place]

    def raw(self, rows: list[list[int]]) -> np.ndarray:
        """Weights plus pairwise products of factors, per row of feature numbers."""
        lengths = np.array([len(r) for r in rows])
        flat = np.array([i for r in rows for i in r], dtype=int)
        owner = np.repeat(np.arange(len(rows)), lengths)
        return self._sum(flat, owner, len(rows))

    def _sum(self, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(owner, self.weight[flat], n)
        for k in range(self.factors):
            v = self.factor[flat, k]
            out += 0.5 * (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n))
        return out

    def score(self, rows: list[list[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -40, 40)))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, prior: float | None = None) -> "FactorizationMachine":
        """Full-batch Adam on the logistic loss.

        ``prior`` is the share of label 1 outside the sample; the bias is moved to it.
        """
        labels = np.asarray(labels, bool)
        if not len(labels) or labels.all() or not labels.any():
            share = min(max(labels.mean() if len(labels) else 0.01, 0.01), 0.99)
            self.bias = float(np.log(share / (1 - share)))
            return self
        self.choose(texts, labels)
        rows = [self.features(t.tolist()) for t in texts]
        size, rng = len(self.place), np.random.default_rng(self.seed)
        self.weight, self.factor = np.zeros(size), rng.normal(0, 0.02, (size, self.factors))
        share = labels.mean()
        self.bias = float(np.log(share / (1 - share)))
        flat = np.array([i for r in rows for i in r], dtype=int)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        n = len(rows)
        packed = np.concatenate([[self.bias], self.weight, self.factor.ravel()])
        first, second = np.zeros_like(packed), np.zeros_like(packed)
        for step in range(1, self.rounds + 1):
            self.bias, self.weight = packed[0], packed[1:1 + size]
            self.factor = packed[1 + size:].reshape(size, self.factors)
            error = (1 / (1 + np.exp(-np.clip(self._sum(flat, owner, n), -40, 40))) - labels) / n
            spread = error[owner]
            g_weight = np.bincount(flat, spread, size) + self.ridge[0] * self.weight
            g_factor = np.empty_like(self.factor)
            for k in range(self.factors):
                v = self.factor[flat, k]
                total = np.bincount(owner, v, n)
                g_factor[:, k] = np.bincount(flat, spread * (total[owner] - v), size)
            g_factor += self.ridge[1] * self.factor
            grad = np.concatenate([[error.sum()], g_weight, g_factor.ravel()])
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            packed = packed - self.rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        self.bias, self.weight = float(packed[0]), packed[1:1 + size].copy()
        self.factor = packed[1 + size:].reshape(size, self.factors).copy()
        if prior and 0 < prior < 1:
            self.bias += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
        return self


def remainder(column: str = "doc_id"):
    """crc32 of the id as text, modulo 4; rows with remainder 2 are held out."""
    return F.crc32(F.col(column).cast("string")) % 4


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> FactorizationMachine:
    """Fit on at most ``sample[label]`` documents of each label, by a hash of their id.

    Of rows with one id the smallest text counts.  Held-out rows, null labels and unknown documents are not used.  The sample's ids are
    broadcast (bounded by ``sample``); of the texts only hashed terms come to the driver.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label"))
    known = known.filter("label IS NOT NULL AND doc_id IS NOT NULL").filter(remainder() != 2)
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("label") > 0, 1).otherwise(0)).alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [
        known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for label, most in sorted(sample.items())
    ]
    chosen = parts[0].unionAll(parts[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def hashed(batches):
        for batch in batches:
            parts = [np.fromiter(sorted(terms(t)), dtype="<u4").tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["label"], pa.array(parts, pa.binary())], names=["doc_id", "label", "terms"]
            )

    table = rows.select("doc_id", "label", "text").mapInArrow(hashed, "doc_id long, label int, terms binary").toArrow()
    data = sorted(zip(table["doc_id"].to_pylist(), table["label"].to_pylist(), table["terms"].to_pylist()))
    texts = [np.frombuffer(t, "<u4") for _, _, t in data]
    prior = totals.get(1, 0) / max(sum(totals.values()), 1)
    machine = FactorizationMachine().fit(texts, np.array([label for _, label, _ in data], dtype=bool), prior)
    # the driver goes on with the machine alone
    del table, data, texts
    give_back()
    return machine


class _Lookup:
    """Feature numbers of words, remembered in a bounded cache."""

    def __init__(self, machine: FactorizationMachine):
        self.machine, self.words = machine, {}

    def features(self, text: str | None) -> list[int]:
        words = set(_WORD.findall((text or "").lower()))
        new = words.difference(self.words)
        if new:
            if len(self.words) > CACHED_WORDS:
                self.words.clear()
                new = words
            place = self.machine.place
            for word in new:
                self.words[word] = tuple(place[t] for t in word_terms(word) if t in place)
        found: set[int] = set()
        for hit in map(self.words.__getitem__, words):
            if hit:
                found.update(hit)
        return sorted(found)


def score_documents(docs: DataFrame, machine: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts are scored too."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), F.col("text"),
    )

    def score(batches):
        lookup = _Lookup(machine)
        for batch in batches:
            found = machine.score([lookup.features(t) for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(found, pa.float64()),
                 pa.array((found >= threshold).astype("i4"), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )
        give_back()

    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, machine: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""

    def choose(batches):
        lookup = _Lookup(machine)
        for batch in batches:
            if batch.num_rows:
                found = machine.score([lookup.features(t) for t in batch["text"].to_pylist()])
                yield batch.filter(pa.array(found < threshold, pa.bool_()))
        del lookup
        give_back()

    return docs.mapInArrow(choose, docs.schema)
