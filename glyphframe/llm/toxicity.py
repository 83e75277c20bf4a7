"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words, their first bytes at each length of STEMS (so that inflected forms share a weight),
stems that occur at least as often as each number of REPEATS (a stem that a clean text meets once by chance is told from one
that comes again and again), pairs of neighbours and pairs with one word between, hashed to 2**BITS indices. Each weight has its own learning rate, and L1 keeps all but the
useful ones at exactly zero, so the model that goes to the executors is the list of the others. Fitted on at most SAMPLE
labelled rows, in the order of a hash of the id.

Cases: null text is empty and scored by the bias alone; texts of any length are scored whole, of the sample only those of up
to a 64th of SAMPLE_BYTES are learned from; labels that are null are not learned from, and of an id's conflicting labels the
largest counts; without labels every score is 0.5; rows with equal doc_id are scored each; columns other than doc_id and text
are not read, whatever they are called; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import ALNUM, U, word_hashes
from .features import bucket, learnable, sample, score_rows, with_meta

BITS, SAMPLE, EPOCHS, THRESHOLD = 20, 16000, 3, 0.5
STEMS, REPEATS = (5, 7), (2, 4)
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0


def features(text: str, meta: list[str] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, *stems = word_hashes(text.lower().encode(), ALNUM, STEMS)
    mixed = words * U(0x9E3779B97F4A7C15)
    grams = [bucket(words, 1, BITS), bucket(mixed[:-1] + words[1:], 2, BITS), bucket(mixed[:-2] + words[2:], 3, BITS)]
    for k, stem in enumerate(stems):
        found, counts = np.unique(stem, return_counts=True)
        grams += [bucket(found[counts >= n], 100 * (k + 1) + n, BITS) for n in (1, *REPEATS)]
    idx = np.unique(np.concatenate(grams))
    return idx, np.zeros(0, np.float32), np.zeros(0, np.float32)


class Ftrl:
    """Weights after EPOCHS passes, and a bias, which has no L1."""

    def __init__(self, rows: list):
        z, n, bias = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(2)

        def weights(z, n):
            w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
            w[np.abs(z) <= L1] = 0.0
            return w

        for epoch in range(EPOCHS if rows else 0):
            for k in np.random.default_rng([11, epoch]).permutation(len(rows)):
                y, i = rows[k][:2]
                zi, ni = z[i], n[i]
                w, w0 = weights(zi, ni), -bias[0] / ((BETA + math.sqrt(bias[1])) / ALPHA + L2)
                g = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum()) + w0)))) - float(y > 0)
                z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
                n[i] = ni + g * g
                bias += g - (math.sqrt(bias[1] + g * g) - math.sqrt(bias[1])) / ALPHA * w0, g * g
        w = weights(z, n)
        self.bias, self.index = float(-bias[0] / ((BETA + math.sqrt(bias[1])) / ALPHA + L2)), np.flatnonzero(w)
        self.weight = w[self.index].astype(np.float32)
        self._dense: np.ndarray | None = None

    def __getstate__(self):
        return {"bias": self.bias, "index": self.index, "weight": self.weight, "_dense": None}

    def score(self, text: str, meta: list[str] = ()) -> float:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.index] = self.weight
        p = self.bias + float(self._dense[features(text)[0]].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, p))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE) -> Ftrl:
    """docs: as with_meta() gives them; labels: doc_id and the label."""
    return Ftrl(sample(docs, labels, label, rows, features))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_meta(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return score_rows(docs, fit(docs, learnable(spark, sf_dir)).score, THRESHOLD)
