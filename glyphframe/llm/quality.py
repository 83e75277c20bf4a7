"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words, hashed to 2**WORD_BITS indices with values log(1 + count) at unit length, STATS standardised
statistics of its structure, and the values of the metadata columns that the caller names, hashed to 2**META_BITS indices
(numbers by the power of two they reach). The score is the logistic of w0 + sum(w x) + the weighted pairs, the latter in
linear time as 0.5 * sum over factors of ((sum v x)**2 - sum (v x)**2). Fitted by AdaGrad on at most SAMPLE labelled rows.

Cases: null text is empty and scored like any other, and a null metadata value is a value of its own; texts of any length are
scored whole, of the sample only those of up to a 64th of SAMPLE_BYTES are learned from; labels that are null are not learned
from, and of an id's conflicting labels the largest counts; without labels every score is 0.5; rows with equal doc_id are
scored each; columns that are not named are not read, whatever they are called; no rows give no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import ALNUM, shingle_hashes, word_hashes
from .features import bucket, learnable, sample, score_rows, with_meta

WORD_BITS, META_BITS, FACTORS, SAMPLE, EPOCHS, THRESHOLD = 14, 8, 6, 12000, 4, 0.3
_CLASS = np.zeros(256, np.int64)  # 1 capital, 2 small or beyond ASCII, 3 digit, 4 white space, 5 .,;:'"- 6 other marks
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
_CLASS[[32, *range(9, 14)]] = 4
_CLASS[[ord(c) for c in ".,;:'\"-"]] = 5
_CLASS[33:127] = np.where(_CLASS[33:127] == 0, 6, _CLASS[33:127])
STATS = 18


def statistics(text: str, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    n = max(len(data), 1)
    share = np.bincount(_CLASS[data], minlength=7)[1:] / n
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(len(lines), 1)
    pairs = shingle_hashes(words, 3)
    chars = np.bincount(data, minlength=256)
    return np.array(
        [
            *share,
            chars[ord("|")] / n,
            chars[ord("!")] / n,
            math.log1p(len(words)),
            len(data) / max(len(words), 1),
            len(counts) / max(len(words), 1),
            (counts.max() if len(counts) else 0) / max(len(words), 1),
            len(np.unique(pairs)) / len(pairs),
            len(set(lines)) / k,
            math.log1p(len(data) / k),
            math.log1p(max(map(len, lines), default=0)),
            sum(x.rstrip()[-1] in ".!?" for x in lines) / k,
            math.log1p(k),
        ],
        np.float32,
    )


def features(text: str, meta: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = word_hashes(text.lower().encode(), ALNUM)[0]
    found, counts = np.unique(words, return_counts=True)
    value = np.log1p(counts).astype(np.float32)
    value /= max(float(np.sqrt((value * value).sum())), 1e-6)
    known = np.unique([(1 << WORD_BITS) + STATS + zlib.crc32(m.encode()) % (1 << META_BITS) for m in meta]).astype(np.int64)
    idx = np.concatenate((bucket(found, 5, WORD_BITS), known))
    return idx, np.concatenate((value, np.full(len(known), 0.5, np.float32))), statistics(text, words, counts)


class Machine:
    """w0, w and V over 2**WORD_BITS word indices, STATS statistics and 2**META_BITS metadata values."""

    def __init__(self, rows: list, seed: int = 3):
        stats = np.array([r[3] for r in rows], np.float64).reshape(len(rows), STATS)
        self.mean, self.scale = (stats.mean(0), stats.std(0) + 1e-6) if rows else (np.zeros(STATS), np.ones(STATS))
        n = (1 << WORD_BITS) + STATS + (1 << META_BITS)
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(n), rng.normal(0, 0.01, (n, FACTORS))
        g0, gw, gv = 1e-6, np.full(n, 1e-6), np.full((n, FACTORS), 1e-6)
        data = [(float(y > 0), *self.row(i, x, s)) for y, i, x, s in rows]
        for epoch in range(EPOCHS if data else 0):
            rate = 0.08 / (1 + epoch)
            for k in rng.permutation(len(data)):
                y, i, x = data[k]
                p, sums = self.raw(i, x)
                e = 1 / (1 + math.exp(-max(-30.0, min(30.0, p)))) - y
                dw = e * x + 2e-5 * self.w[i]
                dv = e * (x[:, None] * sums - self.v[i] * (x * x)[:, None]) + 2e-5 * self.v[i]
                g0 += e * e
                gw[i] += dw * dw
                gv[i] += dv * dv
                self.w0 -= rate * e / math.sqrt(g0)
                self.w[i] -= rate * dw / np.sqrt(gw[i])
                self.v[i] -= rate * dv / np.sqrt(gv[i])
        self.w, self.v = self.w.astype(np.float32), self.v.astype(np.float32)

    def row(self, idx: np.ndarray, value: np.ndarray, stat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((stat - self.mean) / self.scale, -4, 4) / 4
        return np.concatenate((idx.astype(np.int64), (1 << WORD_BITS) + np.arange(STATS))), np.concatenate((value, z))

    def raw(self, i: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        vx = self.v[i] * x[:, None]
        sums = vx.sum(0)
        return self.w0 + float(self.w[i] @ x) + 0.5 * float(sums @ sums - (vx * vx).sum()), sums

    def score(self, text: str, meta: list[str]) -> float:
        p, _ = self.raw(*self.row(*features(text, meta)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, p))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE) -> Machine:
    """docs: as with_meta() gives them; labels: doc_id and the label."""
    return Machine(sample(docs, labels, label, rows, features))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_meta(spark.read.parquet(f"{sf_dir}/documents.parquet"), ("n_chars",))
    return score_rows(docs, fit(docs, learnable(spark, sf_dir)).score, THRESHOLD)
