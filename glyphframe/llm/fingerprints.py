"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each five-word shingle is hashed once; the top bits choose one of BINS bins, which keeps its smallest hash. An empty bin e
copies the non-empty bin j that a fixed random order of e ranks first, so two documents fill it alike whenever that bin is
filled in both; the copy is hashed with e, so that bins with one donor still have bits of their own. Only BITS low-order bits
a bin are stored; two unrelated bins then agree with probability 2**-BITS, which likeness() takes out.

Cases: null text is empty; a text of fewer than five words is one shingle (so is the empty one, and empty texts are alike);
texts of any length are hashed in pieces of about a megabyte; rows with equal doc_id are ordered by a hash of the text, and
null doc_ids come after the smallest id; of the table's columns only the two named are read, whatever the others are called;
no rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, buckets_for, keyed, mix, shingle_hashes, slices, word_hashes

BINS, BITS, WORDS = 512, 4, 5
_RANK = mix(np.arange(BINS * BINS, dtype=np.uint64) + U(977)).reshape(BINS, BINS).astype(np.uint32)


def bins_of(text: str) -> np.ndarray:
    """The BINS low-order values (0 to 2**BITS - 1) of a text."""
    shingles = shingle_hashes(word_hashes(text.lower().encode())[0], WORDS)
    low = np.full(BINS, np.iinfo(np.uint64).max, U)
    at = (shingles >> U(64 - BINS.bit_length() + 1)).astype(np.int64)
    np.minimum.at(low, at, shingles)
    filled = np.zeros(BINS, bool)
    filled[at] = True
    if not filled.all():
        empty, full = np.flatnonzero(~filled), np.flatnonzero(filled)
        low[empty] = mix(low[full[_RANK[np.ix_(empty, full)].argmin(1)]] + empty.astype(U) * U(0x9E3779B97F4A7C15))
    return (low & U((1 << BITS) - 1)).astype(np.uint8)


def pack(values: np.ndarray) -> str:
    return base64.b64encode((values[0::2] << 4 | values[1::2]).tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    b = np.frombuffer(base64.b64decode(text), np.uint8)
    return np.stack([b >> 4, b & 15], 1).reshape(-1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity: the share of equal bins, less the chance that unequal bins agree."""
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, (np.count_nonzero(a == b) / BINS - chance) / (1 - chance))))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [x or "" for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([pack(bins_of(x)) for x in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def slots(key: np.ndarray, place: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The bucket of each row, from the largest key down; cuts: ascending. A key that several cuts name has rows for as many
    buckets, over which its rows fall by place (long, from the largest down)."""
    first, end = len(cuts) - np.searchsorted(cuts, key, "right"), len(cuts) - np.searchsorted(cuts, key, "left")
    down = (np.int64((1 << 63) - 1) - place).view(U)  # wraps: from 0 to 2**64 - 1
    return (first + ((down >> U(32)) * (end - first + 1).astype(U) >> U(32)).astype(np.int64)).astype(np.int32)


def with_next(docs: DataFrame) -> DataFrame:
    """(guest, doc_id, text): rows in descending order of doc_id and text hash fall over the buckets and within them; the row
    after a bucket's last one stands there too, as a guest (after the last row of all: the first). One shuffle of the texts;
    the driver, and each task, sees one cut and one row a bucket."""
    spark, least = docs.sparkSession, -(1 << 63)
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(least)))
    n = buckets_for(docs)
    cuts = np.array(sorted(int(x) for x in docs.approxQuantile("key", [i / n for i in range(1, n)], 0.25 / n)) if n > 1 else [], np.int64)
    crowded = len(np.unique(cuts)) < len(cuts)

    @F.pandas_udf("int")
    def bucket(key: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(slots(key.to_numpy(np.int64), place.to_numpy(np.int64), cuts))

    docs = docs.withColumn("place", F.xxhash64("text") if crowded else F.lit(0).cast("long"))
    docs = docs.withColumn("bucket", bucket("key", "place"))
    tops = sorted((r.bucket, r.top.key, r.top.place) for r in docs.groupBy("bucket").agg(F.max(F.struct("key", "place")).alias("top")).collect())
    guests = [(tops[i - 1][0], key, place) for i, (_, key, place) in enumerate(tops)]  # i = 0: the first row follows the last bucket
    guest = F.broadcast(spark.createDataFrame(guests or [(0, 0, 0)], "host int, top long, top_place long"))  # one row a bucket
    own = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    both = docs.join(guest, (docs.key == guest.top) & (docs.place == guest.top_place), "left")
    both = both.withColumn("at", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest"))))))
    both = both.select("at.bucket", "at.guest", "key", "doc_id", "text")
    return both.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.desc("key"), F.desc(F.xxhash64("text"))).select("guest", "doc_id", "text")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text (its last half replaced by as much of the next row), and the likeness
    of the first to the second and to the next row's. See the module for the cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = None, []

        def emit(row, follower, values):
            doc, text, own = row
            half = len(text) // 2
            edited = text[: len(text) - half] + follower[:half]
            other = bins_of(edited)
            return doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), pack(own), pack(other), likeness(own, other), likeness(own, values)

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        done = False
        for b in slices(batches):
            for guest, doc, text in zip(*(b.column(c).to_pylist() for c in ("guest", "doc_id", "text"))):
                if done:
                    continue  # rows that share the first guest's id follow it in its own bucket
                text = text or ""
                values = bins_of(text)
                if held is not None:
                    out.append(emit(held, text, values))
                held, done = (doc, text, values), bool(guest)
            if out:
                yield table(out)
                out = []

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(keyed(spark.read.parquet(f"{sf_dir}/documents.parquet")))
