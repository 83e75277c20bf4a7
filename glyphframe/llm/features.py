"""What the two classifiers share: a bounded labelled sample as sparse rows, and fold rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, mix, slices
from .langid import remainder

Features = Callable[[str, list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]
SAMPLE_BYTES = 64 << 20


def bucket(hashes: np.ndarray, salt: int, bits: int) -> np.ndarray:
    return (mix(hashes + U(salt)) >> U(64 - bits)).astype(np.int64)


def with_meta(docs: DataFrame, meta: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, meta (name=value of each metadata column; numbers by the power of two they reach)."""
    numbers = {f.name for f in docs.schema if isinstance(f.dataType, T.NumericType)}
    value = lambda c: F.floor(F.log2(F.abs(F.col(f"`{c}`").cast("double")) + 1)) if c in numbers else F.col(f"`{c}`")
    values = [F.concat(F.lit(f"{c}="), F.coalesce(value(c).cast("string"), F.lit(""))) for c in meta]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.array(*values) if values else F.array().cast("array<string>")).alias("meta"))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, features: Features, most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(label, indices, values, statistics) of at most `rows` labelled documents with at most `most_bytes` of text between
    them, the first by a hash of the id, and none of more than a 64th of that: the bound on what the driver holds. docs: as
    with_meta() gives them; labels: doc_id and the label; conflicting labels of an id count by their largest."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(label).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    met = docs.join(F.broadcast(ids), docs.doc_id == ids.label_id)
    sizes = met.groupBy("label_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).where(F.col("size") <= most_bytes // 64)
    upto = F.sum("size").over(W.orderBy(F.xxhash64("label_id"), "label_id").rowsBetween(W.unboundedPreceding, 0))  # over `rows` rows at most
    within = sizes.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("label_id")
    ids = ids.join(F.broadcast(within), "label_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            got = [features(t or "", m) for t, m in zip(b.column("text").to_pylist(), b.column("meta").to_pylist())]
            cols = [[x.astype(d).tobytes() for x in c] for c, d in zip(zip(*got), ("<u4", "<f4", "<f4"))] if got else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *(pa.array(c, pa.binary()) for c in cols)], ["doc_id", "y", "idx", "val", "stat"])

    picked = docs.join(F.broadcast(ids), docs.doc_id == ids.label_id).select("doc_id", "y", "text", "meta").mapInArrow(run, "doc_id long, y int, idx binary, val binary, stat binary")
    got = picked.toArrow()  # the arrays below are views of it
    out = []
    for b in got.to_batches():
        views = [[np.frombuffer(x.as_buffer(), d) for x in b.column(c)] for c, d in (("idx", "<u4"), ("val", "<f4"), ("stat", "<f4"))]
        out += zip(b.column("doc_id").to_pylist(), b.column("y").to_pylist(), *views)
    out.sort(key=lambda r: (r[0], len(r[2]), r[2].tobytes()[:64]))  # whatever the order of tasks
    return [r[1:] for r in out]


def learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from: those whose id is not in the held-out fold."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)


def score_rows(docs: DataFrame, score: Callable[[str, list[str]], float], threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; score sees text and meta alone. docs: as with_meta() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            got = np.array([score(t or "", m) for t, m in zip(b.column("text").to_pylist(), b.column("meta").to_pylist())], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return docs.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", held, "score", "predicted")
