"""What the operators share: shared-storage tables, bucket sizing, packed row blobs, vectorised text hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, materialise  # noqa: F401  used by the operators

# ---------------------------------------------------------------- storage and sizing


def input_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate: file sizes for scans; 0 if it is unknown."""
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # an estimate only
        return 0
    return 0 if size > 1 << 60 else size


def bucket_bytes(spark: SparkSession) -> int:
    """How much input (as stored) a bucket takes: 16 to 128 MiB, by what an executor has for each of its cores."""
    conf = spark.sparkContext.getConf()
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", conf.get("spark.executor.memory", "1g").lower()).groups()
    memory = int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
    return min(128 << 20, max(16 << 20, memory // int(conf.get("spark.executor.cores", "1")) // 32))


def buckets_for(df: DataFrame) -> int:
    """Partitions for a shuffle of df's texts: grows with the input, never below the session's setting."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // bucket_bytes(spark)), 1)


def counts_chars(schema: T.StructType) -> bool:
    """Whether the table has a column n_chars of whole numbers, which follows the text; any other of that name is left alone."""
    return any(f.name == "n_chars" and isinstance(f.dataType, T.IntegralType) for f in schema)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of any table with these columns; other columns, whatever their names, stay behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small slices, so that only few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def release() -> None:
    """Gives the memory that earlier tasks of this worker have freed back to the system, where the C library knows how."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- packed rows


class Scatter:
    """Gathers numpy columns and deals them to buckets as few wide rows (kind, bucket, n, blob): column after column, integers
    as byte planes, whose upper ones hardly vary and compress well."""

    SCHEMA = "kind int, bucket int, n long, blob binary"
    ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])

    def __init__(self, kind: int, buckets: int, dtypes: list, flush_bytes: int = 24 << 20, combine=None, squeezed: bool = False):
        """squeezed: blobs are compressed here, so that wide ones cross to the JVM small."""
        self.kind, self.buckets, self.dtypes, self.flush_bytes, self.combine = kind, buckets, dtypes, flush_bytes, combine
        self.squeeze = zstandard.ZstdCompressor(level=3).compress if squeezed else bytes
        self.parts, self.size = [], 0

    def add(self, bucket: np.ndarray, *cols: np.ndarray) -> None:
        if len(bucket):
            self.parts.append((bucket.astype(np.int32), *(c.astype(d, copy=False) for c, d in zip(cols, self.dtypes))))
            self.size += sum(c.nbytes for c in self.parts[-1])

    def full(self) -> bool:
        return self.size >= self.flush_bytes

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        cols = [np.concatenate(x) for x in zip(*self.parts)]
        self.parts, self.size = [], 0
        if self.combine is not None:
            cols = self.combine(cols)
        order = np.argsort(cols[0], kind="stable")
        bucket = cols[0][order]
        cols = [c[order] for c in cols[1:]]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, int)
        ends = np.append(cuts[1:], len(bucket))
        blobs = [self.squeeze(b"".join(planes(c[i:j]) for c in cols)) for i, j in zip(cuts, ends)]
        if blobs:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cuts), self.kind, np.int32)), pa.array(bucket[cuts]), pa.array((ends - cuts).astype(np.int64)), pa.array(blobs, pa.binary())], schema=self.ARROW
            )


def planes(c: np.ndarray) -> bytes:
    return c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() if c.dtype.kind in "iu" and c.itemsize > 1 else c.tobytes()


def from_planes(blob: bytes, dtype: np.dtype, n: int, at: int) -> np.ndarray:
    if dtype.kind in "iu" and dtype.itemsize > 1:
        return np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * dtype.itemsize, at).reshape(dtype.itemsize, n).T).view(dtype).reshape(n)
    return np.frombuffer(blob, dtype, n, at)


def unpack(blobs: list[tuple[int, bytes]], dtypes: list) -> list[np.ndarray]:
    """The columns of blobs that Scatter wrote."""
    out: list[list[np.ndarray]] = [[] for _ in dtypes]
    for n, blob in blobs:
        at = 0
        for k, d in enumerate(dtypes):
            out[k].append(from_planes(blob, np.dtype(d), n, at))
            at += n * np.dtype(d).itemsize
    return [np.concatenate(x) if x else np.zeros(0, d) for x, d in zip(out, dtypes)]


# ---------------------------------------------------------------- vectorised hashing

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, vectorised."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(a: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = the polynomial hash of a[i:j], shifted by i (see span_hash); a: bytes."""
    up, _ = powers(len(a) + 1)
    c = np.zeros(len(a) + 1, U)
    np.cumsum(_BYTE[a] * up[: len(a)], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal bytes wherever they stand."""
    _, down = powers(len(c))
    return mix((c[end] - c[start]) * down[start] + (end - start).astype(U))


#: Bytes of words: all but ASCII white space; and letters, digits and all of UTF-8 beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_CHUNK = 1 << 20


def word_spans(a: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = table[a]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: bytes, table: np.ndarray = NOT_SPACE, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """Hashes of the words of data in order, then those of their first bytes, for each number in stems. Any length of data."""
    a = np.frombuffer(data, np.uint8)
    start, end = word_spans(a, table)
    out: list[list[np.ndarray]] = [[] for _ in range(1 + len(stems))]
    i = 0
    while i < len(start):  # pieces of about _CHUNK bytes, cut between words, bound the memory
        j = max(i + 1, int(np.searchsorted(start, start[i] + _CHUNK)))
        lo = start[i]
        c = prefix_hash(a[lo : end[j - 1]])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[0].append(span_hash(c, s, e))
        for k, stem in enumerate(stems):
            out[k + 1].append(span_hash(c, s, np.minimum(e, s + stem)))
        i = j
    return tuple(np.concatenate(x) if x else np.zeros(0, U) for x in out)


_GRAM = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) | 1 for i in range(16)], U)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles in order; fewer than n words, none included: one shingle of the whole sequence."""
    if len(words) < n:
        return mix(np.array([int((words * _GRAM[: len(words)]).sum(dtype=U)) + len(words)], U))
    out = np.zeros(len(words) - n + 1, U)
    for k in range(n):
        out += words[k : len(words) - n + 1 + k] * _GRAM[k]
    return mix(out + U(n))
