"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. The vector of a letter trigram is the product of its letters' vectors,
the first rotated by two places and the second by one; a document is the sum (bundle) of its trigrams' vectors. A language's
prototype is the bundle of its sample's documents, each at unit length, less the mean prototype (what all languages share).
A document gets the language of highest cosine; the score is that language's share of the softmax of the cosines.

The prototypes come from a sample of about PER_LANGUAGE documents of each language, chosen by a hash of the id.

Cases: null text, or text without a letter, is `und` with score 0; texts of any length are read whole; rows with null language
are not learned from; with no language to learn every document is `und`; ties go to the first language by name; rows with
equal doc_id are judged each; columns other than doc_id, text and lang are carried along or left, whatever they are called; no
rows give no rows. What reaches the driver grows with the number of languages (DIM sums each), not with the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, slices

DIM, SHARPNESS, PER_LANGUAGE, TABLE_ROWS = 1024, 12.0, 2000, 12000
_LETTER: dict[int, np.ndarray] = {}
_ALPHA: list[np.ndarray] = []
_TRIGRAMS: dict[int, int] = {}
_TABLE = [np.zeros((0, DIM), np.float32)]


def letter_vector(code: int) -> np.ndarray:
    if code not in _LETTER:
        _LETTER[code] = np.random.default_rng([7, code]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
    return _LETTER[code]


def trigram_vector(code: int) -> np.ndarray:
    a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
    return np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)


def trigrams(text: str) -> np.ndarray:
    """Codes of the letter trigrams; all that is no letter is one space, also before and after the text."""
    if not _ALPHA:
        table = np.zeros(0x110000, bool)
        table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
        _ALPHA.append(table)
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.concatenate(([0], np.where(_ALPHA[0][a], a, 0), [0])).astype(np.int64)
    a = a[np.concatenate(([True], (a[1:] != 0) | (a[:-1] != 0)))]
    return (a[:-2] << 42 | a[1:-1] << 21 | a[2:]) if len(a) > 2 else np.zeros(0, np.int64)


def vectors_of(codes: np.ndarray) -> np.ndarray:
    """The trigrams' vectors, kept for the next call as long as there are few."""
    if len(_TRIGRAMS) + len(codes) > TABLE_ROWS:
        _TRIGRAMS.clear()
        _TABLE[0] = np.zeros((0, DIM), np.float32)
    new = [c for c in codes.tolist() if c not in _TRIGRAMS]
    if new:
        base = len(_TRIGRAMS)
        _TRIGRAMS.update((c, base + i) for i, c in enumerate(new))
        if base + len(new) > len(_TABLE[0]):
            grown = np.zeros((max(2048, 2 * (base + len(new))), DIM), np.float32)
            grown[:base] = _TABLE[0][:base]
            _TABLE[0] = grown
        for i, c in enumerate(new):
            _TABLE[0][base + i] = trigram_vector(c)
    return _TABLE[0][[_TRIGRAMS[c] for c in codes.tolist()]]


def bundles(texts: list[str | None]) -> np.ndarray:
    """One row of DIM a text: the sum of its trigrams' vectors; zero without a letter."""
    grams = [trigrams(t or "") for t in texts]
    out = np.zeros((len(texts), DIM), np.float32)
    codes, at = np.unique(np.concatenate(grams), return_inverse=True) if grams else (np.zeros(0, np.int64), np.zeros(0, int))
    if not len(codes):
        return out
    doc = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    for lo in range(0, len(codes), 4096):
        block = vectors_of(codes[lo : lo + 4096])
        own = (at >= lo) & (at < lo + 4096)
        counts = np.bincount(doc[own] * len(block) + at[own] - lo, minlength=len(texts) * len(block)).reshape(len(texts), len(block))
        out += counts.astype(np.float32) @ block
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages, and their prototypes; docs: doc_id, text, lang."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return [], np.zeros((0, DIM), np.float32)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, per_language / n)]), F.col("lang"))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, 64):
            rows = unit(bundles(b.column("text").to_pylist()))
            for lang, row in zip(b.column("lang").to_pylist(), rows):
                sums[lang] = sums.get(lang, 0) + row.astype(np.float64)
        for lang, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(row)], ["lang", "dim", "value"])

    parts = sample.select("text", "lang").mapInArrow(run, "lang string, dim int, value double")
    got = {lang: np.zeros(DIM) for lang in sorted(counts)}
    for r in parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect():  # DIM rows a language
        got[r.lang][r.dim] = r.value
    langs = [k for k, v in got.items() if v.any()]
    protos = unit(np.array([got[k] for k in langs]).reshape(len(langs), DIM))
    if len(langs) > 1:
        protos = unit(protos - protos.mean(0))
    return langs, protos.astype(np.float32)


def predict_batch(texts: list[str | None], langs: list[str], protos: np.ndarray) -> tuple[list[str], np.ndarray]:
    rows = bundles(texts)
    known = rows.any(1)
    if not langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    cos = unit(rows) @ protos.T
    power = np.exp(SHARPNESS * (cos - cos.max(1, keepdims=True)))
    best = cos.argmax(1)
    score = np.where(known, power[np.arange(len(best)), best] / power.sum(1), 0.0).astype(float)
    return [langs[k] if ok else "und" for k, ok in zip(best, known)], score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of each row, from its text alone."""
    langs, protos = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            names, score = predict_batch(b.column("text").to_pylist(), langs, protos)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang").where(remainder("doc_id", 4) != 2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(labelled(spark, sf_dir))
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return predict(keyed(spark.read.parquet(f"{sf_dir}/documents.parquet")), model).select("doc_id", held, "lang_pred", "score")


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, whose text has a language; those of `und` go."""
    langs, protos = model
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            names, _ = predict_batch(b.column("text").to_pylist(), langs, protos)
            yield b.filter(pa.array([n != "und" for n in names]))

    return docs.mapInArrow(run, schema)
