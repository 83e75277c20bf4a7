"""Line dedup by a deletion-neighbourhood join.

A line, stripped of outer white space, is a duplicate if an earlier line (by doc_id, then text hash, then line number) equals
it or is within one edit of it (insertion, deletion or substitution of one code point) that is at most a fifth of its length.
Lines that are blank stay. Equal lines (by 128 bits of a digest) are one class with its earliest place, so only classes are
compared.

1. An edit lies in a line's first or in its last half, and leaves the other half as it is. Classes that share a half, counted
   from its end of the line, with another class are the only candidates.
2. A candidate emits, as hashed keys, itself and its variants with one code point deleted. Two lines one substitution apart
   share the variant at that place, and lines that do are joined to the earliest of them, with partial minima before the
   shuffle; one insertion apart, the shorter is a variant of the longer, and the two kinds are joined to each other.
3. Each such pair's edit distance is verified on the strings, and the later line goes.

Cases: null text has no line and stays null; a text whose lines all go becomes empty; lines of any length are compared whole,
in time that grows with their length; rows with equal doc_id and text count as one document (their lines stay or go alike)
and null doc_ids come last; other columns stay as they are, whatever they are called, but for an n_chars of whole numbers,
which follows the text; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scatter, U, buckets_for, counts_chars, discard, materialise, mix, powers, slices, span_hash, unpack

EDITS, MAX_SHARE, WANTED = 1, 0.2, 1 << 18
_CODE = U(0xD6E8FEB86659FD93)
HALF = ["<u8", "<u8"]
VARIANT = ["<u8", "<u8", "<u8", "u1"]  # key, place, line, kind
SUBSTITUTED, WHOLE, SHORTENED = 0, 1, 2
SALTS = 8


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(number, stripped line) of the lines that are not blank."""
    return [(i, s) for i, x in enumerate((text or "").split("\n")) if (s := x.strip())]


def code_hash(codes: np.ndarray) -> np.ndarray:
    """As prefix_hash, over code points."""
    up, _ = powers(len(codes) + 1)
    c = np.zeros(len(codes) + 1, U)
    np.cumsum(mix(codes.astype(U) + _CODE) * up[: len(codes)], out=c[1:])
    return c


def joined(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lines one after the other; where each starts; its length."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(x) for x in lines], np.int64)
    return codes, np.cumsum(size) - size, size


def class_of(line: str) -> tuple[int, int]:
    """The class of a line (under which it meets others), and 64 bits more that tell classes of one number apart."""
    return struct.unpack("<qq", hashlib.blake2b(line.encode(), digest_size=16).digest())


def one_edit(a: str, b: str) -> bool:
    """Whether two lines are equal or one edit apart that is at most MAX_SHARE of the longer one; in linear time, which the
    JVM's levenshtein() is not, whatever its bound."""
    if len(a) > len(b):
        a, b = b, a
    if a == b:
        return True
    if len(b) - len(a) > EDITS or EDITS > len(b) * MAX_SHARE:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def chunks(lines: list[str], most: int = 1 << 21) -> Iterator[list[str]]:
    """The lines in lists of at most so many code points, or of one longer line."""
    some, held = [], 0
    for line in lines:
        if some and held + len(line) > most:
            yield some
            some, held = [], 0
        some.append(line)
        held += len(line)
    if some:
        yield some


def half_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the line, key): the keys of its first and last halves. For lengths n and n + 1 to meet, a line offers halves
    of n // 2 and of (n - 1) // 2 code points; a line of one code point offers the empty half."""
    codes, start, size = joined(lines)
    c = code_hash(codes)
    index, keys = [], []
    for shorter in (0, 1):
        half = np.maximum(size - shorter, 0) // 2
        use = (half != size // 2) if shorter else np.ones(len(size), bool)
        for last in (0, 1):
            lo = start + (size - half if last else 0)
            keys.append(mix(span_hash(c, lo, lo + half) + U(2 * last + 1))[use])
            index.append(np.flatnonzero(use))
    return np.concatenate(index), np.concatenate(keys)


def variant_keys(line: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each substitution class (place and remainder), of the line itself, and of each remainder as a shorter line."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    _, down = powers(n + 1)
    c = code_hash(codes)
    salt = lambda k: np.array([k * int(_CODE) % (1 << 64)], U)  # noqa: E731  tells lengths apart
    rest = c[:-1] + (c[-1:] - c[1:]) * down[1]  # the sum without place i, what follows moved up by one
    short = mix(rest + salt(n - 1))
    return mix(short + mix(np.arange(n, dtype=np.uint64) + U(1))), mix(c[-1:] + salt(n)), np.unique(short)


def earliest_classes(docs: DataFrame) -> DataFrame:
    """line, check (class), first (nulls last: doc_id, text hash, number). docs: doc_id, text, text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(*class_of(s), d is None, d, h, i) for d, h, t in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text").to_pylist()) for i, s in lines_of(t)]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()))], ["line", "check", "none", "doc_id", "text_hash", "number"])

    rows = docs.select("doc_id", "text_hash", "text").mapInArrow(run, "line long, check long, none boolean, doc_id long, text_hash long, number int")
    return rows.groupBy("line", "check").agg(F.min(F.struct("none", "doc_id", "text_hash", "number")).alias("first"))


def candidates(docs: DataFrame, buckets: int) -> DataFrame:
    """line: the classes that share a half with another class."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure = Scatter(1, buckets, ["<u8"])

        def combine(cols):
            """A key that meets several lines in this task makes them candidates at once and is sent with one of them."""
            order, first, size = grouped(cols[1], cols[2])
            bucket, key, line = (c[order] for c in cols)
            several = np.repeat(line[first] != line[first + size - 1], size)
            known = np.unique(line[several])
            sure.add((known % U(buckets)).astype(np.int32), known)
            return [bucket[first], key[first], line[first]]

        out = Scatter(0, buckets, HALF, combine=combine)
        for b in slices(batches, 256):
            lines = list({s for t in b.column("text").to_pylist() for _, s in lines_of(t)})
            for some in chunks(lines):
                index, keys = half_keys(some)
                out.add((keys % U(buckets)).astype(np.int32), keys, np.array([class_of(s)[0] for s in some], np.int64).view(U)[index])
            if out.full():
                yield from out.flush()
                yield from sure.flush()
        yield from out.flush()
        yield from sure.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = kinds(batches)
        key, line = unpack(blobs[0], HALF)
        (known,) = unpack(blobs[1], ["<u8"])
        order, first, size = grouped(key, line)
        line = line[order]
        several = np.repeat(line[first] != line[first + size - 1], size) if len(first) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate((known, line[several]))).view(np.int64))], ["line"])

    dealt = docs.select("text").mapInArrow(deal, Scatter.SCHEMA)
    return dealt.repartitionById(buckets, F.col("bucket")).select("kind", "n", "blob").mapInArrow(meet, "line long").distinct()


def kinds(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, bytes]]]:
    """The blobs of kind 0 and of kind 1."""
    out: dict[int, list[tuple[int, bytes]]] = {0: [], 1: []}
    for b in batches:
        for kind, n, blob in zip(b.column("kind").to_pylist(), b.column("n").to_pylist(), b.column("blob").to_pylist()):
            out[kind].append((n, blob))
    return out


def grouped(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by key, then value; where each key starts in it; how many rows it has."""
    order = np.lexsort((value, key))
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(key)))


def same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a.doc_id.eqNullSafe(b.d) & (a.text_hash == b.h)


def strings(docs: DataFrame, places: DataFrame) -> DataFrame:
    """line, check, string of each class in places (line, check, first): taken from its earliest document."""
    per_doc = places.groupBy(F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("h")).agg(F.collect_list(F.struct("first.number", "line", "check")).alias("wanted"))
    # few documents are wanted while lines rarely share a half: a set of at most WANTED slots, whatever the input, tells most
    # of the others before their texts are shuffled
    slot = lambda *c: F.pmod(F.xxhash64(*c), F.lit(WANTED))
    slots = per_doc.select(slot("d", "h").alias("slot")).distinct()
    some = docs.withColumn("slot", slot("doc_id", "text_hash")).join(F.broadcast(slots), "slot", "left_semi")
    met = some.join(per_doc, same_doc(some, per_doc)).dropDuplicates(["d", "h"]).select("text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
                parts = text.split("\n")
                rows += [(w["line"], w["check"], parts[w["number"]].strip()) for w in wanted]
            if rows:
                lines, checks, texts = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.array(checks, pa.int64()), pa.array(texts, pa.string())], ["line", "check", "string"])

    return met.mapInArrow(run, "line long, check long, string string")


def pairs(found: DataFrame, buckets: int) -> DataFrame:
    """(line, earlier): candidates and the earliest class of each variant key they emit. found: line, string, place (long: the
    order of first occurrence)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sure = Scatter(1, buckets, HALF)

        def combine(cols):
            """Of a substitution class's lines in this task only the earliest is sent; the others have it as their earlier
            line."""
            one = cols[4] == SUBSTITUTED
            rest = [c[~one] for c in cols]
            cols = [c[one] for c in cols]
            order, first, size = grouped(cols[1], cols[2])
            cols = [c[order] for c in cols]
            head = np.repeat(cols[3][first], size)
            later = np.flatnonzero(cols[3] != head)
            sure.add((cols[3][later] % U(buckets)).astype(np.int32), cols[3][later], head[later])
            return [np.concatenate((c[first], r)) for c, r in zip(cols, rest)]

        out = Scatter(0, buckets, VARIANT, combine=combine)
        for b in slices(batches, 256):
            for line, place, text in zip(b.column("line").to_pylist(), b.column("place").to_pylist(), b.column("string").to_pylist()):
                changed, whole, short = variant_keys(text)
                own = line % SALTS  # many lines may shorten to one, which therefore waits in every salt
                for kind, keys in ((SUBSTITUTED, changed), (WHOLE, mix(whole + np.arange(SALTS, dtype=np.uint64))), (SHORTENED, mix(short + U(own)))):
                    out.add((keys % U(buckets)).astype(np.int32), keys, np.full(len(keys), place, np.uint64), np.full(len(keys), line, np.int64).view(U), np.full(len(keys), kind, np.uint8))
            if out.full():
                yield from out.flush()
                yield from sure.flush()
        yield from out.flush()
        yield from sure.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = kinds(batches)
        got = [np.stack(unpack(blobs[1], HALF), 1)]
        cols = unpack(blobs[0], VARIANT)
        one = cols[3] == SUBSTITUTED
        key, place, line = (c[one] for c in cols[:3])
        order, first, size = grouped(key, place)
        line = line[order]
        head = np.repeat(line[first], size)
        got.append(np.stack([line, head], 1)[line != head])
        key, place, line, kind = (c[~one] for c in cols)
        order, first, size = grouped(key, place)
        place, line, whole = place[order], line[order], kind[order] == WHOLE
        if len(first):
            group = np.repeat(np.arange(len(first)), size)
            for mine, other in ((~whole, whole), (whole, ~whole)):  # the earliest of the other kind, if any
                at = np.full(len(first), len(line))
                np.minimum.at(at, group[other], np.flatnonzero(other))
                before = at[group]
                late = mine & (before < np.arange(len(line)))
                got.append(np.stack([line[late], line[before[late]]], 1))
        pairs_ = np.unique(np.concatenate(got), axis=0).view(np.int64)
        if len(pairs_):
            yield pa.RecordBatch.from_arrays([pa.array(pairs_[:, 0]), pa.array(pairs_[:, 1])], ["line", "earlier"])

    dealt = found.select("line", "place", "string").mapInArrow(deal, Scatter.SCHEMA)
    return dealt.repartitionById(buckets, F.col("bucket")).select("kind", "n", "blob").mapInArrow(meet, "line long, earlier long").distinct()


def near_lines(docs: DataFrame, classes: DataFrame, buckets: int) -> DataFrame:
    """line, check: the classes with an earlier class within the edit bound."""
    wanted = materialise(candidates(docs, buckets).join(classes, "line").select("line", "check", "first"), "line-candidates")
    found = strings(docs, wanted).join(wanted, ["line", "check"])
    found = materialise(found.select("line", "check", "string", "first"), "line-strings")
    discard(wanted)
    order = F.col("first")
    # the order of first places as one number: a rank within range partitions would need another pass, and the hash of the
    # place would lose the order, so the rank comes from sorted runs: partition number and position within it
    ranked = found.repartitionByRange(buckets, order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id())
    met = materialise(pairs(ranked, buckets), "line-pairs")
    a, b = found.select("line", "check", "string", "first"), found.select(F.col("line").alias("earlier"), F.col("string").alias("other"), F.col("first").alias("before"))
    later = met.join(a, "line").join(b, "earlier").where(F.col("before") < F.col("first")).select("line", "check", "string", "other")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            good = [one_edit(x, y) for x, y in zip(batch.column("string").to_pylist(), batch.column("other").to_pylist())]
            yield batch.select(["line", "check"]).filter(pa.array(good, pa.bool_()))

    gone = materialise(later.mapInArrow(verify, "line long, check long").distinct(), "line-near")
    discard(met)
    discard(found)
    return gone


def kept_lines(docs: DataFrame) -> DataFrame:
    """d, h (document), kept: the numbers of the lines that stay. docs: doc_id, text, text_hash."""
    buckets = buckets_for(docs)
    classes = materialise(earliest_classes(docs), "line-classes")
    gone = near_lines(docs, classes, buckets)
    stay = classes.join(gone, ["line", "check"], "left_anti").select("first.*")
    return stay.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_list("number").alias("kept"))


def rebuilt(text: str | None, kept: list[int] | None) -> tuple[str | None, int, int]:
    """The text without the lines that go, its number of lines that are not blank, and how many of them go."""
    if text is None:
        return None, 0, 0
    stay, parts = set(kept or ()), text.split("\n")
    full = [bool(x.strip()) for x in parts]
    out = [x for i, x in enumerate(parts) if not full[i] or i in stay]
    gone = len(parts) - len(out)
    return ("\n".join(out) if any(x.strip() for x in out) else "") if gone else text, sum(full), gone


def with_kept(docs: DataFrame) -> DataFrame:
    """docs with a last column __gf_kept; docs has doc_id and text among its columns."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    kept = kept_lines(own)
    kept = kept.select(F.col("d").alias("__gf_doc"), F.col("h").alias("__gf_hash"), F.col("kept").alias("__gf_kept"))
    on = docs["doc_id"].cast("long").eqNullSafe(F.col("__gf_doc")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__gf_hash"))
    return docs.join(kept, on, "left").drop("__gf_doc", "__gf_hash")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows with all their columns; text (and n_chars, if it is a whole number) without the lines that go."""
    schema, counted = docs.schema, counts_chars(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [rebuilt(t, k)[0] for t, k in zip(b.column("text").to_pylist(), b.column("__gf_kept").to_pylist())]
            cols = {f.name: b.column(i) for i, f in enumerate(b.schema) if f.name != "__gf_kept"}
            cols["text"] = pa.array(texts, pa.string())
            if counted:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return with_kept(docs).mapInArrow(run, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, kept_sha256 of the remaining text (null: empty) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [rebuilt(t, k) for t, k in zip(b.column("text").to_pylist(), b.column("__gf_kept").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256((r[0] or "").encode()).hexdigest() for r in rows])], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_kept(docs).mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")
