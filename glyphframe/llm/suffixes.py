"""Suffix-array dedup with a run-length index.

A byte is removed if it lies in a string of LENGTH bytes that also starts in a document with a smaller doc_id.

1. Each window of LENGTH bytes is anchored at the smallest hash among its GRAM-byte grams, so equal windows have equal anchors
   and meet under them. Neighbouring windows with the same anchor are one string. This only decides what meets.
2. Strings whose anchor several documents have are indexed, shard by shard: the run-length compressed Burrows-Wheeler transform
   of a shard's distinct strings, with the smallest document sampled where a run of matches ends (see RunLengthIndex). All
   strings are streamed backwards through it; the matching statistics, cut at LENGTH, say for each position the smallest
   document that matches LENGTH bytes from there. Where that is an earlier one, the window is marked. A task that reads texts
   does so at once for the strings whose anchor at least OFTEN of its documents have, and sends on only those with a window
   that is its first; what is sent meets in the anchor's bucket and goes through an index there.
3. What is marked is cut out of the texts.

An anchor with more than CROWD strings in a bucket, or LOCAL in a task, does not stay in one bucket: its windows are sent one by
one to the bucket of the window's hash, where they meet in the same way. A task that does so leaves a notice in the anchor's
bucket, which then sends on what other tasks sent there.

Cases: null text is empty; a text shorter than LENGTH bytes stays; texts of any length are read whole, in pieces of 4 MiB that
overlap; rows with equal doc_id do not remove each other's bytes; rows with a null doc_id stay whole and remove nothing; other
columns stay as they are, whatever they are called, but for an n_chars of whole numbers, which follows the text; no rows give
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scatter, U, buckets_for, counts_chars, from_planes, materialise, mix, release, slices, unpack

LENGTH, GRAM, CROWD, LOCAL, OFTEN = 50, 16, 4096, 1024, 4
SPAN = LENGTH - GRAM + 1  # grams in a window, and windows in a string, at most
WIDEST = 88  # bytes of the longest string, in whole words of eight
SHARD_BYTES = 1 << 19
PORTION = 1 << 16  # strings of a bucket whose index is built at a time
_PIECE = 1 << 22
_PLACE = U((1 << 24) - 1)
SEGMENTS, MARKS, WINDOWS, NOTICES = 0, 1, 2, 3  # kinds of blobs
STRING = ["<u4", "<i8", "<i8", "<u4", "u1", f"V{WIDEST}"]  # anchor (what the bucket does not tell), doc, text tag, start, windows, bytes
MARK = ["<i8", "<i8", "<u4", "<u4"]  # doc, text tag, start, bytes

# ---------------------------------------------------------------- anchors and strings


def segments(a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, first window, windows, bytes padded to WIDEST) of the strings of a text's bytes, piece by piece."""
    for lo in range(0, len(a) - LENGTH + 1, _PIECE):
        piece = np.ascontiguousarray(a[lo : lo + _PIECE + LENGTH - 1])
        word = np.ndarray((len(piece) - 7,), "<u8", piece, 0, (1,))
        head, tail = word[: len(piece) - GRAM + 1], word[GRAM - 8 :]
        gram = mix(head * U(0x9FB21C651E98DF25) + mix(tail))
        # a gram of one repeated byte pair stands in too many places: it is an anchor only where a window has no other
        gram = np.where((head == tail) & (head == (head << U(16) | head >> U(48))), gram | U(1 << 63), gram >> U(1))
        low = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while width < SPAN:  # the smallest of SPAN neighbours, the leftmost of equals
            step = min(width, SPAN - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        anchor = (low & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        size = np.diff(np.append(first, len(anchor)))
        yield mix(gram[anchor[first]]), first + lo, size, strings_at(piece, first, size)


def strings_at(a: np.ndarray, at: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """(strings, WIDEST): the bytes of so many windows from each place on, then zeros."""
    padded = np.concatenate((a, np.zeros(WIDEST, np.uint8)))
    rows = np.lib.stride_tricks.sliding_window_view(padded, WIDEST)[at]
    rows[np.arange(WIDEST)[None, :] >= (windows + LENGTH - 1)[:, None]] = 0
    return rows


def xx64(value: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
    """xxhash64 of longs as Spark has it, vectorised."""
    p1, p2, p3, p4, p5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, r: (x << U(r)) | (x >> U(64 - r))
    h = (np.full(len(value), seed, U) + p5 + U(8)) ^ (turn(value.astype(np.int64).view(U) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> U(33))) * p2
    h = (h ^ (h >> U(29))) * p3
    return h ^ (h >> U(32))


def bucket_of(doc: np.ndarray, tag: np.ndarray, n: int) -> np.ndarray:
    """pmod(xxhash64(doc_id, tag), n), as beside() deals the texts."""
    return (xx64(tag, xx64(doc, U(42))).view(np.int64) % n).astype(np.int32)


# ---------------------------------------------------------------- the index of a shard


class RunLengthIndex:
    """Over distinct strings of bytes, each with the smallest document that has it: a run-length compressed Burrows-Wheeler
    transform with samples.

    start, base: first row and LF image of each run of equal symbols. The rows that agree on their first `length` bytes are
    the occurrences of one match. If one run holds all of them, and their LF image is all of another match's rows, both
    matches occur in the same documents, so the second needs no sample: whoever streams from one to the other keeps the value.
    Samples (lo, hi, least: rows, smallest document) therefore stand only where a match's rows end a run or are met by others,
    and where a string's stream begins. entry: the row of each string's last window, where its stream starts."""

    def __init__(self, rows: np.ndarray, size: np.ndarray, doc: np.ndarray, length: int = LENGTH):
        """rows: (strings, widest) uint8, of which the first size bytes count."""
        self.length, self.size = length, size.astype(np.int64)
        width = rows.shape[1]
        used = np.arange(width + 1)[None, :] <= self.size[:, None]  # with an end mark, 0
        symbol = np.zeros((len(rows), width + 1), np.uint16)
        symbol[:, :width] = rows
        symbol[:, :width] += 1
        symbol[np.arange(len(rows)), self.size] = 0
        text = symbol[used]
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), self.size + 1)
        first = np.cumsum(self.size + 1) - self.size - 1
        left = (first + self.size)[owner] - np.arange(len(text))  # bytes up to the end mark
        order, alike = self.suffixes(text, left)
        before = text[order - 1]  # an end mark before a string's first symbol
        self.start = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        head, run_size = before[self.start], np.diff(np.append(self.start, len(before)))
        by = np.argsort(head, kind="stable")
        self.base = np.empty(len(by), np.int64)
        self.base[by] = np.cumsum(run_size[by]) - run_size[by]
        row = np.empty(len(order), np.int64)
        row[order] = np.arange(len(order))
        self.entry = row[first + np.maximum(self.size - length, 0)]
        lo = np.flatnonzero(~alike)
        hi = np.append(lo[1:], len(alike))
        least = np.minimum.reduceat(doc[owner[order]], lo) if len(lo) else doc[:0]
        match_of = np.cumsum(~alike) - 1  # by row; the rows of suffixes shorter than `length` are no match
        run_of = np.cumsum(np.concatenate(([True], before[1:] != before[:-1]))) - 1
        long = np.flatnonzero(left[order[lo]] >= length)
        at, run = lo[long], run_of[lo[long]]
        image = self.base[run] + at - self.start[run]
        to = match_of[image]
        kept = (run == run_of[hi[long] - 1]) & (before[at] > 0) & (lo[to] == image) & (hi[to] - lo[to] == hi[long] - at)
        sampled = np.zeros(len(lo), bool)
        sampled[long] = True
        sampled[to[kept]] = False
        sampled[match_of[self.entry[self.size >= length]]] = True
        self.lo, self.hi, self.least = lo[sampled], hi[sampled], least[sampled]

    def suffixes(self, text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array, equal suffixes in the order of their strings; whether each suffix agrees with the one before on
        `length` bytes. Prefix doubling from four symbols on, each round over the suffixes that still tie; a suffix whose end
        mark has been compared ties no more. Up to 2**21 symbols, rank pairs and places share one sorted word."""
        n, places = len(text), np.arange(len(text))
        alike, small, one, two = np.zeros(n, bool), n <= 1 << 21, None, None

        def ordered(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if small:
                packed = np.sort(key << U(21) | at.astype(U))
                return packed >> U(21), (packed & U((1 << 21) - 1)).astype(np.int64)
            by = np.argsort(key, kind="stable")
            return key[by], at[by]

        key = np.zeros(n, U)
        ahead = np.concatenate((text, np.zeros(4, text.dtype)))
        for k in range(4):
            key = (key << U(9)) | np.where(left >= k, ahead[k : k + n], 0).astype(U)
        key, order = ordered(key, places)
        rank, slots, known = np.empty(n, np.int64), places, 4
        part = order  # the suffixes of this round, in order; slots: their rows
        while True:
            new = np.ones(len(part), bool)
            new[1:] = key[1:] != key[:-1]
            new |= left[part] < known
            heads = np.flatnonzero(new)
            rank[part] = np.repeat(slots[heads], np.diff(np.append(heads, len(part))))
            if known <= self.length <= 2 * known:
                one = rank.copy()
                two = one[np.minimum(places + self.length - known, n - 1)]
            tie = ~new
            tie[:-1] |= ~new[1:]
            part, slots = part[tie], slots[tie]
            if not len(part):
                break
            key, part = ordered((rank[part].astype(U) << U(21 if small else 32)) | rank[part + known].astype(U), part)
            order[slots] = part
            known *= 2
        if one is not None:  # else all suffixes differ before that
            a, b = order[1:], order[:-1]
            alike[1:] = (one[a] == one[b]) & (two[a] == two[b]) & (left[a] >= self.length) & (left[b] >= self.length)
        return order, alike

    def stream(self) -> np.ndarray:
        """(strings, windows): the smallest document that matches `length` bytes from there on, the largest number where there
        is no window. All strings step back from their last window at once."""
        windows = np.maximum(self.size - self.length + 1, 0)
        out = np.full((len(self.size), max(int(windows.max(initial=0)), 1)), np.iinfo(np.int64).max)
        active = np.flatnonzero(windows > 0)
        row, known = self.entry[active], np.zeros(len(active), np.int64)
        for step in range(int(windows.max(initial=0))):
            if step:
                going = windows[active] > step
                active, row, known = active[going], row[going], known[going]
                run = np.searchsorted(self.start, row, "right") - 1
                row = self.base[run] + row - self.start[run]
            at = np.maximum(np.searchsorted(self.lo, row, "right") - 1, 0)
            known = np.where((row >= self.lo[at]) & (row < self.hi[at]), self.least[at], known)
            out[active, windows[active] - 1 - step] = known
        return out


def grouped(anchor: np.ndarray, doc: np.ndarray, several: int = 2) -> np.ndarray:
    """The entries, in order of anchor, whose anchor at least so many documents have, or, beyond two, runs of entries of one
    document."""
    order = np.argsort(anchor, kind="stable")
    if not len(order):
        return order
    new = np.concatenate(([True], anchor[order][1:] != anchor[order][:-1]))
    first = np.flatnonzero(new)
    if several > 2:
        new[1:] |= doc[order][1:] != doc[order][:-1]
        many = np.add.reduceat(new.astype(np.int64), first) >= several
    else:
        many = np.minimum.reduceat(doc[order], first) < np.maximum.reduceat(doc[order], first)
    return order[np.repeat(many, np.diff(np.append(first, len(order))))]


def portions(anchor: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The entries in order of anchor, about size at a time; an anchor's entries are in one portion."""
    order = np.argsort(anchor, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], anchor[order][1:] != anchor[order][:-1]))) if len(order) else order
    i = 0
    while i < len(order):
        k = int(np.searchsorted(heads, i + size))
        j = int(heads[k]) if k < len(heads) else len(order)
        yield order[i:j]
        i = j


def string_classes(anchor: np.ndarray, doc: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by anchor, bytes and document; whether each entry of it is the first of its string)."""
    word = np.ascontiguousarray(rows).view("<u8")
    name = mix(sum(mix(word[:, k] + U(k + 1)) * U(2 * k + 1) for k in range(word.shape[1])))
    order = np.lexsort((doc, name, anchor))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (anchor[a] != anchor[b]) | (name[a] != name[b])
    same = np.flatnonzero(~new)  # of one hash: told apart by their bytes
    new[same] = (word[order[same]] != word[order[same - 1]]).any(1)
    return order, new


def matched(anchor: np.ndarray, doc: np.ndarray, windows: np.ndarray, rows: np.ndarray, crowd: int = 1 << 62) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries; for each its windows that match an earlier document, as booleans; the crowded anchors, of more than `crowd`
    strings, whose entries are left out). Entries of anchors that only one document has are not among them."""
    order, new = string_classes(anchor, doc, rows)
    group = np.concatenate(([True], anchor[order][1:] != anchor[order][:-1])) if len(order) else new
    number = np.cumsum(group) - 1
    many = np.bincount(number, new)[number] > crowd if len(order) else new
    crowded = np.unique(anchor[order[many]])
    order, new, group = order[~many], new[~many], group[~many]
    entry_class = np.cumsum(new) - 1
    one = order[new]
    flags = np.zeros((len(order), SPAN), bool)
    upto = np.cumsum(windows[one].astype(np.int64) + LENGTH)
    heads = np.flatnonzero(group[new])  # a shard ends where an anchor does
    i = 0
    while i < len(one):
        fits = int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SHARD_BYTES, "right"))
        k = int(np.searchsorted(heads, fits, "right")) - 1
        j = len(one) if fits >= len(one) else int(heads[k]) if heads[k] > i else int(heads[k + 1]) if k + 1 < len(heads) else len(one)
        index = RunLengthIndex(rows[one[i:j]], windows[one[i:j]].astype(np.int64) + LENGTH - 1, doc[one[i:j]])
        least = index.stream()
        lo, hi = np.searchsorted(entry_class, [i, j])
        flags[lo:hi, : least.shape[1]] = least[entry_class[lo:hi] - i] < doc[order[lo:hi]][:, None]
        i = j
    return order, flags, crowded


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, columns) of the runs of true cells."""
    edge = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    edge[:, 1:-1] = flags
    step = np.diff(edge, axis=1)
    row, first = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    return row, first, end - first


def spans_of(at: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs covered by the marks."""
    if not len(at):
        return []
    order = np.argsort(at, kind="stable")
    start, end = at[order].astype(np.int64), np.maximum.accumulate(at[order].astype(np.int64) + size[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return list(zip(start[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)].tolist()))


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for i, j in spans:
        out.append(data[at:i])
        at = j
    return b"".join([*out, data[at:]])


# ---------------------------------------------------------------- where strings meet


class Pieces:
    """Rows of several arrays one after the other, copied only where they are asked for."""

    def __init__(self, arrays: list[np.ndarray]):
        self.arrays, self.first = arrays, np.cumsum([0, *map(len, arrays)])

    def __getitem__(self, where: np.ndarray) -> np.ndarray:
        if where.dtype == bool:
            where = np.flatnonzero(where)
        out, order = np.empty(len(where), STRING[-1]), np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], self.first)
        for a, first, i, j in zip(self.arrays, self.first, cuts, cuts[1:]):
            out[order[i:j]] = a[where[order[i:j]] - first]
        return out


def columns_of(blobs: list[tuple[int, bytes]]) -> list:
    """The STRING columns of the blobs, which are taken from the list; the strings stay where they were decompressed."""
    open_ = zstandard.ZstdDecompressor().decompress
    cols: list[list[np.ndarray]] = [[np.zeros(0, d)] for d in STRING]
    while blobs:
        n, blob = blobs.pop()
        data, at = open_(blob), 0
        for col, d in zip(cols, map(np.dtype, STRING)):
            col.append(from_planes(data, d, n, at))
            at += n * d.itemsize
    return [*map(np.concatenate, cols[:-1]), Pieces(cols[-1])]


class Meeting:
    """Strings as they are gathered in a task: what the task's own index marks, and what must be sent on."""

    def __init__(self, n: int, crowd: int, windows: bool, often: int = 2):
        """windows: whether crowded anchors' windows are sent on one by one; often: how many documents an anchor must have."""
        self.n, self.crowd, self.windows, self.often = n, crowd, windows, often
        self.marks, self.notices = Scatter(MARKS, n, MARK), Scatter(NOTICES, n, ["<u4"])
        self.single = Scatter(WINDOWS, n, STRING, 32 << 20, self.settle, True) if windows else None

    def settle(self, cols: list[np.ndarray]) -> list[np.ndarray]:
        """For Scatter: bucket and STRING columns, without the entries all of whose windows are marked and those that go on
        window by window."""
        entries, flags, gone = self.take(cols[0], cols[1:])
        keep = ~gone
        keep[entries[flags.sum(1) == cols[5][entries]]] = False
        return [c[keep] for c in cols]

    def take(self, bucket: np.ndarray, cols: list[np.ndarray], noticed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marks what the strings' index finds. (entries of the index; their windows; which entries of all are crowded, or
        noticed, and have been sent on window by window)."""
        anchor, doc, tag, at, size, rows = cols
        key = bucket.astype(U) << U(32) | anchor
        gone = np.isin(anchor, noticed) if noticed is not None and len(noticed) else np.zeros(len(anchor), bool)
        shared = grouped(key, doc, self.often)
        shared = shared[~gone[shared]]
        some = rows[shared].view(np.uint8).reshape(-1, WIDEST)
        entries, flags, crowded = matched(key[shared], doc[shared], size[shared], some, self.crowd if self.windows else 1 << 62)
        entries = shared[entries]
        which, first, count = runs(flags)
        e = entries[which]
        self.marks.add(bucket_of(doc[e], tag[e], self.n), doc[e], tag[e], at[e].astype(np.int64) + first, count + LENGTH - 1)
        if len(crowded):
            gone |= np.isin(key, crowded)
            self.notices.add((crowded >> U(32)).astype(np.int32), crowded & U(0xFFFFFFFF))
        if gone.any():
            self.send_windows([c[gone] for c in cols])
        return entries, flags, gone

    def send_windows(self, cols: list[np.ndarray]) -> None:
        for k in range(0, len(cols[0]), 1 << 15):
            _, doc, tag, at, size, rows = (c[k : k + (1 << 15)] for c in cols)
            text = np.ascontiguousarray(rows).view(np.uint8).reshape(-1)
            own = np.repeat(np.arange(len(doc)), size)
            step = np.arange(len(own)) - np.repeat(np.cumsum(size.astype(np.int64)) - size, size)
            one = np.ones(len(own), np.int64)
            each = strings_at(text, own * WIDEST + step, one)
            word = each.view("<u8")
            key = mix(sum(mix(word[:, i] + U(i + 1)) * U(2 * i + 1) for i in range(7)))
            self.single.add((key % U(self.n)).astype(np.int32), key >> U(32), doc[own], tag[own], at[own].astype(np.int64) + step, one, each.view(f"V{WIDEST}")[:, 0])

    def flush(self, all_: bool = False) -> Iterator[pa.RecordBatch]:
        if self.single is not None and (all_ or self.single.full()):
            yield from self.single.flush()
        yield from self.marks.flush()
        yield from self.notices.flush()


def blobs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "n", "blob")))


def rows_of(kinds: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kinds), Scatter.ARROW)], schema=Scatter.ARROW)


def deal(docs: DataFrame, n: int) -> DataFrame:
    """Strings dealt by anchor, and what is marked at once. docs: doc_id, tag, text, no null id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        meeting = Meeting(n, LOCAL, True, OFTEN)
        out = Scatter(SEGMENTS, n, STRING, 32 << 20, meeting.settle, True)
        for b in slices(batches, 64):
            for doc, tag, text in zip(b.column("doc_id").to_pylist(), b.column("tag").to_pylist(), b.column("text").to_pylist()):
                for anchor, at, size, rows in segments(np.frombuffer((text or "").encode(), np.uint8)):
                    out.add((anchor % U(n)).astype(np.int32), anchor >> U(32), np.full(len(at), doc, np.int64), np.full(len(at), tag, np.int64), at, size, rows.view(f"V{WIDEST}")[:, 0])
                    if out.full():
                        yield from out.flush()
                        yield from meeting.flush()
        yield from out.flush()
        yield from meeting.flush(True)

    return docs.mapInArrow(run, Scatter.SCHEMA)


def meet(dealt: DataFrame, n: int, kind: int, windows: bool) -> DataFrame:
    """Marks, and single windows if so wanted, of the blobs of that kind; others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        meeting, own, noticed, bucket = Meeting(n, CROWD, windows), [], [], 0
        for row in blobs_of(batches):
            bucket = row[1]
            if row[0] == kind:
                own.append(row[2:])
            elif row[0] == NOTICES:
                noticed.append(row[2:])
            else:
                yield rows_of([row])
        cols, crowded = columns_of(own), unpack(noticed, ["<u4"])[0]
        for part in portions(cols[0], PORTION):
            meeting.take(np.full(len(part), bucket, np.int32), [c[part] for c in cols], crowded)
            if windows and meeting.single.full():
                yield from meeting.flush()
        yield from meeting.flush(True)

    return dealt.repartitionById(n, F.col("bucket")).mapInArrow(run, Scatter.SCHEMA)


# ---------------------------------------------------------------- texts with what concerns them


def beside(docs: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """The texts (kind 9) and the blobs of their bucket, blobs first. docs: doc_id, tag, text and others. Rows without an id
    have no marks and go anywhere."""
    rest = docs.columns
    blobs = found.select("kind", "bucket", "n", "blob", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in rest])
    place = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id", "tag"))
    texts = docs.select(F.lit(9).alias("kind"), F.pmod(place, F.lit(n)).cast("int").alias("bucket"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("blob"), *rest)
    return blobs.unionByName(texts).repartitionById(n, F.col("bucket")).sortWithinPartitions("kind").drop("bucket")


class Concerns:
    """A bucket's marks by document and text tag; batches are blobs first, then texts."""

    def __init__(self):
        self.blobs, self.cols = [], None

    def take(self, b: pa.RecordBatch) -> pa.RecordBatch:
        """Keeps the batch's blobs and returns its texts."""
        own = int((np.array(b.column("kind")) != 9).sum())
        self.blobs += zip(b.column("n").slice(0, own).to_pylist(), b.column("blob").slice(0, own).to_pylist())
        if own < b.num_rows and self.cols is None:
            cols = unpack(self.blobs, MARK)
            order = np.lexsort((cols[2], cols[1], cols[0]))
            self.cols, self.blobs = [c[order] for c in cols], []
        return b.slice(own)

    def of(self, doc: int, tag: int) -> list[np.ndarray]:
        i, j = np.searchsorted(self.cols[0], doc, "left"), np.searchsorted(self.cols[0], doc, "right")
        k, m = i + np.searchsorted(self.cols[1][i:j], tag, "left"), i + np.searchsorted(self.cols[1][i:j], tag, "right")
        return [c[k:m] for c in self.cols[2:]]


def tag_of(docs: DataFrame) -> Column:
    """The text's hash where some doc_id repeats, to tell its rows apart, else 0, which costs nothing to carry."""
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").head(1):
        return F.xxhash64(F.col("text").cast("string"))
    return F.lit(0).cast("long")


def marks_of(docs: DataFrame) -> tuple[DataFrame, int]:
    """All marks, dealt by document, and the number of buckets. docs: doc_id, tag, text."""
    n = buckets_for(docs)
    found = materialise(meet(deal(docs.where("doc_id IS NOT NULL").select("doc_id", "tag", "text"), n), n, SEGMENTS, True), "matches")
    marks, single = found.where(F.col("kind") == MARKS), found.where(F.col("kind") == WINDOWS)
    if single.head(1):
        marks = marks.unionByName(materialise(meet(single, n, WINDOWS, False), "window-matches"))
    return marks, n


def cut(docs: DataFrame, row: Callable[[pa.RecordBatch, list[list[tuple[int, int]]]], pa.RecordBatch], schema) -> DataFrame:
    """row(batch of doc_id, tag, text and others, the spans that go of each row) of all rows. docs: doc_id, tag, text, others."""
    marks, n = marks_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        concerns = Concerns()
        for b in batches:
            for t in slices(iter([concerns.take(b)]), 256):
                ids = zip(t.column("doc_id").to_pylist(), t.column("tag").to_pylist())
                yield row(t, [[] if doc is None else spans_of(*concerns.of(doc, tag)) for doc, tag in ids])

    return beside(docs, marks, n).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row. docs: doc_id, text."""

    def row(t: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        data = [(x or "").encode() for x in t.column("text").to_pylist()]
        cols = [[len(x) for x in data], [sum(j - i for i, j in s) for s in spans], [len(s) for s in spans]]
        sha = [hashlib.sha256(kept_bytes(x, s)).hexdigest() for x, s in zip(data, spans)]
        return pa.RecordBatch.from_arrays([t.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag_of(docs).alias("tag"), F.col("text").cast("string").alias("text"))
    return cut(own, row, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows with all their columns; text (and n_chars, if it is a whole number) without the removed bytes; a character that
    loses a byte goes with it."""
    schema, counted = docs.schema, counts_chars(docs.schema)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tag_of(docs).alias("tag"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(1).alias("__gf")).alias("__gf_rest"), F.col("doc_id").alias("__gf_doc"))

    def row(t: pa.RecordBatch, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        texts = [kept_bytes(x.encode(), s).decode("utf-8", "ignore") if x is not None and s else x for x, s in zip(t.column("text").to_pylist(), spans)]
        cols = dict(zip(rest, t.column("__gf_rest").flatten())) | {"doc_id": t.column("__gf_doc"), "text": pa.array(texts, pa.string())}
        if counted:
            cols["n_chars"] = pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(cols["n_chars"].type)
        return pa.RecordBatch.from_arrays([cols[f.name] for f in schema], [f.name for f in schema])

    return cut(carried, row, schema)
