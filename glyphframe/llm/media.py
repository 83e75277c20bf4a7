"""Media columns: signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all known formats, and the end marks of those that are read from their
end, in one pass over a value. At each hit the format's validator walks its structure (chunks and checksums, blocks, declared
lengths) and returns the length it really has, or nothing. What is valid at byte 0 is the value's type, whatever type it was declared as; valid items further on, outside those
already taken, are carved out. PNG is also written and read here, as the lossless container of sample payloads.

A zip file and a PDF are read from their end records, which say where they begin, so parts written as a stream and files that
were saved again are whole. A FLAC stream does not say where it ends: it reaches to the end of the value.

Cases: null media has type null and nothing carved; bytes of no known structure are `application/octet-stream`; a damaged or
cut value is of no known structure; of items that begin at one place the first listed format counts; values of any length are
read whole, in time that grows with their length; a null text is an empty payload, and equal texts have equal media; of the
table's columns only the named are read, whatever the others are called; no rows give no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import keyed, slices

UNIT, WIDTH = 576, 192
PNG = b"\x89PNG\r\n\x1a\n"

# ---------------------------------------------------------------- validators: the length of the item at `at`, or 0


def png_length(b: bytes, at: int) -> int:
    i, first = at + 8, True
    while i + 12 <= len(b):
        (n,), kind = struct.unpack_from(">I", b, i), b[i + 4 : i + 8]
        if i + 12 + n > len(b) or first != (kind == b"IHDR") or zlib.crc32(memoryview(b)[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return 0
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i - at
    return 0


def gif_length(b: bytes, at: int) -> int:
    if at + 14 > len(b):
        return 0
    i = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    images = 0
    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at if images else 0
        if b[i] == 0x21:
            i += 2
        elif b[i] == 0x2C and i + 10 < len(b):
            i += 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 128 else 0)
            images += 1
        else:
            return 0
        while i < len(b) and b[i]:
            i += 1 + b[i]
        i += 1
    return 0


def riff_length(b: bytes, at: int) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    i, kinds = at + 12, []
    while i + 8 <= end <= len(b):
        kinds.append(b[i : i + 4])
        i += 8 + (n := struct.unpack_from("<I", b, i + 4)[0]) + n % 2
    return end - at if i in (end, end + 1) and kinds and (b[at + 8 : at + 12] != b"WAVE" or {b"fmt ", b"data"} <= set(kinds)) else 0


def bmp_length(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, _, start, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    need = start + ((width * bits + 31) // 32 * 4) * abs(height)
    return size if header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height and size >= need and at + size <= len(b) else 0


def jpeg_length(b: bytes, at: int) -> int:
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind = b[i + 1]
        if kind in (0xD8, 0x00) or 0xD0 <= kind <= 0xD7:
            return 0
        if kind == 0xD9:
            return 0
        i += 2 + struct.unpack_from(">H", b, i + 2)[0]
        if kind == 0xDA:
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b):
                if b[i + 1] == 0xD9:
                    return i + 2 - at
                if b[i + 1] != 0 and not 0xD0 <= b[i + 1] <= 0xD7 and b[i + 1] != 0xFF:
                    break
                i += 1 if b[i + 1] == 0xFF else 2
            else:
                return 0
    return 0


def gzip_length(b: bytes, at: int) -> int:
    if at + 18 > len(b) or b[at + 2] != 8 or b[at + 3] & 0xE0:
        return 0
    d = zlib.decompressobj(31)
    try:
        for i in range(at, len(b), 1 << 16):
            chunk = b[i : i + (1 << 16)]
            while chunk and not d.eof:
                d.decompress(chunk, 1 << 20)
                chunk = d.unconsumed_tail
            if d.eof:
                return min(i + (1 << 16), len(b)) - len(d.unused_data) - at
    except zlib.error:
        pass
    return 0


def mp4_length(b: bytes, at: int) -> int:
    i, seen = at, set()
    while i + 8 <= len(b):
        size, kind = struct.unpack_from(">I", b, i)[0], b[i + 4 : i + 8]
        if kind not in BOXES:
            break
        if size == 1 and i + 16 <= len(b):
            (size,) = struct.unpack_from(">Q", b, i + 8)
        size = size or len(b) - i
        if size < 8 or i + size > len(b):
            return 0
        seen.add(kind)
        i += size
    return i - at if seen & {b"moov", b"moof", b"mdat"} else 0


def ogg_length(b: bytes, at: int) -> int:
    i, pages = at, 0
    while i + 27 <= len(b) and b[i : i + 5] == b"OggS\0":
        n = b[i + 26]
        size = 27 + n + sum(b[i + 27 : i + 27 + n])
        if i + size > len(b) or (not pages and not b[i + 5] & 2):
            return 0
        i, pages = i + size, pages + 1
    return i - at


def flac_length(b: bytes, at: int) -> int:
    i, first = at + 4, True
    while i + 4 <= len(b):
        head, n = b[i], int.from_bytes(b[i + 1 : i + 4], "big")
        if first and (head & 127, n) != (0, 34):
            return 0
        i, first = i + 4 + n, False
        if head & 128:
            return len(b) - at if b[i : i + 1] == b"\xff" and b[i + 1 : i + 2] in (b"\xf8", b"\xf9") else 0
    return 0


def mp3_length(b: bytes, at: int) -> int:
    if at + 10 > len(b) or b[at + 3] > 4 or max(b[at + 6 : at + 10]) > 127:
        return 0
    i, frames = at + 10 + sum(x << 7 * (3 - k) for k, x in enumerate(b[at + 6 : at + 10])), 0
    while i + 4 <= len(b) and b[i] == 0xFF and b[i + 1] & 0xE6 == 0xE2 and b[i + 1] & 0x18 != 8:
        newest = b[i + 1] & 0x18 == 0x18
        rate, hertz = BITRATES[newest][b[i + 2] >> 4], (*HERTZ, 0)[b[i + 2] >> 2 & 3] >> {0x18: 0, 0x10: 1, 0: 2}[b[i + 1] & 0x18]
        if not rate or not hertz:
            break
        size = (144 if newest else 72) * rate * 1000 // hertz + (b[i + 2] >> 1 & 1)
        if i + size > len(b):
            break
        i, frames = i + size, frames + 1
    return i - at if frames > 1 else 0


def tiff_length(b: bytes, at: int) -> int:
    end = "<" if b[at : at + 2] == b"II" else ">"
    size_of = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
    try:
        (where,) = struct.unpack_from(end + "I", b, at + 4)
        last, seen = 8, set()
        while where and where not in seen:
            seen.add(where)
            (n,) = struct.unpack_from(end + "H", b, at + where)
            last, lists = max(last, where + 6 + 12 * n), {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(end + "HHI", b, at + where + 2 + 12 * k)
                size = size_of[kind] * count
                place = where + 10 + 12 * k if size <= 4 else struct.unpack_from(end + "I", b, at + where + 10 + 12 * k)[0]
                last = max(last, place + size)
                if tag in (273, 279, 324, 325) and kind in (3, 4):
                    lists[tag] = struct.unpack_from(f"{end}{count}{'H' if kind == 3 else 'I'}", b, at + place)
            for starts, sizes in ((273, 279), (324, 325)):
                last = max([last, *(x + y for x, y in zip(lists.get(starts, ()), lists.get(sizes, ())))])
            (where,) = struct.unpack_from(end + "I", b, at + where + 2 + 12 * n)
    except (struct.error, KeyError):
        return 0
    return last if seen and at + last <= len(b) else 0


def zip_ends(b: bytes, marks: list[int]) -> dict[int, int]:
    """Where each zip file begins, by its end records, and where it ends."""
    out = {}
    for e in marks:
        if e + 22 > len(b):
            continue
        count, size, offset, note = struct.unpack_from("<HIIH", b, e + 10)
        listed, at = e - size, e - size - offset
        if at < 0 or not count or b[at : at + 4] != b"PK\x03\x04" or e + 22 + note > len(b):
            continue
        i = listed
        while i + 46 <= e and b[i : i + 4] == b"PK\x01\x02" and b[at + (own := struct.unpack_from("<I", b, i + 42)[0]) : at + own + 4] == b"PK\x03\x04":
            i, count = i + 46 + sum(struct.unpack_from("<HHH", b, i + 28)), count - 1
        if i == e and not count:
            out[at] = e + 22 + note
    return out


def pdf_ends(b: bytes, marks: list[int]) -> dict[int, int]:
    """Where each PDF begins, by the place of the cross references that its last end mark names, and where it ends. Where the
    named place is of no use, a PDF reaches from its head to the first end mark before the next head."""
    out = {}
    tables = [m.start() for m in re.finditer(rb"(?<!start)xref|\d+ \d+ obj", b)]
    heads = [m.start() for m in re.finditer(rb"%PDF-\d", b)]
    for e in marks:
        tail = re.search(rb"startxref\s{1,9}(\d{1,19})\s{1,9}\Z", b[max(e - 60, 0) : e])
        if not tail:
            continue
        start = max(e - 60, 0) + tail.start()
        k = bisect.bisect_left(tables, start)
        at = tables[k - 1] - int(tail[1]) if k else -1
        if at < 0 or b[at : at + 5] != b"%PDF-":
            k = bisect.bisect_left(heads, start)
            if not k or heads[k - 1] in out:
                continue
            at = heads[k - 1]
        out[at] = e + 5
    return out


#: Fixed values of the formats: top-level boxes, bit rates in thousands and sample rates of audio frames.
BOXES = {b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"moof", b"mfra", b"meta", b"sidx", b"styp", b"uuid", b"pdin", b"udta"}
BITRATES = {True: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0], False: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0]}
HERTZ = (44100, 48000, 32000)

#: Magic bytes, how far into an item they stand, its type and validator; those without one are found by their end records.
FORMATS: dict[bytes, tuple[int, str, Callable[[bytes, int], int] | None]] = {
    PNG: (0, "image/png", png_length),
    b"GIF87a": (0, "image/gif", gif_length),
    b"GIF89a": (0, "image/gif", gif_length),
    b"RIFF": (0, "riff", riff_length),
    b"BM": (0, "image/bmp", bmp_length),
    b"\xff\xd8\xff": (0, "image/jpeg", jpeg_length),
    b"II*\0": (0, "image/tiff", tiff_length),
    b"MM\0*": (0, "image/tiff", tiff_length),
    b"\x1f\x8b": (0, "application/gzip", gzip_length),
    b"ftyp": (4, "video/mp4", mp4_length),
    b"OggS": (0, "application/ogg", ogg_length),
    b"fLaC": (0, "audio/flac", flac_length),
    b"ID3": (0, "audio/mpeg", mp3_length),
    b"%PDF-": (0, "application/pdf", None),
    b"PK\x03\x04": (0, "application/zip", None),
}
ENDS: dict[bytes, tuple[str, Callable[[bytes, list[int]], dict[int, int]]]] = {b"%%EOF": ("application/pdf", pdf_ends), b"PK\x05\x06": ("application/zip", zip_ends)}
RIFF = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}
UNKNOWN = "application/octet-stream"
_MACHINE: list[ahocorasick.Automaton] = []


def found(media: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the valid items, none inside another."""
    if not _MACHINE:
        machine = ahocorasick.Automaton()
        for magic in (*FORMATS, *ENDS):
            machine.add_word(magic.decode("latin-1"), magic)
        machine.make_automaton()
        _MACHINE.append(machine)
    hits, marks = [], {}
    for end, magic in _MACHINE[0].iter(media.decode("latin-1")):
        at = end + 1 - len(magic)
        if magic in ENDS:
            marks.setdefault(magic, []).append(at)
        elif at >= FORMATS[magic][0]:
            hits.append((at - FORMATS[magic][0], magic))
    ends = {ENDS[magic][0]: ENDS[magic][1](media, places) for magic, places in marks.items()}
    out, free = [], 0
    for at, magic in sorted(hits, key=lambda x: x[0]):
        _, kind, length_of = FORMATS[magic]
        if at < free:
            continue
        n = length_of(media, at) if length_of else ends.get(kind, {}).get(at, at) - at
        if n:
            out.append((at, n, RIFF[media[at + 8 : at + 12]] if kind == "riff" else kind))
            free = at + n
    return out


def sniff(media: bytes | None) -> tuple[str | None, int, list[tuple[int, int, str]]]:
    """The type that the bytes prove, its length, and the items carved out behind it."""
    if media is None:
        return None, 0, []
    items = found(media)
    if items and items[0][0] == 0:
        return items[0][2], items[0][1], items[1:]
    return UNKNOWN, 0, items


def sniff_columns(df: DataFrame, id_col: str, media_col: str, declared_col: str) -> DataFrame:
    """id, declared_type, media_type, corrected, media_length and the carved items (offset, length, type, media) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("media", pa.binary())]))
        for b in slices(batches, 64):
            media, declared = b.column("media").to_pylist(), b.column("declared").to_pylist()
            got = [sniff(m) for m in media]
            carved = [[{"offset": o, "length": n, "type": t, "media": m[o : o + n]} for o, n, t in g[2]] for g, m in zip(got, media)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("declared"), pa.array([g[0] for g in got], pa.string()), pa.array([g[0] is not None and g[0] != d for g, d in zip(got, declared)]), pa.array([g[1] for g in got], pa.int64()), pa.array(carved, item)],
                ["id", "declared_type", "media_type", "corrected", "media_length", "carved"],
            )

    kind = dict(df.dtypes)[id_col]
    source = df.selectExpr(f"`{id_col}` AS id", f"CAST(`{media_col}` AS binary) AS media", f"CAST(`{declared_col}` AS string) AS declared")
    return source.mapInArrow(run, f"id {kind}, declared_type string, media_type string, corrected boolean, media_length long, carved array<struct<offset: long, length: long, type: string, media: binary>>")


# ---------------------------------------------------------------- lossless payloads


def png_of(payload: bytes) -> bytes:
    """An 8-bit RGB image, WIDTH pixels wide, whose samples are the payload, a multiple of UNIT bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    raw = np.zeros((len(rows), UNIT + 1), np.uint8)
    raw[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def samples_of(media: bytes) -> np.ndarray:
    """The (rows, UNIT) samples of an unfiltered 8-bit RGB image."""
    width, height = struct.unpack_from(">II", media, 16)
    data, i = [], 8
    while i < len(media):
        (n,), kind = struct.unpack_from(">I", media, i), media[i + 4 : i + 8]
        if kind == b"IDAT":
            data.append(media[i + 8 : i + 8 + n])
        i += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 3 * width + 1)
    if raw[:, 0].any():
        raise ValueError("a filtered image")
    return raw[:, 1:]


def feature(kind: str, samples: np.ndarray, carved: int) -> str:
    """Type, size, mean of each channel and a 64-bit difference hash of the 8 by 9 grid of mean samples."""
    total = samples.reshape(-1, 3).mean(0)
    rows = np.array_split(samples, 8) if len(samples) >= 8 else [samples] * 8
    grid = np.array([[c.mean() for c in np.array_split(r.mean(0), 9)] for r in rows])
    bits = int("".join("01"[int(x)] for x in (grid[:, 1:] > grid[:, :-1]).reshape(-1)), 2)
    return f"{kind};{samples.shape[1] // 3}x{len(samples)};rgb8;mean={total[0]:.3f},{total[1]:.3f},{total[2]:.3f};dhash={bits:016x};carved={carved}"


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media, declared: each text as a payload in its container, declared as unknown bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            media = [png_of(payload_of(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(media, pa.binary()), pa.array([UNKNOWN] * len(media))], ["doc_id", "media", "declared"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, media binary, declared string")


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores, sniffs and reads back in one pass, so that the media never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                media = png_of(payload_of(text))
                kind, _, carved = sniff(media)
                samples = samples_of(media)
                back = samples.tobytes()
                rows.append((doc, len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(kind, samples, len(carved)), UNKNOWN, kind))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared_type", "media_type"])

    return keyed(spark.read.parquet(f"{sf_dir}/documents.parquet")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared_type string, media_type string")
