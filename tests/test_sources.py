import base64
import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from glyphframe.sources import packages as P
from glyphframe.sources import readers as R
from glyphframe.streaming import requests as S
from pyspark.sql import functions as F

PNG = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAIAAAACCAIAAAD91JpzAAAAEElEQVR4nGP4z8AARAwQCgAf7gP9i18U1AAAAABJRU5ErkJggg==")


def test_lists_and_bundles(spark, tmp_path):
    (tmp_path / "list.txt").write_text(" a.png \n\n\tb.png\t\n\u3000\nc.png\u3000\n")
    assert [r.path for r in R.path_list(spark, str(tmp_path / "list.txt")).collect()] == ["a.png", "b.png", "c.png"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.bin").write_bytes(b"abc")
    r = R.bundle_files(spark, str(tmp_path / "b")).first()
    assert (r.path, r["size"], r.sha256[:8]) == ("x.bin", 3, "ba7816bf")


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(PNG)
    (tmp_path / "bad.png").write_bytes(b"no image")
    got = {r.path.rpartition("/")[2]: r for r in R.images(spark, str(tmp_path)).collect()}
    assert got["a.png"].error is None and (got["a.png"].width, len(got["a.png"].data)) == (2, 12)
    assert got["bad.png"].error == "image: cannot be decoded"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("a\n\nbad\na\n")

    def operation(df):
        return df.withColumns({"result": F.when(F.col("path") != "bad", F.upper("path")), "error": F.when(F.col("path") == "bad", "invalid_input")})

    out = S.responses(S.requests(spark, str(tmp_path / "in")), operation)
    S.write(out, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(60)
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert len(lines) == 3 and sorted(json.loads(x)["id"] for x in lines) == [1, 2, 3] and sum('"result":"A"' in x for x in lines) == 2 and sum('"error":"invalid_input"' in x for x in lines) == 1


def png(width, height, colour, bits, raw, extra=b""):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_encoded_columns(spark):
    rng = np.random.default_rng(1)
    want = rng.integers(0, 256, (5, 4, 3), dtype=np.uint8)
    raw, above = b"", np.zeros(12, int)
    for kind, line in enumerate(want.reshape(5, 12).astype(int)):  # one row by each filter
        left, corner = np.concatenate(([0] * 3, line[:-3])), np.concatenate(([0] * 3, above[:-3]))
        paeth = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, above, corner)]
        guess = [0 * line, left, above, (left + above) // 2, np.array(paeth)][kind]
        raw, above = raw + bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes(), line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    palette = png(3, 2, 3, 2, bytes([0, 0b00011000, 0, 0b01010100]), chunk(b"PLTE", bytes([255, 0, 0, 0, 255, 0, 0, 0, 255])) + chunk(b"tRNS", bytes([0])))
    grey = png(2, 2, 0, 1, bytes([0, 0b10000000, 0, 0b01000000]))
    rows = [(1, bytearray(png(4, 5, 2, 8, raw))), (2, bytearray(palette)), (3, bytearray(grey)), (4, bytearray(b"GIF89a")), (5, None), (6, bytearray(png(1, 5, 2, 8, raw)))]
    got = {r.id: r for r in R.decoded(spark.createDataFrame(rows, "id int, bytes binary"), "id", "bytes").collect()}
    assert (got[1].width, got[1].height, bytes(got[1].data)) == (4, 5, want.tobytes()) and got[1].error is None
    assert list(got[2].data[:9]) == [255, 255, 255, 0, 255, 0, 0, 0, 255] and list(got[3].data[::3]) == [255, 0, 0, 255]
    assert [got[k].error.code for k in (4, 5, 6)] == ["invalid_input"] * 3 and got[4].data is None
    raws = spark.createDataFrame([(1, bytearray([3, 2, 1, 255] * 4), 2, 2, 8, "BGRA"), (2, bytearray(3), 2, 2, 8, "RGB")], "id int, data binary, width int, height int, stride int, format string")
    got = {r.id: r for r in R.raw_pixels(raws, "id").collect()}
    assert list(got[1].data) == [1, 2, 3] * 4 and got[2].error.code == "invalid_input"


def test_upright_images(spark, tmp_path):
    # a JPEG by the JVM's own writer, with an orientation put in
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(6, 4, 1)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / "plain.jpg")))
    data = (tmp_path / "plain.jpg").read_bytes()
    tiff = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 1) + struct.pack(">HHIHH", 0x112, 3, 1, 6, 0)
    body = b"Exif\0\0" + tiff
    (tmp_path / "turned.jpg").write_bytes(data[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + data[2:])
    got = {r.path.rpartition("/")[2]: r for r in R.images(spark, str(tmp_path)).collect()}
    assert (got["plain.jpg"].width, got["plain.jpg"].height) == (6, 4) and (got["turned.jpg"].width, got["turned.jpg"].height) == (4, 6)
    assert len(got["turned.jpg"].data) == 72


def test_crops(spark):
    pixels = np.arange(8 * 6 * 3, dtype=np.uint8).reshape(6, 8, 3)
    quad = [{"x": float(x), "y": float(y)} for x, y in ((1, 1), (5, 1), (5, 3), (1, 3))]
    rows = spark.createDataFrame([(1, bytearray(pixels.tobytes()), 8, 6, quad, False, 2, True, 0.0)], "id int, data binary, width int, height int, quad array<struct<x: double, y: double>>, column_read boolean, quarter int, compact boolean, prior double")
    r = R.crops(rows).first()
    assert (r.crop_width, r.crop_height) == (4, 2) and len(r.crop) == 24


MAGIC, SCHEMA = b"EXAMPLE1", "example.pack.v1"


def bundle(folder):
    def put(name, data):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
        return {"file": name, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}

    characters = [{"name": s, "script": s, "model_path": f"models/{s}.onnx", "alphabet_path": f"data/{s}.txt", "pixels_per_frame": 4} for s in ("CJK", "Latin", "Thai")]
    names = ["models/d.onnx", "models/c.onnx", *(c[k] for c in characters for k in ("model_path", "alphabet_path"))]
    resources = [put(n, n.encode() * (i * 9)) | {"id": i, "kind": "model"} for i, n in enumerate(names)]
    pipeline = {"detector_path": names[0], "classifier_path": names[1], "characters": characters, "segment_threshold": 0.7, "line_thresholds": {"2": 0.8}}
    (folder / "bundle.json").write_text(json.dumps({"config": put("config.bin", b"c"), "resources": resources, "pipeline": pipeline}))


def test_packages(spark, tmp_path):
    (tmp_path / "b").mkdir()
    bundle(tmp_path / "b")
    target = str(tmp_path / "m.pack")
    index = P.pack(str(tmp_path / "b"), target, MAGIC, SCHEMA)
    assert [c["script"] for c in index["bundle"]["pipeline"]["characters"]] == ["CJK", "Latin"]
    rows = P.entries(spark, target, MAGIC, SCHEMA).collect()
    assert [r.file for r in rows] == sorted(r.file for r in rows) and all(r.offset % 64 == 0 for r in rows) and len(rows) == 8
    assert P.resource(target, MAGIC, SCHEMA, "data/CJK.txt") == b"data/CJK.txt" * 27
    with pytest.raises(FileExistsError):
        P.pack(str(tmp_path / "b"), target, MAGIC, SCHEMA)
    P.unpack(target, str(tmp_path / "u"), MAGIC, SCHEMA)
    assert P.read_bundle(str(tmp_path / "u"))["resources"] == index["bundle"]["resources"]
    P.pack(str(tmp_path / "u"), str(tmp_path / "again.pack"), MAGIC, SCHEMA)
    data = (tmp_path / "m.pack").read_bytes()
    assert (tmp_path / "again.pack").read_bytes() == data
    last = bytearray(data)
    last[-1] ^= 1
    for bad in (data[:63], b"X" + data[1:], data[:8] + b"\2" + data[9:], data[:70] + b" " + data[71:], bytes(last), data + b"\0"):
        (tmp_path / "bad.pack").write_bytes(bad)
        with pytest.raises(ValueError):
            P.open_package(str(tmp_path / "bad.pack"), MAGIC, SCHEMA)
    (tmp_path / "u" / "config.bin").write_bytes(b"d")
    with pytest.raises(ValueError):
        P.read_bundle(str(tmp_path / "u"))


def test_alphabets(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a 0\n<space> 1\n  2\n\U000f0000 3\n<blank> 4\n")
    (tmp_path / "c.txt").write_text("// pairs\n\n\U000f0000 e\u0301\n")
    got = P.alphabet(spark, str(tmp_path / "a.txt"), str(tmp_path / "c.txt")).orderBy("id").collect()
    assert [r.token for r in got] == ["a", "<space>", " ", "\U000f0000", "<blank>"] and got[3].composite == "e\u0301" and [r.id for r in got if r.is_blank] == [4]
    for bad in ("a 0\nb 0\n<blank> 1\n", "a 0\n<blank> 2\n", "a 0\n", "a 0\n<blank> 1\n<blank> 2\n", "a x\n<blank> 1\n", "a 0\n\n<blank> 1\n"):
        (tmp_path / "bad.txt").write_text(bad)
        with pytest.raises(ValueError):
            P.alphabet(spark, str(tmp_path / "bad.txt"))
