"""Reading images, lists, annotations and packages; writing results."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import decode_png, exif_orientation, from_buffer, orient, over_white, rectify, rotate_quarter
from ..functions.text import trimmed

MOST_BYTES, MOST_PIXELS = 128 << 20, 40_000_000


def encoded_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content, error): encoded images; a file over the limit has no content but an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    large = F.col("length") > MOST_BYTES
    return files.select("path", F.when(~large, F.col("content")).alias("content"), F.when(large, "invalid input: over 128 MiB").alias("error"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, data as RGB rows, error) decoded by the JVM and turned upright by the files' EXIF orientation; what
    cannot be decoded, or is smaller than 2 x 2 or over 40 megapixels, has an error."""
    raw = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    wrong = F.when(F.col("width") < 0, "image: cannot be decoded").when((F.col("width") < 2) | (F.col("height") < 2) | (F.col("width").cast("long") * F.col("height") > MOST_PIXELS), "image: invalid size")

    @F.pandas_udf("int")
    def turn(content: pd.Series) -> pd.Series:
        return content.map(exif_orientation).astype("int32")

    # the orientation stands in the first 64 KiB; the bytes go no further than this column
    files = spark.read.format("binaryFile").load(path).select(plain_path("path").alias("file"), turn(F.substring("content", 1, 1 << 16)).alias("turn"))

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series, width: pd.Series, turns: pd.Series) -> pd.Series:
        out = []
        for d, n, w, t in zip(data, channels, width, turns):
            if w < 1:  # not decoded: the condition around this function does not spare it the row
                out.append(None)
                continue
            a = np.frombuffer(d, np.uint8).reshape(-1, w, n)
            a = np.repeat(a, 3, 2) if n == 1 else a[..., ::-1] if n == 3 else over_white(a[..., [2, 1, 0, 3]])
            out.append(orient(a, t).tobytes())
        return pd.Series(out)

    good = raw.withColumn("error", wrong).join(files, plain_path("origin") == F.col("file"), "left").withColumn("turn", F.coalesce("turn", F.lit(1)))
    ok, side = F.col("error").isNull(), F.col("turn") >= 5
    size = [F.when(ok & side, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("width", "height"), ("height", "width"))]
    return good.select(F.col("origin").alias("path"), *size, F.when(ok, rgb("data", "nChannels", "width", "turn")).alias("data"), "error")


def plain_path(column: str):
    """file:/a and file:///a alike."""
    return F.regexp_replace(column, "^([a-z0-9]+:)/+", "$1/")


RASTER_SCHEMA = "width int, height int, data binary, error struct<code: string, message: string>"


def decoded(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, width, height, data as RGB rows, error) of encoded images in a column: PNG, of which Python alone can decode. A
    value that is null, too large or not such an image has an error; see images() for files of other formats."""

    def one(data: bytes | None) -> np.ndarray:
        if data is None or not len(data):
            raise ValueError("empty input")
        if len(data) > MOST_BYTES:
            raise ValueError("invalid input: over 128 MiB")
        return decode_png(bytes(data))

    return _rasters(rows.select(F.col(key).alias("key"), F.col(content).alias("content")), key, lambda r: one(r["content"]))


def raw_pixels(rows: DataFrame, key: str, premultiplied: bool = False) -> DataFrame:
    """(key, width, height, data as RGB rows, error) of pixel buffers: data, width, height, stride, format (RGB, RGBA, BGRA,
    RGBX, BGRX); alpha is laid on white."""

    def one(r: dict) -> np.ndarray:
        if r["data"] is None:
            raise ValueError("empty input")
        return from_buffer(bytes(r["data"]), r["width"], r["height"], r["stride"], r["format"], premultiplied)

    return _rasters(rows.select(F.col(key).alias("key"), "data", "width", "height", "stride", "format"), key, one)


def _rasters(rows: DataFrame, key: str, one) -> DataFrame:
    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                try:
                    a = one(r)
                    out.append((r["key"], a.shape[1], a.shape[0], a.tobytes(), None))
                except (ValueError, KeyError, zlib.error, struct.error) as e:
                    code = "unsupported" if "unsupported" in str(e) else "invalid_input"
                    out.append((r["key"], None, None, None, {"code": code, "message": str(e)}))
            yield pd.DataFrame(out, columns=["key", "width", "height", "data", "error"]).astype({"width": "Int32", "height": "Int32"})

    kind = dict(rows.dtypes)["key"]
    return rows.mapInPandas(run, f"key {kind}, {RASTER_SCHEMA}").withColumnRenamed("key", key)


def crops(regions: DataFrame, quad: str = "quad") -> DataFrame:
    """regions (width, height, data, corners, column_read, quarter, compact, prior) with crop_width, crop_height and crop: the
    region's pixels, upright, for a model."""

    @F.pandas_udf("struct<crop_width: int, crop_height: int, crop: binary>")
    def cut(data: pd.Series, width: pd.Series, height: pd.Series, flat: pd.Series, column: pd.Series, turn: pd.Series) -> pd.DataFrame:
        out = []
        for d, w, h, q, c, t in zip(data, width, height, flat, column, turn):
            a = rotate_quarter(rectify(np.frombuffer(d, np.uint8).reshape(h, w, 3), np.asarray(q).reshape(4, 2), bool(c)), int(t))
            out.append((a.shape[1], a.shape[0], a.tobytes()))
        return pd.DataFrame(out, columns=["crop_width", "crop_height", "crop"])

    flat = F.flatten(F.transform(quad, lambda p: F.array(p["x"], p["y"])))
    turned = F.when(F.col("compact") & F.col("prior").isNotNull(), F.col("quarter")).otherwise(0)
    return regions.withColumn("__cut", cut("data", "width", "height", flat, "column_read", turned)).select("*", "__cut.*").drop("__cut")


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """(path): the trimmed lines that are not blank."""
    return spark.read.text(path).select(trimmed(F.col("value")).alias("path")).where("path <> ''")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, text string, script string, source string, derived boolean").json(path, multiLine=True)


def bundle_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of a folder's files, relative to it; hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_json(results: DataFrame, path: str) -> None:
    results.write.option("ignoreNullFields", "false").json(path)


def write_text(results: DataFrame, path: str) -> None:
    results.select("text").write.text(path)


def write_new(results: DataFrame, path: str) -> None:
    """Never over what exists."""
    results.write.mode("errorifexists").json(path)
