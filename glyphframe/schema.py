"""The document-recognition data model as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
QUAD = T.ArrayType(POINT)
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "width", "height")])
WORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("quad", QUAD), T.StructField("confidence", T.DoubleType())])
LINE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("quad", QUAD),
        T.StructField("bbox", BOX),
        T.StructField("detection_score", T.DoubleType()),
        T.StructField("vertical", T.BooleanType()),
        T.StructField("rotated_180", T.BooleanType()),
        T.StructField("rotation_degrees", T.IntegerType()),
        T.StructField("script", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("words", T.ArrayType(WORD)),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("confidence", T.DoubleType()),
        T.StructField("confidence_method", T.StringType()),
        T.StructField("coordinate_space", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("lines", T.ArrayType(LINE)),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("elapsed_seconds", T.DoubleType()),
        T.StructField("model_sha256", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)
DETECTION = T.StructType([T.StructField("quad", QUAD), T.StructField("bbox", BOX), T.StructField("score", T.DoubleType()), T.StructField("vertical", T.BooleanType())])
DETECTIONS = T.StructType([T.StructField("coordinate_space", T.StringType()), T.StructField("regions", T.ArrayType(DETECTION)), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("elapsed_seconds", T.DoubleType()), T.StructField("model_sha256", T.StringType())])
ERROR = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType())])
BATCH_ITEM = T.StructType([T.StructField("index", T.LongType()), T.StructField("result", PAGE), T.StructField("error", ERROR)])
RASTER = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("data", T.BinaryType())])
TENSOR = T.StructType([T.StructField("shape", T.ArrayType(T.LongType())), T.StructField("data", T.ArrayType(T.FloatType()))])

# Fixed values of the recognition contract.
SCRIPTS = ["Latin", "CJK", "Cyrillic", "Arabic", "Devanagari", "Greek", "Thai", "Hebrew", "Tamil"]
CONFIDENCE_METHOD, COORDINATE_SPACE = "ctc_token_geometric_mean", "oriented_image"
STANDING_WARNING = "Experimental final quad fitting, normalization and reading order; original rejection/calibration are not applied."
PROFILES = {"cjk-en": ["CJK", "Latin"], "extended": ["CJK", "Latin", "Cyrillic", "Arabic"]}
CLASSIFIER_CHANNELS = ["", "CJK", "Latin", "Cyrillic", "Arabic", "Devanagari", "Greek", "Thai", "Hebrew", "Tamil"]
READING_ORDERS = ["auto", "ltr", "rtl", "none"]
CHARACTER_CLASSES = ["han", "kana", "hangul", "latin", "digits"]
ERROR_CODES = ["timeout", "canceled", "closed", "invalid_input", "unsupported", "inference"]
SEGMENT_THRESHOLD, LINE_THRESHOLD, LINK_THRESHOLD, OVERLAP, LEAST_AREA, MOST_REGIONS = 0.7, 0.8, 0.8, 0.2, 12.0, 1000
