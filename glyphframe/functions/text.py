"""Text and decoding as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .geometry import let
from .kernels import visual_to_logical


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, for which Spark has no function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def inverse_bidi(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else visual_to_logical(t))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def filename_of(original: Column) -> Column:
    """The standard path of a model package's resource: by its role and profile, whatever folder or checkpoint it came from."""
    path = F.translate(original, "\\", "/")

    def named(all_: Column) -> Column:
        cut = F.array_position(F.transform(all_, F.lower), F.lit(MODEL_FOLDER)).cast("int")
        return let(F.when((cut > 0) & (cut < F.size(all_)), F.slice(all_, cut + 1, F.size(all_))).otherwise(all_), by_role)

    def by_role(parts: Column) -> Column:
        model, role, profile = F.lower(path).endswith(".onnx"), F.lower(F.get(parts, F.lit(0))), slug(F.get(parts, F.lit(1)))
        file = F.lower(F.element_at(parts, -1))
        table = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), file if d is RECOGNITION_FILES else role)
        plain = F.concat(F.when(model, "models/").otherwise("data/"), slug(F.element_at(F.split(path, "/"), -1)))
        long = F.size(parts) >= 2
        return (
            F.when(long & model & table(MODEL_ROLES).isNotNull(), F.concat(F.lit("models/"), table(MODEL_ROLES), F.lit("/"), profile, F.lit(".onnx")))
            .when(long & model & (role == "auxmltcls"), "models/classification/script_orientation.onnx")
            .when(long & ~model & (role == "character"), F.concat(F.lit("data/recognition/"), profile, F.lit("/"), F.coalesce(table(RECOGNITION_FILES), slug(file))))
            .when(long & ~model & (role == "detector") & (file == "checkbox_cal.txt"), F.concat(F.lit("data/detection/"), profile, F.lit("/checkbox_calibration.txt")))
            .when(long & ~model & (role == "auxmltcls") & (file == "handwritten_calibration_map.txt"), "data/classification/handwriting_calibration.txt")
            .when(long & ~model & (role == "enums"), F.concat(F.lit("data/enums/"), slug(file)))
            .otherwise(plain)
        )

    return let(F.split(path, "/"), named)


#: Fixed names of the package layout: the folder that holds the roles, roles of models, files of a recogniser.
MODEL_FOLDER = "model_edge"
MODEL_ROLES = {"detector": "detection", "character": "recognition", "rejection": "rejection", "confidence": "confidence", "linelayout": "layout"}
RECOGNITION_FILES = {"char2ind.txt": "alphabet.txt", "char2inschar.txt": "character_mapping.txt", "composite_chars_map": "composite_characters.txt", "rnn.info": "rnn.info"}


def slug(name: Column) -> Column:
    """A lower-case file name: words divided by underscores."""
    out = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    out = F.regexp_replace(out, "([a-z0-9])([A-Z])", "$1_$2")
    out = F.regexp_replace(F.regexp_replace(F.lower(out), "[^a-z0-9._-]+", "_"), "^[_.-]+|[_.-]+$", "")
    return F.when(out == "", "resource").otherwise(out)


#: Regular expressions of the character classes.
CLASS_PATTERNS = {"han": r"\p{IsHan}", "kana": r"[\p{IsHiragana}\p{IsKatakana}ーｰ]", "hangul": r"\p{IsHangul}", "latin": r"\p{IsLatin}", "digits": r"\p{Nd}"}
#: Characters that no class mask removes.
NEUTRAL = r"[\s\p{P}\p{S}\p{M}\p{Z}]"


def class_count(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(CLASS_PATTERNS[kind]))


def allowed(token: Column, composite: Column, classes: list[str]) -> Column:
    """Whether a token passes the mask of enabled classes; bracketed tokens always do, composites by what they stand for."""
    unknown = set(classes) - set(CLASS_PATTERNS)
    if unknown or len(set(classes)) != len(classes):
        raise ValueError(f"unknown or repeated character class: {sorted(unknown) or classes}")
    text = F.coalesce(composite, token)
    rest = F.regexp_replace(text, "|".join([NEUTRAL, *(CLASS_PATTERNS[c] for c in classes)]), "")
    return token.rlike("^<.*>$") | (rest == "")


def rendered(token: Column, composite: Column) -> Column:
    """What a token prints: a space for the two space tokens, else its composite or itself; other bracketed tokens are errors."""
    special = token.isin("<space>", "<trash_as_space>")
    return F.when(special, " ").when(token.rlike("^<.+>$"), F.raise_error(F.concat(F.lit("unsupported token "), token))).otherwise(F.coalesce(composite, token))


def error_code(kind: Column, message: Column) -> Column:
    """The batch error code of a failure; kind: deadline, canceled, closed, path or null for others."""
    has = lambda *xs: F.greatest(*[F.contains(message, F.lit(x)) for x in xs]) if len(xs) > 1 else F.contains(message, F.lit(xs[0]))
    return (
        F.when(kind == "deadline", "timeout")
        .when(kind == "canceled", "canceled")
        .when(kind == "closed", "closed")
        .when((kind == "path") | has("invalid", "empty input", "unknown script", "unknown format") | message.startswith("image:"), "invalid_input")
        .when(has("unsupported", "unavailable script"), "unsupported")
        .otherwise("inference")
    )


# ---------------------------------------------------------------- decoding of scores, as arrays of a row


def argmax(values: Column) -> Column:
    """Index from 0 of the largest value, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def masked_argmax(values: Column, allow: Column) -> Column:
    """As argmax over the allowed indices; a value that is not finite is an error, allowed or not."""
    bad = F.exists(values, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    masked = F.zip_with(values, allow, lambda v, a: F.when(a, v).otherwise(F.lit(float("-inf"))))
    return F.when(bad, F.raise_error(F.lit("nonfinite scores")).cast("int")).otherwise(argmax(masked))


def log_probability(values: Column, index: Column) -> Column:
    """Log-softmax of one index over all values."""
    top = F.array_max(values)
    return F.element_at(values, index + 1) - top - F.ln(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def ctc_keep(ids: Column, blank: Column | int) -> Column:
    """Positions from 0 of the emitted frames: those unlike the frame before (blank or not) that are not blank."""

    def places(own: Column) -> Column:
        at = F.when(F.size(own) > 0, F.sequence(F.lit(0), F.size(own) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(at, lambda i: (F.get(own, i) != blank) & ((i == 0) | (F.get(own, i) != F.get(own, i - 1))))

    return let(ids, places)


def trimmed_places(places: Column, is_space: Column) -> Column:
    """Emissions without the white space at their ends; is_space: by frame."""

    def within(s: Column) -> Column:
        solid = F.filter(s["places"], lambda i: ~F.get(s["space"], i))
        ends = F.struct(F.array_min(solid).alias("lo"), F.array_max(solid).alias("hi"))
        return let(ends, lambda e: F.filter(s["places"], lambda i: (i >= e["lo"]) & (i <= e["hi"])))

    return let(F.struct(places.alias("places"), is_space.alias("space")), within)


def confidence(log_sum: Column, tokens: Column) -> Column:
    """exp of the mean log probability; null without tokens."""
    return F.when(tokens > 0, F.exp(log_sum / tokens))


def numeric_consensus(a: Column, a_confidence: Column, b: Column, b_confidence: Column) -> Column:
    """Two readings agree on one to three ASCII digits, with confidence .90 and .50 at least."""
    return F.coalesce(a.rlike("^[0-9]{1,3}$") & (a == b) & (a_confidence >= 0.9) & (b_confidence >= 0.5), F.lit(False))


def flips(flip: Column, compact: Column) -> Column:
    return (flip < 0) & (~compact | (F.abs(flip) >= 2))


def is_anchor(compact: Column, flip: Column, text: Column, conf: Column) -> Column:
    return F.coalesce(~compact & (F.abs(flip) >= 2) & (F.char_length(text) >= 3) & (conf >= 0.8), F.lit(False))
