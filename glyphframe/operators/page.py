"""From recognised lines to page results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import SCRIPTS


def summary(lines: DataFrame, page: str, least: float = 0.0) -> DataFrame:
    """(page, lines, filtered, confidence) over lines with text, log_sum and tokens. Lines without text do not count; with
    least > 0, lines below that confidence, or without one, are filtered and leave the page's confidence, which pools the
    tokens of the others."""
    own = X.confidence(F.col("log_sum"), F.col("tokens"))
    stays = F.lit(True) if least <= 0 else F.coalesce(own >= least, F.lit(False))
    kept = lines.where((F.col("text") != "") & F.col("text").isNotNull()).withColumn("stays", stays)
    sums = kept.groupBy(page).agg(
        F.count_if("stays").alias("lines"), F.count_if(~F.col("stays")).alias("filtered"), F.sum(F.when(F.col("stays"), F.col("log_sum"))).alias("s"), F.sum(F.when(F.col("stays"), F.col("tokens"))).alias("n")
    )
    return sums.select(page, "lines", "filtered", X.confidence(F.col("s"), F.col("n")).alias("confidence"))


def warnings(skipped: Column, filtered: Column, least: float) -> Column:
    """The page's warnings; skipped: map of script to skipped lines. They come in the order of the scripts."""
    one = lambda s: F.when(F.element_at(skipped, F.lit(s)) > 0, F.concat(F.lit("Skipped "), F.element_at(skipped, F.lit(s)).cast("string"), F.lit(f" line(s) classified as {s}: recognizer not included in this model package.")))
    below = F.when(filtered > 0, F.concat(F.lit("Filtered "), filtered.cast("string"), F.lit(f" line(s) below min_line_confidence {least:.3f}.")))
    return F.array_compact(F.array(*[one(s) for s in SCRIPTS], below))


def displayed(lines: DataFrame, confidence: Column, score: Column, least: float = 0.7) -> DataFrame:
    """The lines that a rendering shows."""
    return lines.where((confidence >= least) & (score >= least))


def checked_options(script: str = "", reading_order: str = "auto", min_line_confidence: float = 0.0) -> dict:
    """Options as given, or an error that names the wrong one."""
    if script and script not in SCRIPTS:
        raise ValueError("unknown script")
    if reading_order not in ("", "auto", "ltr", "rtl", "none"):
        raise ValueError("invalid reading order")
    if not 0 <= min_line_confidence <= 1:
        raise ValueError("invalid min_line_confidence")
    return {"script": script, "reading_order": reading_order or "auto", "min_line_confidence": min_line_confidence}


def checked_config(threads: int = 2, max_side: int = 1600, max_inflight: int = 1) -> dict[str, int]:
    """Engine limits, or an error: threads for a model's session, the detector's longest side (detect()), and how many files a
    streaming trigger takes in for each worker (streaming.requests)."""
    if not 1 <= threads <= 16 or not 128 <= max_side <= 4096 or not 1 <= max_inflight <= 4:
        raise ValueError("invalid configuration")
    return {"threads": threads, "max_side": max_side, "files_per_trigger": 2 * max_inflight}
