"""Page orientation and the routing of regions to recognisers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def page_orientation(lines: DataFrame, page: str, angle: Column, chars: Column, anchor: Column, steady: float = 0.9) -> DataFrame:
    """(page, page_angle): the mean direction of the anchors, weighted by up to 20 characters; null if they disagree. Partial
    sums, so one shuffle of a row a page and task."""
    w = F.when(anchor, F.least(F.lit(20), chars)).otherwise(0).cast("double")
    sums = lines.groupBy(page).agg(F.sum(w * F.cos(angle)).alias("c"), F.sum(w * F.sin(angle)).alias("s"), F.sum(w).alias("w"))
    ok = (F.col("w") > 0) & (F.hypot("c", "s") / F.col("w") >= steady)
    return sums.select(page, F.when(ok, F.atan2("s", "c")).alias("page_angle"))


def with_page(regions: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """The page's aggregate beside each of its regions."""
    return regions.join(pages, page, "left")


def uses_vertical(vertical: Column, aspect: Column, prior: Column) -> Column:
    """Whether a region is read as a column; prior: the page angle, if any."""
    compact = aspect <= 2
    return vertical & (~compact | (prior.isNull() & (aspect > 1.5)))


def quarter(vertical_read: Column, width: Column, height: Column, compact: Column, prior: Column, region_angle: Column, flipped: Column) -> Column:
    """Quarter turns applied to a region before it is read."""
    side = lambda v: F.greatest(F.lit(2.0), F.rint(v))
    base = F.when(compact & prior.isNotNull(), G.turns(prior, region_angle)).when(vertical_read & (side(height) > side(width)), 1).otherwise(0)
    return F.pmod(base + F.when(flipped, 2).otherwise(0), F.lit(4)).cast("int")


def region_direction(region_angle: Column, quarters: Column) -> Column:
    return region_angle + quarters * (math.pi / 2)


def tries_numeral(script: Column, compact: Column, score: Column, least: float = 0.8) -> Column:
    """Regions without a script that may be short numerals. Filter by this before any recogniser runs: a scorer in a
    conditional would see every row."""
    return (script == "") & compact & (score >= least)


def available(regions: DataFrame, recognisers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions whose script has a recogniser, and how many of each other script are skipped. recognisers: script; a row each
    of a fixed list, so it is broadcast."""
    names = F.broadcast(recognisers.select("script").distinct())
    skipped = regions.where("script <> ''").join(names, "script", "left_anti").groupBy("script").agg(F.count("*").alias("skipped"))
    return regions.join(names, "script", "left_semi"), skipped


def nearest_cell(lines: DataFrame, x: Column, y: Column, centers: list[float], origin: float, step: float) -> DataFrame:
    """lines with row and column of the table cell whose centre is nearest (of equals the first)."""
    far = F.array(*[F.abs(x - c) for c in centers])
    return lines.withColumns({"row": F.rint((y - origin) / step).cast("int"), "column": (F.array_position(far, F.array_min(far)) - 1).cast("int")})
