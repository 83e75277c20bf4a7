"""Reading order, gaps and page text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.kernels import reading_order


def layout_angle(lines: DataFrame, page: str, angle: Column) -> DataFrame:
    """(page, layout_angle): the plain circular mean of the lines' directions."""
    return lines.groupBy(page).agg(F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle))).alias("layout_angle"))


def levelled(quad: Column, angle: Column) -> Column:
    return F.transform(quad, lambda p: G.rotated(p, angle))


def gaps(boxes: DataFrame, page: str, low: str, size: str, ties: tuple[str, ...]) -> DataFrame:
    """Each box's gap to the furthest edge before it in the order of low edges; null for a page's first."""
    w = W.partitionBy(page).orderBy(low, *ties).rowsBetween(W.unboundedPreceding, -1)
    return boxes.withColumn("gap", F.col(low) - F.max(F.col(low) + F.col(size)).over(w))


def is_rtl(lines: DataFrame, page: str, script: str = "script") -> DataFrame:
    """(page, rtl): whether more than half of the lines are in a right-to-left script."""
    return lines.groupBy(page).agg((2 * F.count_if(F.col(script).isin("Arabic", "Hebrew")) > F.count("*")).alias("rtl"))


def in_reading_order(boxes: DataFrame, page: str, key: str, rtl: str | None = None) -> DataFrame:
    """(page, key, position): recursive cuts need a page's boxes together, as arrays of one row; pages are bounded by the
    region limit."""
    @F.pandas_udf("array<int>")
    def order(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, turn: pd.Series) -> pd.Series:
        return pd.Series([np.array(reading_order(np.column_stack([a, b, a + c, b + d]), bool(t)), np.int32) for a, b, c, d, t in zip(x, y, w, h, turn)])

    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), "x", "y", "width", "height")))
    pages = boxes.groupBy(page).agg(rows.alias("rows"), F.max(F.col(rtl) if rtl else F.lit(False)).alias("turn"))
    field = lambda c: F.transform("rows", lambda r: r[c].cast("double"))
    pages = pages.select(page, F.transform("rows", lambda r: r["k"]).alias("ks"), order(field("x"), field("y"), field("width"), field("height"), F.col("turn")).alias("order"))
    return pages.select(page, "ks", F.posexplode("order").alias("position", "at")).select(page, F.get("ks", F.col("at")).alias(key), "position")


def page_text(lines: DataFrame, page: str, position: str, text: str) -> DataFrame:
    """(page, text): the lines joined in order by line ends."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t"))))
    return lines.groupBy(page).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "\n").alias("text"))
