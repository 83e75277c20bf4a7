"""From score maps to regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.kernels import area as polygon_area
from ..functions.kernels import keep_apart, link_groups, minimum_rectangle
from ..schema import LEAST_AREA, LINE_THRESHOLD, LINK_THRESHOLD, MOST_REGIONS, OVERLAP, SEGMENT_THRESHOLD

HEADS = [(level, direction) for level in (2, 3, 4) for direction in ("horizontal", "vertical")]


def cells(maps: DataFrame, key: str, scores: str, threshold: float = SEGMENT_THRESHOLD) -> DataFrame:
    """(key, cell, score) of the cells that reach the threshold; no shuffle."""
    return maps.select(key, F.posexplode(scores).alias("cell", "score")).where(F.col("score") >= threshold)


def groups(maps: DataFrame, key: str, columns: int, scores: str, links: str, threshold: float = SEGMENT_THRESHOLD, link: float = LINK_THRESHOLD) -> DataFrame:
    """(key, cell, score, group) of the cells over threshold, the group named by its smallest cell. A map is one row, so its
    groups need no shuffle. links: 8 arrays of the map's size one after the other, by neighbour."""
    kind = dict(maps.dtypes)[key]

    def run(batches):
        for pdf in batches:
            out = []
            for k, s, n in zip(pdf["k"], pdf["s"], pdf["n"]):
                score = np.asarray(s, float).reshape(-1, columns)
                label = link_groups(score, np.asarray(n, float).reshape(8, *score.shape), threshold, link).reshape(-1)
                own = np.flatnonzero(label >= 0)
                out.append(pd.DataFrame({"key": k, "cell": own.astype("int32"), "score": score.reshape(-1)[own], "group": label[own].astype("int32")}))
            yield pd.concat(out) if out else pd.DataFrame({"key": [], "cell": [], "score": [], "group": []})

    got = maps.select(F.col(key).alias("k"), F.col(scores).alias("s"), F.col(links).alias("n")).mapInPandas(run, f"key {kind}, cell int, score double, `group` int")
    return got.withColumnRenamed("key", key)


def head_regions(heads: DataFrame, page: str, threshold: float = SEGMENT_THRESHOLD, line_thresholds: dict[int, float] | None = None) -> DataFrame:
    """(page, level, direction, seq, score, quad in the scaled page) of the regions of detector heads; seq numbers a head's
    regions by their first cell. heads: page, level, direction, columns, scores, deltas and links (8 maps each, one after the
    other). Numbers that are not finite are an error. A head is one row and is decoded where it is read."""
    kind, least = dict(heads.dtypes)[page], line_thresholds or {}

    def run(batches):
        for pdf in batches:
            out = []
            for key, level, way, columns, s, d, n in zip(*(pdf[c] for c in ("page", "level", "direction", "columns", "scores", "deltas", "links"))):
                score = np.asarray(s, np.float32).reshape(-1, columns)
                delta = np.asarray(d, float).reshape(8, -1)
                label = link_groups(score, np.asarray(n, float).reshape(8, *score.shape), threshold).reshape(-1)
                own = np.flatnonzero(label >= 0)
                own = own[np.argsort(label[own], kind="stable")]
                stride, seq = 1 << level, 0
                for cell in np.split(own, np.flatnonzero(np.diff(label[own])) + 1) if len(own) else []:
                    mean = float(np.cumsum(score.reshape(-1)[cell])[-1] / np.float32(len(cell)))
                    if mean < least.get(level, LINE_THRESHOLD):
                        continue
                    centre = np.stack([cell % columns, cell // columns]) * stride + (stride - 1) / 2
                    points = (centre[None] + delta[:, cell].reshape(4, 2, -1) * (8 * stride - 1)).transpose(0, 2, 1).reshape(-1, 2)
                    if not np.isfinite(points).all():
                        raise ValueError("nonfinite detector output")
                    quad = minimum_rectangle(points)
                    if polygon_area(quad) >= LEAST_AREA:
                        out.append((key, level, way, seq, mean, [{"x": x, "y": y} for x, y in quad.tolist()]))
                        seq += 1
            yield pd.DataFrame(out, columns=["page", "level", "direction", "seq", "score", "quad"])

    names = [F.col(page).alias("page"), "level", "direction", "columns", "scores", "deltas", "links"]
    got = heads.select(*names).mapInPandas(run, f"page {kind}, level int, direction string, seq int, score double, quad array<struct<x: double, y: double>>")
    return got.withColumnRenamed("page", page)


def detect(heads: DataFrame, pages: DataFrame, page: str, threshold: float = SEGMENT_THRESHOLD, line_thresholds: dict[int, float] | None = None, max_side: int = 1600) -> DataFrame:
    """(page, width, height, regions as DETECTION structs by falling score): all heads decoded, regions brought to the page's
    own scale, those of too small an area left out there as well, overlapping ones suppressed. heads: as for head_regions();
    pages: page, width, height, also those without a region. Too many regions are an error."""
    scale = G.detector_scale(F.col("width"), F.col("height"), max_side)
    size = pages.select(page, "width", "height", scale.alias("scale"))
    found = head_regions(heads, page, threshold, line_thresholds).join(size, page)
    moved = lambda p: G.rescaled(p, F.col("scale.scaled_width"), F.col("scale.scaled_height"), F.col("width"), F.col("height"))
    found = found.withColumn("quad", F.transform("quad", moved)).where(G.polygon_area(F.col("quad")) >= LEAST_AREA)
    found = found.withColumn("vertical", F.col("direction") == "vertical")
    kept = limited(suppress_quads(found, page, ("level", "direction", "seq")), F.col("regions"))
    none = F.array().cast("array<struct<quad: array<struct<x: double, y: double>>, bbox: struct<x: double, y: double, width: double, height: double>, score: double, vertical: boolean>>")
    return pages.select(page, "width", "height").join(kept, page, "left").withColumn("regions", F.coalesce("regions", none))


def suppress_quads(found: DataFrame, page: str, ties: tuple[str, ...], overlap: float = OVERLAP) -> DataFrame:
    """(page, regions): greedy suppression of quads by the overlap of the polygons. found: page, quad, score, vertical and the
    columns that order equal scores. A page's candidates meet in one row: they are bounded by its detector's cells."""

    @F.pandas_udf("array<boolean>")
    def stays(quads: pd.Series) -> pd.Series:
        return pd.Series([keep_apart(np.asarray(q, float).reshape(-1, 4, 2), overlap) for q in quads])

    region = F.struct("quad", G.quad_bounds(F.col("quad")).alias("bbox"), "score", "vertical").alias("region")
    entry = F.struct((-F.col("score")).alias("order"), *ties, region)
    all_ = found.groupBy(page).agg(F.array_sort(F.collect_list(entry)).alias("all")).select(page, F.transform("all", lambda e: e["region"]).alias("all"))
    flat = F.flatten(F.flatten(F.transform("all", lambda r: F.transform(r["quad"], lambda p: F.array(p["x"], p["y"])))))
    kept = all_.withColumn("stays", stays(flat))
    pairs = F.filter(F.arrays_zip("all", "stays"), lambda z: z["stays"])
    return kept.select(page, F.transform(pairs, lambda z: z["all"]).alias("regions"))


def group_scores(cells_: DataFrame, key: str, least: float = LINE_THRESHOLD) -> DataFrame:
    """Mean score and size of each group that reaches the line threshold."""
    return cells_.groupBy(key, "group").agg(F.avg("score").alias("score"), F.count("*").alias("cells")).where(F.col("score") >= least)


def rectangles(points: DataFrame, key: list[str]) -> DataFrame:
    """The smallest rectangle around each group's points (x, y), of the least area at least. A group's distinct points meet
    in one task: they are one text line's."""

    @F.pandas_udf("array<double>")
    def corners(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([minimum_rectangle(np.column_stack([x, y])).reshape(-1) for x, y in zip(xs, ys)])

    sets = points.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("x", "y"))).alias("p"))
    found = sets.select(*key, corners(F.transform("p", lambda p: p["x"]), F.transform("p", lambda p: p["y"])).alias("c"))
    quad = F.array(*[G.point(F.get("c", F.lit(2 * i)), F.get("c", F.lit(2 * i + 1))) for i in range(4)])
    return found.select(*key, quad.alias("quad")).where(G.polygon_area(F.col("quad")) >= LEAST_AREA)


def union_heads(heads: dict[tuple[int, str], DataFrame]) -> DataFrame:
    """All detector heads as one table with level and direction; all six are required."""
    missing = [h for h in HEADS if h not in heads]
    if missing:
        raise ValueError(f"unsupported model: missing heads {missing}")
    out = None
    for (level, direction), df in heads.items():
        part = df.withColumns({"level": F.lit(level), "direction": F.lit(direction)})
        out = part if out is None else out.unionByName(part)
    return out


def suppress(boxes: DataFrame, page: str, score: str = "score", ties: tuple[str, ...] = (), overlap: float = OVERLAP) -> DataFrame:
    """(page, kept boxes as structs in order of score): greedy suppression of upright boxes, for which the boxes' overlap is the
    polygons'; turned quads take suppress_quads(). boxes: page, score, x, y, width, height.

    A box falls only to a box that stays, so the fold over a page's boxes is sequential by nature; pages are bounded by
    the region limit. Equal scores are ordered by the box's columns and then by ties."""
    entry = F.struct((-F.col(score)).alias("order"), "x", "y", "width", "height", *ties)
    pages = boxes.groupBy(page).agg(F.array_sort(F.collect_list(entry)).alias("boxes"))
    none = F.slice(F.col("boxes"), 1, 0)
    keep = lambda kept, b: F.when(F.exists(kept, lambda k: G.rect_iou(k, b) > overlap), kept).otherwise(F.concat(kept, F.array(b)))
    return pages.select(page, F.size("boxes").alias("candidates"), F.aggregate("boxes", none, keep).alias("kept"))


def limited(pages: DataFrame, regions: Column, most: int = MOST_REGIONS) -> DataFrame:
    """Too many regions are an error, never a silent cut."""
    return pages.where(F.when(F.size(regions) > most, F.raise_error(F.lit(f"invalid page: more than {most} detected regions")).cast("boolean")).otherwise(F.lit(True)))


def overlaps(boxes: DataFrame, page: str, key: str, cell: float = 128.0) -> DataFrame:
    """(page, a, b, iou) of the overlapping boxes of a page, a < b by key: boxes meet in the grid cells they touch, and a pair
    counts in the cell of its overlap's corner, so none twice."""
    at = lambda c: F.floor(c / cell).cast("int")
    span = F.explode(F.sequence(at(F.col("x")), at(F.col("x") + F.col("width"))))
    rows = boxes.withColumn("cx", span).withColumn("cy", F.explode(F.sequence(at(F.col("y")), at(F.col("y") + F.col("height")))))
    a = rows.select(page, "cx", "cy", F.col(key).alias("a"), F.struct("x", "y", "width", "height").alias("p"))
    b = rows.select(page, "cx", "cy", F.col(key).alias("b"), F.struct("x", "y", "width", "height").alias("q"))
    own = (at(F.greatest("p.x", "q.x")) == F.col("cx")) & (at(F.greatest("p.y", "q.y")) == F.col("cy"))
    met = a.join(b, [page, "cx", "cy"]).where((F.col("a") < F.col("b")) & own)
    return met.select(page, "a", "b", G.rect_iou(F.col("p"), F.col("q")).alias("iou")).where("iou > 0")
