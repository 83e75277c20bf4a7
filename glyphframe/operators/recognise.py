"""Recognition of pages and of single lines, composed of the routing, layout and page operators around two plug-ins.

A classifier takes regions and adds script (string, empty for none) and flip (double; negative: upside down). A reader takes
regions and the name of a column that says which script's recogniser reads a region, and adds text, log_sum and tokens, which
are null where that column is null. Both are functions from a DataFrame to a DataFrame with the same rows, for models usually
by batch.scored() over crops(). A region carries its page's columns, so a plug-in may use what the pages bring along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import text as X
from ..schema import CONFIDENCE_METHOD, COORDINATE_SPACE, LINE, PAGE, SCRIPTS, STANDING_WARNING
from ..storage import materialise
from . import layout, routing
from .page import checked_options, warnings

Classifier = Callable[[DataFrame], DataFrame]
Reader = Callable[[DataFrame, str], DataFrame]
NUMERAL = ("Latin", "CJK")


def read(regions: DataFrame, classify: Classifier, reader: Reader, scripts: list[str], script: str = "", numeral: Column | None = None) -> DataFrame:
    """regions with script, flip, text, log_sum, tokens, flipped. Each plug-in sees the rows once, and the reader a second
    time, with a null column but for the short numerals that a second recogniser has to confirm. script: forces the reader's
    script; numeral: which regions without a script may be short numerals."""
    seen = classify(regions).withColumn("flipped", X.flips(F.col("flip"), F.col("compact")))
    chosen = F.lit(script) if script else F.coalesce("script", F.lit(""))
    seen = seen.withColumn("script", chosen)
    tries = numeral & (F.col("script") == "") if numeral is not None and set(NUMERAL) <= set(scripts) else F.lit(False)
    first = F.when(F.col("script").isin(*scripts), F.col("script")).when(tries, NUMERAL[0])
    got = reader(seen.withColumn("reader", first), "reader")
    own = X.confidence(F.col("log_sum"), F.col("tokens"))
    doubtful = (F.col("script") == "") & F.col("text").rlike("^[0-9]{1,3}$") & (own >= 0.9)
    got = got.withColumn("a", F.struct("text", "log_sum", "tokens")).withColumn("again", F.when(F.coalesce(doubtful, F.lit(False)), NUMERAL[1])).drop("text", "log_sum", "tokens")
    got = reader(got, "again").withColumn("b", F.struct("text", "log_sum", "tokens")).drop("text", "log_sum", "tokens")
    sure = lambda c: X.confidence(F.col(f"{c}.log_sum"), F.col(f"{c}.tokens"))
    agreed = X.numeric_consensus(F.col("a.text"), sure("a"), F.col("b.text"), sure("b"))
    takes = (F.col("script") != "") | agreed
    out = got.select("*", *[F.when(takes, F.col(f"a.{c}")).alias(c) for c in ("log_sum", "tokens")], F.coalesce(F.when(takes, F.col("a.text")), F.lit("")).alias("text"))
    return out.withColumn("script", F.when((F.col("script") == "") & agreed, NUMERAL[0]).otherwise(F.col("script"))).drop("a", "b", "again", "reader")


def placed(regions: DataFrame, prior: Column) -> DataFrame:
    """regions (quad, vertical, score) with what a crop needs: ordered quad, aspect, compact, whether it is read as a column,
    and its quarter turns before it is classified. prior: the page's direction, null without one."""
    shape = regions.withColumn("prior", prior).withColumn("corners", G.ordered_quad(F.col("quad")))
    shape = shape.withColumns({"aspect": G.region_aspect(F.col("corners")), "edge": G.edge_angle(F.col("corners"))})
    shape = shape.withColumns({"compact": F.col("aspect") <= 2, "column_read": routing.uses_vertical(F.col("vertical"), F.col("aspect"), F.col("prior"))})
    width, height = G.sides(F.col("corners"))
    return shape.withColumn("quarter", routing.quarter(F.col("column_read"), width, height, F.col("compact"), F.col("prior"), F.col("edge"), F.lit(False)))


def with_lines(read_: DataFrame) -> DataFrame:
    """Regions that were read, with quarter after the flip, direction, confidence and whether they anchor the page."""
    turned = read_.withColumn("quarter", F.pmod(F.col("quarter") + F.when(F.col("flipped"), 2).otherwise(0), F.lit(4)).cast("int"))
    conf = X.confidence(F.col("log_sum"), F.col("tokens"))
    turned = turned.withColumns({"angle": routing.region_direction(F.col("edge"), F.col("quarter")), "confidence": F.when(F.col("text") != "", conf)})
    return turned.withColumn("anchor", (F.col("text") != "") & X.is_anchor(F.col("compact"), F.col("flip"), F.col("text"), F.col("confidence")))


def line_of() -> Column:
    """A LINE struct of a region's columns."""
    quad = G.rounded_quad(F.col("quad"))
    return F.struct(
        "text", quad.alias("quad"), G.quad_bounds(quad).alias("bbox"), F.col("score").alias("detection_score"), "vertical", G.is_rotated_180(F.col("quarter")).alias("rotated_180"),
        G.rotation_degrees(F.col("quarter")).alias("rotation_degrees"), "script", "confidence", F.lit(None).cast(LINE["words"].dataType).alias("words"),
    )


def recognise(pages: DataFrame, page: str, classify: Classifier, reader: Reader, scripts: list[str], script: str = "", reading_order: str = "auto", min_line_confidence: float = 0.0, model_sha256: str = "") -> DataFrame:
    """(page, result as PAGE) of pages: page, width, height, regions as detect() gives them.

    Regions that are not compact are read first; the anchors among them tell each page's direction, and with it the compact
    ones are read. The first reading is written to the shared folder, so that no model runs twice."""
    options = checked_options(script, reading_order, min_line_confidence)
    rest = [c for c in pages.columns if c not in (page, "regions")]
    all_ = pages.select(page, *rest, F.posexplode("regions").alias("seq", "region")).select(page, *rest, "seq", "region.*")
    compact = G.is_compact(G.ordered_quad(F.col("quad")))
    nothing = F.lit(None).cast("double")
    numeral = lambda: routing.tries_numeral(F.col("script"), F.col("compact"), F.col("score"))
    long = with_lines(read(placed(all_.where(~compact), nothing), classify, reader, scripts, script, numeral()))
    long = materialise(long, "regions")
    prior = routing.page_orientation(long, page, F.col("angle"), F.char_length("text"), F.col("anchor"))
    short = routing.with_page(all_.where(compact), prior, page)
    short = with_lines(read(placed(short, F.col("page_angle")).drop("page_angle"), classify, reader, scripts, script, numeral()))
    both = materialise(long.unionByName(short), "regions")
    return page_results(pages, both, page, scripts, options, model_sha256)


def page_results(pages: DataFrame, regions: DataFrame, page: str, scripts: list[str], options: dict, model_sha256: str = "") -> DataFrame:
    """(page, result): regions, read, as pages: filtered, in reading order, joined, with warnings."""
    least = options["min_line_confidence"]
    spoken = regions.where("text <> ''")
    stays = F.lit(True) if least <= 0 else F.coalesce(F.col("confidence") >= least, F.lit(False))
    silent = (F.col("text") == "") & ~F.col("script").isin("", *scripts)
    counts = regions.groupBy(page).agg(
        F.count_if((F.col("text") != "") & ~stays).alias("filtered"), *[F.count_if(silent & (F.col("script") == s)).alias(f"skipped_{s}") for s in SCRIPTS],
        F.sum(F.when((F.col("text") != "") & stays, F.col("log_sum"))).alias("log_sum"), F.sum(F.when((F.col("text") != "") & stays, F.col("tokens"))).alias("tokens"),
    )
    kept = spoken.where(stays)
    if options["reading_order"] == "none":
        order = kept.select(page, "seq", F.col("seq").alias("position"))
    else:
        angle, rtl = layout.layout_angle(kept, page, F.col("angle")), layout.is_rtl(kept, page)
        wanted = {"auto": F.col("rtl"), "ltr": F.lit(False), "rtl": F.lit(True)}[options["reading_order"]]
        level = kept.join(angle.join(rtl, page), page).select(page, "seq", G.quad_bounds(layout.levelled(F.col("quad"), F.col("layout_angle"))).alias("b"), wanted.alias("turn"))
        order = layout.in_reading_order(level.select(page, "seq", "b.*", "turn"), page, "seq", "turn")
    lines = kept.select(page, "seq", line_of().alias("line")).join(order, [page, "seq"])
    lines = lines.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("rows")).select(page, F.transform("rows", lambda r: r["line"]).alias("lines"))
    got = pages.select(page, "width", "height").join(counts, page, "left").join(lines, page, "left")
    none = F.array().cast(PAGE["lines"].dataType)
    skipped = F.create_map(*[x for s in SCRIPTS for x in (F.lit(s), F.coalesce(F.col(f"skipped_{s}"), F.lit(0)))])
    text = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    said = F.concat(F.array(F.lit(STANDING_WARNING)), warnings(skipped, F.coalesce("filtered", F.lit(0)), least))
    got = got.withColumn("lines", F.coalesce("lines", none))
    result = F.struct(
        F.when(text != "", X.confidence(F.col("log_sum"), F.col("tokens"))).alias("confidence"), F.lit(CONFIDENCE_METHOD).alias("confidence_method"), F.lit(COORDINATE_SPACE).alias("coordinate_space"), text.alias("text"),
        "lines", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.lit(None).cast("double").alias("elapsed_seconds"), F.lit(model_sha256).alias("model_sha256"), said.alias("warnings"),
    )
    return got.select(page, result.cast(T.StructType(PAGE.fields)).alias("result"))


def recognise_lines(lines: DataFrame, classify: Classifier, reader: Reader, scripts: list[str], script: str = "", model_sha256: str = "") -> DataFrame:
    """lines (width, height and others) with result and error. As the contract has it, this differs from a page's regions: a
    forced script skips the classifier, and with it the turn; a short numeral needs no detection score; a script without a
    recogniser is an error; the page options are not applied."""
    checked_options(script)
    shape = lines.withColumn("compact", F.greatest("width", "height") <= 2 * F.least("width", "height"))
    upright: Classifier = lambda df: df.withColumns({"script": F.lit(script), "flip": F.lit(0.0)})
    got = read(shape, upright if script else classify, reader, scripts, script, F.col("compact"))
    missing = ~F.col("script").isin("", *scripts)
    result = F.struct(
        "text", F.when(F.col("text") != "", X.confidence(F.col("log_sum"), F.col("tokens"))).alias("confidence"), F.lit(CONFIDENCE_METHOD).alias("confidence_method"), F.col("width").cast("int").alias("width"),
        F.col("height").cast("int").alias("height"), "script", F.col("flipped").alias("rotated_180"), F.when(F.col("flipped"), 180).otherwise(0).alias("rotation_degrees"), F.lit(None).cast("double").alias("elapsed_seconds"), F.lit(model_sha256).alias("model_sha256"),
    )
    message = F.concat(F.lit("unavailable script "), F.col("script"))
    error = F.when(missing, F.struct(X.error_code(F.lit(None).cast("string"), message).alias("code"), message.alias("message")))
    return got.select(*lines.columns, F.when(~missing, result).alias("result"), error.alias("error"))


def available_scripts(recognisers: list[str]) -> list[str]:
    """Those of the known scripts that have a recogniser, in their fixed order."""
    return [s for s in SCRIPTS if s in recognisers]
