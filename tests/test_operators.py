import json
import math

import pytest
from pyspark.sql import functions as F

from glyphframe.functions import geometry as G
from glyphframe.functions import text as X
from glyphframe.operators import batch, detect, evaluate, layout, page, recognise, routing


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_quads(spark):
    q = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((3, 1), (8, 4), (5, 9), (0, 6))])
    b, iou, compact, bounds = one(spark, G.quad_bounds(q), G.rect_iou(G.quad_bounds(G.rect(0, 0, 10, 10)), G.quad_bounds(G.rect(5, 0, 10, 10))), G.is_compact(G.rect(0, 0, 50, 10)), G.polygon_area(G.rect(1, 2, 10, 5)))
    assert tuple(b) == (0, 1, 8, 8) and math.isclose(iou, 1 / 3) and not compact and bounds == 50


def test_anchor_decoding(spark):
    corners = [(dx, dy, cell) for cell in (27, 28) for dx, dy in ((-0.5, -0.5), (0.5, 0.5))]
    points = spark.createDataFrame(corners, "dx double, dy double, cell int").select(F.lit(1).alias("g"), G.anchor_point(F.col("cell"), 8, 4, F.col("dx"), F.col("dy")).alias("p")).select("g", "p.*")
    got = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    assert tuple(got) == (-2, -2, 33, 29)


def test_ctc(spark):
    ids = F.array(*map(F.lit, (2, 2, 3, 2, 0, 1, 3)))
    kept, none = one(spark, X.ctc_keep(ids, 3), X.ctc_keep(F.array().cast("array<int>"), 3))
    assert kept == [0, 3, 4, 5] and none == []
    space = F.array(*map(F.lit, (True, False, True, False, True)))
    assert one(spark, X.trimmed_places(F.array(*map(F.lit, (0, 1, 2, 3, 4))), space))[0] == [1, 2, 3]
    probs = F.array(*[F.lit(math.log(p)) for p in (0.1, 0.8, 0.1)])
    at, p, conf, empty = one(spark, X.argmax(probs), F.exp(X.log_probability(probs, F.lit(1))), X.confidence(F.lit(math.log(0.8 * 0.6)), F.lit(2)), X.confidence(F.lit(0.0), F.lit(0)))
    assert at == 1 and math.isclose(p, 0.8) and math.isclose(conf, math.sqrt(0.48)) and empty is None


def test_masked_token(spark):
    v, allow = F.array(*map(F.lit, (0.0, 10.0, -1.0))), F.array(*map(F.lit, (True, False, True)))
    at, p = one(spark, X.masked_argmax(v, allow), F.exp(X.log_probability(v, X.masked_argmax(v, allow))))
    assert at == 0 and p < 0.001
    with pytest.raises(Exception, match="nonfinite"):
        one(spark, X.masked_argmax(F.array(F.lit(0.0), F.lit(float("nan"))), F.array(F.lit(True), F.lit(False))))


def test_text(spark):
    got = one(spark, X.nfc(F.lit("é")), X.slug(F.lit("OCRModel v2!")), X.slug(F.lit("--")), X.rendered(F.lit("<space>"), F.lit(None).cast("string")), X.trimmed(F.lit("\t　a b\n")))
    assert tuple(got) == ("é", "ocr_model_v2", "resource", " ", "a b")
    # vectors of the recognition contract, as they are
    checks = [("8", 0.95, "8", 0.6, True), ("6", 0.95, "9", 0.95, False), ("8", 0.7, "8", 0.99, False), ("8", 0.99, "8", 0.3, False), ("*", 1.0, "*", 1.0, False), ("", 1.0, "", 1.0, False), ("1234", 1.0, "1234", 1.0, False), ("8", None, "8", 1.0, False)]
    rows = spark.createDataFrame(checks, "a string, x double, b string, y double, want boolean")
    assert rows.where(X.numeric_consensus(F.col("a"), F.col("x"), F.col("b"), F.col("y")) != F.col("want")).count() == 0
    with pytest.raises(ValueError):
        X.allowed(F.lit("a"), F.lit(None), ["latin", "latin"])


def test_orientation(spark):
    for turn in range(4):
        lines = spark.createDataFrame([(1, turn * math.pi / 2, 5, True)], "page int, angle double, chars int, anchor boolean")
        got = routing.page_orientation(lines, "page", F.col("angle"), F.col("chars"), F.col("anchor")).select(G.turns(F.col("page_angle"), F.lit(0.0))).first()[0]
        assert got == turn
    lines = spark.createDataFrame([(1, 0.0, 5, True), (1, math.pi, 5, True), (2, 0.0, 5, False)], "page int, angle double, chars int, anchor boolean")
    got = routing.page_orientation(lines, "page", F.col("angle"), F.col("chars"), F.col("anchor"))
    assert [r.page_angle for r in got.collect()] == [None, None]


def test_layout(spark):
    boxes = spark.createDataFrame([(1, i, float(x), float(y), 100.0, 20.0) for i, (x, y) in enumerate(((0, 0), (200, 0), (0, 80), (200, 80)))], "page int, k int, x double, y double, width double, height double")
    assert [r.k for r in layout.in_reading_order(boxes, "page", "k").orderBy("position").collect()] == [0, 2, 1, 3]
    text = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "page int, position int, text string")
    assert layout.page_text(text, "page", "position", "text").first().text == "a\nb"


def test_page_summary(spark):
    rows = [(1, "a", math.log(0.8), 1), (1, "bb", 2 * math.log(0.5), 2), (1, "", -9.0, 3), (2, "x", 0.0, 0)]
    lines = spark.createDataFrame(rows, "page int, text string, log_sum double, tokens int")
    got = {r.page: r for r in page.summary(lines, "page", 0.7).collect()}
    assert (got[1].lines, got[1].filtered) == (1, 1) and math.isclose(got[1].confidence, 0.8)
    assert (got[2].lines, got[2].filtered, got[2].confidence) == (0, 1, None)
    for bad in (dict(reading_order="bad"), dict(min_line_confidence=1.1), dict(script="Klingon")):
        with pytest.raises(ValueError):
            page.checked_options(**bad)
    assert page.checked_options(reading_order="")["reading_order"] == "auto"


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 4)] + [("b", 3.0)], "k string, v double")
    got = {r.k: (r.runs, r.p50, r.p95) for r in evaluate.grouped_percentiles(df, "k", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (4, 2.0, 4.0), "b": (1, 3.0, 3.0)}


def test_batches(spark):
    rows = spark.createDataFrame([(0, 4.0), (1, -1.0), (2, 9.0)], "id long, v double")

    def make():
        def score(pdf):
            if (pdf.v < 0).any():
                raise ValueError("invalid value")
            return pdf.assign(root=pdf.v**0.5, error=None)

        return score

    got = {r.id: (r.root, r.error and r.error.code) for r in batch.scored(rows, make, "id long, root double, error struct<code: string, message: string>").collect()}
    assert got == {0: (2.0, None), 1: (None, "invalid_input"), 2: (3.0, None)}
    items = batch.items(rows, F.col("v"), F.when(F.col("v") < 0, "path"), F.lit("no file"), F.col("id"))
    lines = [json.loads(r.json) for r in batch.as_json(items).collect()]
    assert lines[0] == {"index": 0, "result": 4.0} and lines[1]["error"]["code"] == "invalid_input" and "result" not in lines[1]


def test_heads_are_required():
    with pytest.raises(ValueError):
        detect.union_heads({})


def test_corner_ties_and_premultiplied(spark):
    diamond = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((5, 0), (10, 5), (5, 10), (0, 5))])
    assert [tuple(p) for p in one(spark, G.ordered_quad(diamond))[0]] == [(0, 5), (5, 0), (10, 5), (5, 10)]
    assert one(spark, G.composited(F.lit(100), F.lit(200), True))[0] == 155
    with pytest.raises(Exception, match="premultiplied"):
        one(spark, G.composited(F.lit(200), F.lit(100), True))


def head(page, scores, level=2, way="horizontal", links=0.0, deltas=((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5))):
    n = len(scores)
    return (page, level, way, int(n**0.5), [float(s) for s in scores], [float(v) for xy in deltas for v in xy for _ in range(n)], [links] * 8 * n)


HEADS = "page int, level int, direction string, columns int, scores array<float>, deltas array<double>, links array<double>"


def test_detection(spark):
    scores = [0.0] * 64
    scores[27] = scores[28] = 0.9
    apart = [0.0] * 64
    apart[0], apart[63] = 0.9, 0.85
    heads = spark.createDataFrame([head(1, scores, links=0.9), head(1, apart, 4, "vertical"), head(2, [0.75] * 64)], HEADS)
    pages = spark.createDataFrame([(1, 1000, 1000), (2, 64, 64), (3, 64, 64)], "page int, width int, height int")
    got = {r.page: r.regions for r in detect.detect(heads, pages, "page").collect()}
    assert got[2] == [] and got[3] == []  # below the line threshold; no head at all
    level = [r for r in got[1] if not r.vertical]
    assert [(p.x, p.y) for p in level[0].quad] == [(0, 0), (33, 0), (33, 29), (0, 29)] and level[0].score == pytest.approx(0.9)
    assert [r.vertical for r in got[1]].count(True) == 2 and [r.score for r in got[1]] == sorted((r.score for r in got[1]), reverse=True)
    nothing = [(float("nan"), 0.0)] * 4
    with pytest.raises(Exception, match="nonfinite"):
        detect.detect(spark.createDataFrame([head(1, scores, deltas=nothing)], HEADS), pages, "page").collect()
    many = spark.createDataFrame([head(1, [0.9] * 4096, deltas=((-0.06, -0.06), (0.06, -0.06), (0.06, 0.06), (-0.06, 0.06)))], HEADS)
    with pytest.raises(Exception, match="more than 1000"):
        detect.detect(many, pages, "page").collect()


REGIONS = "page int, width int, height int, regions array<struct<quad: array<struct<x: double, y: double>>, bbox: struct<x: double, y: double, width: double, height: double>, score: double, vertical: boolean>>"


def region(x, y, w, h, score=0.9, vertical=False):
    quad = [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    return {"quad": quad, "bbox": {"x": float(x), "y": float(y), "width": float(w), "height": float(h)}, "score": score, "vertical": vertical}


def models(table):
    """Plug-ins that know each region by its left edge: (script, flip, {reader: (text, probability)})."""
    pick = lambda x, f, kind: F.coalesce(*[F.when(x == k, F.lit(f(v)).cast(kind)) for k, v in table.items()], F.lit(None).cast(kind))

    def classify(df):
        x = F.col("bbox.x")
        return df.withColumns({"script": pick(x, lambda v: v[0], "string"), "flip": pick(x, lambda v: v[1], "double")})

    def reader(df, by):
        x, names = F.col("bbox.x"), ("Latin", "CJK")
        text = F.coalesce(*[F.when(F.col(by) == n, pick(x, lambda v, n=n: v[2].get(n, ("", 1))[0], "string")) for n in names])
        chance = F.coalesce(*[F.when(F.col(by) == n, pick(x, lambda v, n=n: v[2].get(n, ("", 1))[1], "double")) for n in names])
        return df.withColumns({"text": text, "tokens": F.char_length(text), "log_sum": F.ln(chance) * F.char_length(text)})

    return classify, reader


def test_recognition(spark):
    table = {
        0: ("Latin", 3.0, {"Latin": ("first line", 0.95)}), 10: ("CJK", -3.0, {"CJK": ("flipped", 0.9)}), 20: ("Arabic", 1.0, {}), 30: ("", 1.0, {"Latin": ("42", 0.95), "CJK": ("42", 0.6)}),
        40: ("", 1.0, {"Latin": ("42", 0.95), "CJK": ("43", 0.9)}), 50: ("Latin", 1.0, {"Latin": ("unsure", 0.4)}), 60: ("Latin", -1.0, {"Latin": ("X", 0.9)}),
    }
    page_ = [region(0, 0, 100, 10), region(20, 40, 100, 10), region(30, 60, 12, 10), region(40, 60, 12, 10), region(50, 80, 100, 10), region(60, 20, 12, 10)]
    rows = spark.createDataFrame([(1, 300, 200, page_), (2, 50, 50, []), (3, 300, 300, [region(10, 0, 100, 10)])], REGIONS)
    classify, reader = models(table)
    got = {r.page: r.result for r in recognise.recognise(rows, "page", classify, reader, ["Latin", "CJK"], min_line_confidence=0.5, model_sha256="s").collect()}
    one = got[1]
    assert one.text == "first line\nX\n42" and [x.script for x in one.lines] == ["Latin"] * 3 and [x.rotated_180 for x in one.lines] == [False] * 3
    assert one.confidence == pytest.approx(math.exp((10 * math.log(0.95) + math.log(0.9) + 2 * math.log(0.95)) / 13))
    assert one.warnings[1:] == ["Skipped 1 line(s) classified as Arabic: recognizer not included in this model package.", "Filtered 1 line(s) below min_line_confidence 0.500."]
    assert (got[2].text, got[2].confidence, got[2].lines, len(got[2].warnings)) == ("", None, [], 1)
    assert (got[3].lines[0].rotated_180, got[3].lines[0].rotation_degrees) == (True, 180)
    forced = recognise.recognise(rows.where("page = 3"), "page", classify, reader, ["Latin", "CJK"], script="Latin").first().result
    assert forced.text == ""  # read by the forced script's recogniser, turned as the classifier says
    # without a filter, and against the operators one by one: two columns, cut between
    both = spark.createDataFrame([(1, 600, 200, [region(0, 0, 100, 20), region(200, 0, 100, 20), region(1, 80, 100, 20), region(201, 80, 100, 20)])], REGIONS)
    words = {k: ("Latin", 3.0, {"Latin": (f"w{k}", 0.9)}) for k in (0, 200, 1, 201)}
    order = lambda mode: recognise.recognise(both, "page", *models(words), ["Latin"], reading_order=mode).first().result.text.split()
    assert order("auto") == order("ltr") == ["w0", "w1", "w200", "w201"] and order("rtl") == ["w200", "w201", "w0", "w1"] and order("none") == ["w0", "w200", "w1", "w201"]


def test_compact_regions_follow_the_page(spark):
    """A page turned by a quarter: its long lines say so, its short token is turned with them."""
    up = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (10, 0), (10, 100), (0, 100))]
    long = {"quad": up, "bbox": {"x": 0.0, "y": 0.0, "width": 10.0, "height": 100.0}, "score": 0.9, "vertical": True}
    rows = spark.createDataFrame([(1, 300, 300, [long, region(60, 20, 12, 10)])], REGIONS)
    table = {0: ("Latin", 3.0, {"Latin": ("a long line", 0.95)}), 60: ("Latin", 1.0, {"Latin": ("X", 0.9)})}
    lines = recognise.recognise(rows, "page", *models(table), ["Latin"]).first().result.lines
    assert {x.text: x.rotation_degrees for x in lines} == {"a long line": 270, "X": 270}


def test_single_lines(spark):
    table = {0: ("Latin", -3.0, {"Latin": ("line", 0.9)}), 1: ("Thai", 1.0, {}), 2: ("", 1.0, {"Latin": ("7", 0.95), "CJK": ("7", 0.6)}), 3: ("", 1.0, {"Latin": ("7", 0.95), "CJK": ("7", 0.6)})}
    rows = spark.createDataFrame([(k, {"x": float(k)}, w, 10) for k, w in ((0, 100), (1, 100), (2, 12), (3, 100))], "id int, bbox struct<x: double>, width int, height int")
    classify, reader = models(table)
    got = {r.id: r for r in recognise.recognise_lines(rows, classify, reader, ["Latin", "CJK"]).collect()}
    assert (got[0].result.text, got[0].result.rotation_degrees, got[0].error) == ("line", 180, None)
    assert got[1].result is None and got[1].error.code == "unsupported" and got[2].result.text == "7" and got[2].result.script == "Latin" and got[3].result.text == ""
    forced = {r.id: r for r in recognise.recognise_lines(rows, classify, reader, ["Latin", "CJK"], script="Latin").collect()}
    assert not forced[0].result.rotated_180 and forced[2].result.text == "7"
    assert recognise.recognise_lines(rows, classify, reader, ["Latin"], script="Thai").first().error.message == "unavailable script Thai"
    assert recognise.available_scripts(["CJK", "Latin"]) == ["Latin", "CJK"]


def test_index_and_closure(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = batch.indexed(rows, "k").collect()
    assert sorted((r["index"], r.k) for r in got) == [(i, i) for i in range(1000)]
    chain = spark.range(40).select("id", F.array((F.col("id") + 1)).alias("needs")).withColumnRenamed("id", "name")
    assert batch.needed(chain, spark.createDataFrame([(0,)], "name long")).count() == 41


def test_slow_and_failing_models(spark):
    rows = spark.createDataFrame([(0, 0.0), (1, 0.3)], "id long, v double").coalesce(1)

    def make():
        import time

        def score(pdf):
            time.sleep(pdf.v.sum())
            if len(pdf) > 1:
                raise RuntimeError("one at a time")
            return pdf.assign(error=None)

        return score

    got = {r.id: r.error and r.error.code for r in batch.scored(rows, make, "id long, v double, error struct<code: string, message: string>", timeout=0.2).collect()}
    assert got == {0: None, 1: "timeout"}


def test_resource_names(spark):
    # vectors of the package layout, as they are
    cases = {
        "C:\\build\\Model_Edge\\Detector\\Universal\\ONNX\\checkpoint.001.onnx": "models/detection/universal.onnx",
        "C:\\build\\Model_Edge\\Character\\LatinPrintedV2\\ONNX\\checkpoint.005_quant.onnx": "models/recognition/latin_printed_v2.onnx",
        "C:\\build\\Model_Edge\\Character\\CJKPrinted\\char2ind.txt": "data/recognition/cjk_printed/alphabet.txt",
        "C:\\build\\Model_Edge\\Rejection\\CJKMixedDummy\\ONNX\\dated.onnx": "models/rejection/cjk_mixed_dummy.onnx",
        "C:\\build\\Model_Edge\\Character\\HebrewPrinted\\composite_chars_map": "data/recognition/hebrew_printed/composite_characters.txt",
        "tiny.onnx": "models/tiny.onnx",
    }
    rows = spark.createDataFrame(list(cases.items()), "name string, want string")
    assert rows.where(X.filename_of(F.col("name")) != F.col("want")).count() == 0
