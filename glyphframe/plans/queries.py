"""The library's operators as queries over the given tables, each with its SQL where SQL can express it.

The tables hold no images, so pages, boxes, score maps and frames are derived from them by fixed arithmetic, the same in both
languages: they exercise the operators' semantics and say nothing about recognition accuracy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import batch, detect, evaluate, layout, page, recognise, routing
from ..schema import CLASSIFIER_CHANNELS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where a small table has fewer files than there are cores; of no use, and left out, with many files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def once(value: F.Column, keep=None) -> F.Column:
    """The fields of a struct that is computed once a row, of the rows that keep, a condition on it, lets pass. A filter over a
    projection would be pushed below it and compute the struct again."""
    return F.inline(X.let(value, lambda t: F.array(t) if keep is None else F.filter(F.array(t), keep)))


def r6(c) -> F.Column:
    return F.round(c, 6)


# ---------------------------------------------------------------- derived relations

BOXES = """boxes AS (SELECT l_orderkey AS page, l_linenumber AS seq, CAST(l_partkey * 7 % 800 AS DOUBLE) AS x, CAST(l_suppkey * 13 % 600 AS DOUBLE) AS y,
 l_quantity + 10.0 AS width, l_linenumber * 4 + 8.0 AS height, (500 + CAST(round(l_tax * 100) AS INT) * 50) / 1000.0e0 AS score FROM lineitem)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("seq"), (F.col("l_partkey") * 7 % 800).cast("double").alias("x"), (F.col("l_suppkey") * 13 % 600).cast("double").alias("y"),
        (F.col("l_quantity") + 10.0).alias("width"), (F.col("l_linenumber") * 4 + 8.0).alias("height"), ((500 + F.round(F.col("l_tax") * 100).cast("int") * 50) / 1000.0).alias("score"),
    )


LINES = """lines AS (SELECT user_id AS page, event_id, CASE event_type WHEN 'view' THEN 'Latin' WHEN 'click' THEN 'Arabic' WHEN 'purchase' THEN 'Hebrew' ELSE 'CJK' END AS script,
 CAST(event_id % 7 AS INT) AS tokens, -(event_id % 11) * 0.05e0 * (event_id % 7) AS log_sum, CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS text,
 (event_id % 4) * 0.01e0 AS angle, (event_id % 5 <> 0) AS anchor, CAST(event_id % 31 AS INT) AS chars, value FROM events)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "Latin").when(F.col("event_type") == "click", "Arabic").when(F.col("event_type") == "purchase", "Hebrew").otherwise("CJK")
    return table(spark, d, "events").select(
        F.col("user_id").alias("page"), "event_id", kind.alias("script"), (e % 7).cast("int").alias("tokens"), (-(e % 11) * 0.05 * (e % 7)).alias("log_sum"), F.when(e % 13 == 0, "").otherwise(F.col("event_type")).alias("text"),
        ((e % 4) * 0.01).alias("angle"), (e % 5 != 0).alias("anchor"), (e % 31).cast("int").alias("chars"), "value",
    )


def doubles(c: str, n: int | None = None) -> F.Column:
    v = F.col(c) if n is None else F.slice(c, 1, n)
    return F.transform(v, lambda x: x.cast("double"))


# ---------------------------------------------------------------- scores


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INT) AS channel, ({CLASSIFIER_CHANNELS!r})[list_position(v, list_max(v))] AS script,
 round(exp(-ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v)))))), 6) AS probability FROM e""")
def script_argmax(spark, d):
    """The classifier's channel of highest score, the first of equals, and its softmax."""
    v = table(spark, d, "embeddings").select("vec_id", doubles("embedding", 10).alias("v"))
    at = X.argmax(F.col("v"))
    names = F.array(*[F.lit(s) for s in CLASSIFIER_CHANNELS])
    return v.select("vec_id", at.alias("channel"), F.element_at(names, at + 1).alias("script"), r6(F.exp(X.log_probability(F.col("v"), at))).alias("probability"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT vec_id, label, round(v[label + 1] - list_max(v) - ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 6) AS log_probability FROM e""")
def token_logprob(spark, d):
    """Log-softmax of one token over the whole alphabet."""
    v = table(spark, d, "embeddings").select("vec_id", "label", doubles("embedding").alias("v"))
    return v.select("vec_id", "label", r6(X.log_probability(F.col("v"), F.col("label"))).alias("log_probability"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
 m AS (SELECT vec_id, list_max(list_transform(range(1, 65), lambda i: CASE WHEN i % 3 = 0 THEN v[i] ELSE -1e300 END)) AS top, v FROM e)
SELECT vec_id, CAST(list_position(list_transform(range(1, 65), lambda i: CASE WHEN i % 3 = 0 THEN v[i] ELSE -1e300 END), top) - 1 AS INT) AS token,
 round(top - list_max(v) - ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 6) AS log_probability FROM m""")
def masked_token(spark, d):
    """The best allowed token; its probability is over the whole alphabet, so that a mask cannot raise it."""
    v = table(spark, d, "embeddings").select("vec_id", doubles("embedding").alias("v"))
    allow = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i % 3 == 0)
    v = v.withColumn("token", X.masked_argmax(F.col("v"), allow))
    return v.select("vec_id", "token", r6(X.log_probability(F.col("v"), F.col("token"))).alias("log_probability"))


SCORE = "1 / (1 + exp(-CAST(x AS DOUBLE)))"


def maps(spark, d):
    v = table(spark, d, "embeddings")
    s = F.transform("embedding", lambda x: 1 / (1 + F.exp(-x.cast("double"))))
    v = v.select("vec_id", s.alias("scores"))
    link = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.get(F.col("scores"), ((i % 64) * 3 + F.floor(i / 64) * 5).cast("int") % 64))
    return v.withColumn("links", link)


@query(f"""WITH e AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: {SCORE})) AS score, unnest(range(0, 64)) AS cell FROM embeddings)
SELECT vec_id, CAST(cell AS INT) AS cell, round(score, 6) AS score, (cell % 8) * 4 + 1.5e0 + 0.5e0 * 31 AS x, (cell // 8) * 4 + 1.5e0 - 0.5e0 * 31 AS y FROM e WHERE score >= 0.52""")
def segment_cells(spark, d):
    """Cells over threshold of 8 x 8 score maps, with one decoded corner."""
    c = detect.cells(maps(spark, d), "vec_id", "scores", 0.52)
    p = G.anchor_point(F.col("cell"), 8, 4, F.lit(0.5), F.lit(-0.5))
    return c.select("vec_id", "cell", r6("score").alias("score"), p["x"].alias("x"), p["y"].alias("y"))


@query(f"""WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: {SCORE}) AS s FROM embeddings),
 cells AS (SELECT vec_id, CAST(c AS INT) AS cell, s FROM e, range(0, 64) AS t(c) WHERE s[c + 1] >= 0.5),
 steps AS (SELECT * FROM (VALUES (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,-1),(4,0,1),(5,1,-1),(6,1,0),(7,1,1)) AS v(c, dy, dx)),
 edges AS (SELECT a.vec_id, a.cell AS a, b.cell AS b FROM cells a JOIN steps ON true JOIN cells b ON b.vec_id = a.vec_id AND b.cell // 8 = a.cell // 8 + dy AND b.cell % 8 = a.cell % 8 + dx
  WHERE a.s[(a.cell * 3 + c * 5) % 64 + 1] >= 0.52 OR a.s[(b.cell * 3 + (7 - c) * 5) % 64 + 1] >= 0.52),
 reach AS (SELECT vec_id, cell, cell AS seen FROM cells UNION SELECT r.vec_id, r.cell, e.b FROM reach r JOIN edges e ON e.vec_id = r.vec_id AND e.a = r.seen),
 groups AS (SELECT vec_id, cell, min(seen) AS g FROM reach GROUP BY 1, 2)
SELECT g.vec_id, g.g AS "group", round(avg(c.s[c.cell + 1]), 6) AS score, count(*) AS cells FROM groups g JOIN cells c ON c.vec_id = g.vec_id AND c.cell = g.cell GROUP BY 1, 2 HAVING avg(c.s[c.cell + 1]) >= 0.51""")
def link_groups(spark, d):
    """Cells joined by links from either side, the mean score of each group, and the groups over the line threshold."""
    c = detect.groups(maps(spark, d), "vec_id", 8, "scores", "links", 0.5, 0.52)
    return detect.group_scores(c, "vec_id", 0.51).select("vec_id", "group", r6("score").alias("score"), "cells")


# ---------------------------------------------------------------- decoding

FRAMES = """frames AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0),
 ids AS (SELECT doc_id, i, c, unicode(c) % 40 AS id, lag(unicode(c) % 40) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM frames),
 kept AS (SELECT doc_id, i, c, id, ln((unicode(c) % 89 + 10) / 100.0e0) AS lp FROM ids WHERE id <> 32 AND (prev IS NULL OR id <> prev))"""


def frames(spark, d):
    """doc_id, chars, ids of each text: one frame a character; blank is id 32."""
    t = spread(table(spark, d, "documents")).where("length(text) > 0").select("doc_id", F.split("text", "").alias("chars"))
    return t.select("doc_id", "chars", F.transform("chars", lambda c: F.ascii(c) % 40).alias("ids"))


@query(f"WITH {FRAMES} SELECT d.doc_id, length(d.text) AS frames, (SELECT count(*) FROM kept k WHERE k.doc_id = d.doc_id) AS tokens, (SELECT CAST(coalesce(sum(k.id * (k.i % 1000)), 0) AS BIGINT) FROM kept k WHERE k.doc_id = d.doc_id) AS checksum FROM documents d WHERE length(d.text) > 0")
def ctc_collapse(spark, d):
    """Frames that differ from the one before and are not blank. Each line is one row, so nothing is shuffled."""
    def tally(ids):
        total = lambda kept: F.aggregate(kept, F.lit(0).cast("long"), lambda a, i: a + F.get(ids, i) * ((i + 1) % 1000))
        return X.let(X.ctc_keep(ids, 32), lambda kept: F.struct(F.size(ids).cast("long").alias("frames"), F.size(kept).cast("long").alias("tokens"), total(kept).alias("checksum")))

    return frames(spark, d).select("doc_id", once(X.let(F.col("ids"), tally)))


@query(f"WITH {FRAMES} SELECT doc_id, count(*) AS tokens, round(sum(lp), 4) AS log_sum, round(exp(sum(lp) / count(*)), 6) AS confidence FROM kept GROUP BY doc_id")
def ctc_confidence(spark, d):
    """The token confidence of each line: exp of the mean log probability at each emission's first frame."""
    def tally(f):
        logs = lambda kept: F.aggregate(kept, F.lit(0.0), lambda a, i: a + F.ln((F.ascii(F.get(f["chars"], i)) % 89 + 10) / 100.0))
        return X.let(X.ctc_keep(f["ids"], 32), lambda kept: F.struct(F.size(kept).cast("long").alias("tokens"), logs(kept).alias("s")))

    k = frames(spark, d).select("doc_id", once(X.let(F.struct("chars", "ids"), tally), lambda t: t["tokens"] > 0))
    return k.select("doc_id", "tokens", F.round("s", 4).alias("log_sum"), r6(X.confidence(F.col("s"), F.col("tokens"))).alias("confidence"))


@query("""WITH f AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0),
 k AS (SELECT doc_id, i, c, (c IN ('e', chr(10))) AS space, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM f),
 e AS (SELECT * FROM k WHERE c <> ' ' AND (prev IS NULL OR c <> prev)),
 b AS (SELECT doc_id, min(i) FILTER (NOT space) AS lo, max(i) FILTER (NOT space) AS hi FROM e GROUP BY 1)
SELECT e.doc_id, count(*) AS emitted, count(*) FILTER (i BETWEEN lo AND hi) AS kept FROM e JOIN b ON b.doc_id = e.doc_id GROUP BY 1""")
def ctc_trim(spark, d):
    """Emissions without the white space (here e and line ends) at both ends; blank is a space."""
    def tally(c):
        places = X.ctc_keep(c, F.lit(" "))
        kept = lambda p: X.trimmed_places(p, F.transform(c, lambda x: x.isin("e", "\n")))
        return X.let(places, lambda p: F.struct(F.size(p).cast("long").alias("emitted"), F.size(kept(p)).cast("long").alias("kept")))

    t = spread(table(spark, d, "documents")).where("length(text) > 0")
    return t.select("doc_id", once(X.let(F.split("text", ""), tally), lambda t: t["emitted"] > 0))


@query("""WITH dim AS (SELECT * FROM (VALUES (0, 'a', NULL), (1, '<space>', NULL), (2, 'x', 'é'), (3, 'ß', 'ss'), (4, '!', NULL)) AS v(id, token, composite)),
 t AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_suppkey % 5 AS INT) AS id FROM lineitem)
SELECT t.id, CASE WHEN token = '<space>' THEN ' ' ELSE coalesce(composite, token) END AS printed, count(*) AS n FROM t JOIN dim ON t.id = dim.id GROUP BY 1, 2""")
def alphabet_lookup(spark, d):
    """Token ids by the alphabet, with composites; the alphabet is a model's fixed table."""
    dim = spark.createDataFrame([(0, "a", None), (1, "<space>", None), (2, "x", "é"), (3, "ß", "ss"), (4, "!", None)], "id int, token string, composite string")
    ids = table(spark, d, "lineitem").select((F.col("l_suppkey") % 5).cast("int").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ids.join(dim, "id").select("id", X.rendered(F.col("token"), F.col("composite")).alias("printed"), "n")


@query(r"""SELECT lang, CAST(sum(length(regexp_replace(text, '[^\p{Latin}]', '', 'g'))) AS BIGINT) AS latin, CAST(sum(length(regexp_replace(text, '[^\p{Nd}]', '', 'g'))) AS BIGINT) AS digits, CAST(sum(length(regexp_replace(text, '[^\p{Han}]', '', 'g'))) AS BIGINT) AS han,
 CAST(sum(length(regexp_replace(text, '[^\p{Hiragana}\p{Katakana}ーｰ]', '', 'g'))) AS BIGINT) AS kana, CAST(sum(length(regexp_replace(text, '[^\p{Hangul}]', '', 'g'))) AS BIGINT) AS hangul FROM documents GROUP BY lang""")
def char_classes(spark, d):
    """Characters of each class by language. One look at a text tells whether any letter is beyond Latin."""
    t = spread(table(spark, d, "documents")).withColumn("wide", F.col("text").rlike(r"[^\x{0000}-\x{024F}]"))
    count = lambda k: F.when(F.col("wide") | F.lit(k in ("latin", "digits")), X.class_count(F.col("text"), k)).otherwise(F.when(F.col("text").isNotNull(), 0))
    return t.groupBy("lang").agg(*[F.sum(count(k)).cast("long").alias(k) for k in ("latin", "digits", "han", "kana", "hangul")])


@query(r"""WITH v AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents)
SELECT token, regexp_matches(token, '^<.*>$') OR regexp_replace(token, '[\s\p{P}\p{S}\p{M}\p{Z}]|\p{Latin}', '', 'g') = '' AS latin_only,
 regexp_matches(token, '^<.*>$') OR regexp_replace(token, '[\s\p{P}\p{S}\p{M}\p{Z}]|\p{Nd}', '', 'g') = '' AS digits_only FROM v""")
def class_mask(spark, d):
    """Which tokens pass the masks of Latin letters and of digits."""
    v = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("token")).distinct()
    none = F.lit(None).cast("string")
    return v.select("token", X.allowed(F.col("token"), none, ["latin"]).alias("latin_only"), X.allowed(F.col("token"), none, ["digits"]).alias("digits_only"))


@query("""SELECT lang, count(*) AS documents, count(*) FILTER (nfc_normalize(text) = text) AS composed, CAST(sum(length(nfc_normalize(text || 'e' || chr(769)))) AS BIGINT) AS characters FROM documents GROUP BY lang""")
def nfc_text(spark, d):
    """Composed text by language; e and a combining accent are appended."""
    t = table(spark, d, "documents").select("lang", "text", X.nfc("text").alias("n"), X.nfc(F.concat("text", F.lit("é"))).alias("m"))
    return t.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(F.col("n") == F.col("text")).alias("composed"), F.sum(F.char_length("m")).cast("long").alias("characters"))


@query()
def inverse_bidi(spark, d):
    """Visual to logical order of every line of each document, between Hebrew words; lines count from 0."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line", "visual"))
    t = t.select("doc_id", "line", F.concat(F.lit("אבג "), F.col("visual"), F.lit(" דה")).alias("visual"))
    return t.select("doc_id", "line", X.inverse_bidi("visual").alias("logical"))


@query("""WITH n AS (SELECT part.p_partkey, part.p_name || part.p_brand || 'ONNXModel' AS name FROM part), s AS (SELECT p_partkey, regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g') AS a FROM n)
SELECT p_partkey, CASE WHEN b = '' THEN 'resource' ELSE b END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(a), '[^a-z0-9._-]+', '_', 'g'), '^[_.-]+|[_.-]+$', '', 'g') AS b FROM s)""".replace("\\\\", "\\"))
def slugs(spark, d):
    """File names for resources."""
    t = table(spark, d, "part").select("p_partkey", F.concat("p_name", "p_brand", F.lit("ONNXModel")).alias("name"))
    return t.select("p_partkey", X.slug(F.col("name")).alias("slug"))


@query("""SELECT doc_id, length(regexp_replace(chr(9) || chr(12288) || text || chr(10), '^[\\s\\x{3000}]+|[\\s\\x{3000}]+$', '', 'g')) AS characters FROM documents""".replace("\\\\", "\\"))
def trimmed_text(spark, d):
    """Text without white space of any kind at its ends."""
    return table(spark, d, "documents").select("doc_id", F.char_length(X.trimmed(F.concat(F.lit("\t　"), F.col("text"), F.lit("\n")))).cast("long").alias("characters"))


# ---------------------------------------------------------------- geometry


@query(f"""WITH {BOXES} SELECT page, count(*) AS boxes, min(x) AS x, min(y) AS y, max(x + width) AS right, round(sum(width * height), 3) AS area, count(*) FILTER (greatest(width, height) / least(width, height) <= 2) AS compact,
 max(round(greatest(width, height) / least(width, height), 6)) AS aspect FROM boxes GROUP BY page""")
def quad_geometry(spark, d):
    """Bounds, areas and shapes of a page's quads."""
    b = boxes(spark, d).select("page", G.rect("x", "y", "width", "height").alias("q"))
    b = b.select("page", "q", G.quad_bounds(F.col("q")).alias("b"), G.polygon_area(F.col("q")).alias("a"), G.region_aspect(F.col("q")).alias("r"))
    return b.groupBy("page").agg(F.count("*").alias("boxes"), F.min("b.x").alias("x"), F.min("b.y").alias("y"), F.max(F.col("b.x") + F.col("b.width")).alias("right"), F.round(F.sum("a"), 3).alias("area"), F.count_if(F.col("r") <= 2).alias("compact"), F.max(r6("r")).alias("aspect"))


@query(f"""WITH {BOXES}, p AS (SELECT page, seq, x, y, x + width AS r, y + height AS b, CAST(floor(x) AS BIGINT) % 20 + 5 AS u, CAST(floor(y) AS BIGINT) % 20 + 5 AS v FROM boxes),
 q AS (SELECT page, seq, x, y, CASE WHEN seq % 2 = 0 THEN [x, r, r, x] WHEN u >= v THEN [x - u, x, x + u, x] ELSE [x, x + u, x, x - u] END AS xs, CASE WHEN seq % 2 = 0 THEN [y, y, b, b] WHEN u >= v THEN [y, y - v, y, y + v] ELSE [y - v, y, y + v, y] END AS ys FROM p)
SELECT page, seq, x, y, xs[1] AS x0, ys[1] AS y0, xs[2] AS x1, ys[2] AS y1, xs[3] AS x2, ys[3] AS y2, xs[4] AS x3, ys[4] AS y3 FROM q""")
def ordered_corners(spark, d):
    """Shuffled corners of upright quads and of squares and rhombs on their corners, where equal x + y decide by x."""
    x, y, r, b = F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height")
    u, v = (F.floor(c).cast("long") % 20 + 5 for c in (x, y))
    upright = F.array(G.point(r, b), G.point(x, y), G.point(r, y), G.point(x, b))
    turned = F.array(G.point(x, y + v), G.point(x + u, y), G.point(x - u, y), G.point(x, y - v))
    q = boxes(spark, d).select("page", "seq", "x", "y", once(F.struct(G.ordered_quad(F.when(F.col("seq") % 2 == 0, upright).otherwise(turned)).alias("q"))))
    return q.select("page", "seq", "x", "y", *[F.col("q")[i][c].alias(f"{c}{i}") for i in range(4) for c in "xy"])


@query(f"""WITH {BOXES}, n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY seq, x, y, width, height, score) AS k FROM boxes),
 p AS (SELECT a.page, greatest(least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y), 0) AS i, a.width * a.height + b.width * b.height AS s FROM n a JOIN n b ON a.page = b.page AND a.k < b.k)
SELECT page, count(*) AS pairs, round(sum(i / greatest(s - i, 1e-6)), 6) AS iou FROM p WHERE i > 0 GROUP BY page""")
def overlap_pairs(spark, d):
    """Overlapping boxes of a page, found through a grid."""
    from pyspark.sql import Window as W

    n = boxes(spark, d).withColumn("k", F.row_number().over(W.partitionBy("page").orderBy("seq", "x", "y", "width", "height", "score")))
    return detect.overlaps(n, "page", "k").groupBy("page").agg(F.count("*").alias("pairs"), r6(F.sum("iou")).alias("iou"))


WIDE = """wide AS (SELECT page, seq, floor(x / 4) AS x, floor(y / 8) AS y, width + 40 AS width, height + 20 AS height, score FROM boxes)"""


@query(f"""WITH RECURSIVE {BOXES}, {WIDE}, n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, x, y, width, height) AS k FROM wide),
 f AS (SELECT page, k, [{{'x': x, 'y': y, 'w': width, 'h': height}}] AS kept FROM n WHERE k = 1
 UNION ALL SELECT n.page, n.k, CASE WHEN len(list_filter(f.kept, lambda b: greatest(least(b.x + b.w, n.x + n.width) - greatest(b.x, n.x), 0) * greatest(least(b.y + b.h, n.y + n.height) - greatest(b.y, n.y), 0)
  / greatest(b.w * b.h + n.width * n.height - greatest(least(b.x + b.w, n.x + n.width) - greatest(b.x, n.x), 0) * greatest(least(b.y + b.h, n.y + n.height) - greatest(b.y, n.y), 0), 1e-6) > 0.2)) > 0 THEN f.kept ELSE list_append(f.kept, {{'x': n.x, 'y': n.y, 'w': n.width, 'h': n.height}}) END
 FROM f JOIN n ON n.page = f.page AND n.k = f.k + 1)
SELECT f.page, CAST(f.k AS INT) AS candidates, CAST(len(f.kept) AS INT) AS kept, round(list_sum(list_transform(f.kept, lambda b: b.w * b.h)), 3) AS area FROM f JOIN (SELECT page, max(k) AS k FROM n GROUP BY 1) m ON m.page = f.page AND m.k = f.k""")
def suppressed(spark, d):
    """Greedy suppression of overlapping boxes by score."""
    b = boxes(spark, d).select("page", "seq", F.floor(F.col("x") / 4).cast("double").alias("x"), F.floor(F.col("y") / 8).cast("double").alias("y"), (F.col("width") + 40).alias("width"), (F.col("height") + 20).alias("height"), "score")
    got = detect.suppress(b, "page")
    area = F.aggregate("kept", F.lit(0.0), lambda a, k: a + k["width"] * k["height"])
    return got.select("page", "candidates", F.size("kept").alias("kept"), F.round(area, 3).alias("area"))


@query(f"""WITH {BOXES}, s AS (SELECT page, least(greatest(x * 2000 / 640.0e0, 0), 1999) AS x, least(greatest(y * 1500 / 480.0e0, 0), 1499) AS y FROM boxes)
SELECT page, round(sum(round_even(x * 1000, 0) / 1000), 3) AS x, round(sum(round_even(y * 1000, 0) / 1000), 3) AS y FROM s GROUP BY page""")
def rescaled_points(spark, d):
    """Points of a scaled page in the original, kept inside it and rounded half to even."""
    p = G.rescaled(G.point("x", "y"), F.lit(640.0), F.lit(480.0), F.lit(2000), F.lit(1500))
    b = boxes(spark, d).select("page", p.alias("p"))
    return b.groupBy("page").agg(F.round(F.sum(G.rounded(F.col("p.x"))), 3).alias("x"), F.round(F.sum(G.rounded(F.col("p.y"))), 3).alias("y"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 5000 + 2 AS INT) AS w, CAST(l_suppkey % 3000 + 2 AS INT) AS h FROM lineitem),
 s AS (SELECT w, h, least(1.0e0, 1600.0e0 / greatest(w, h)) AS scale FROM p), t AS (SELECT w, h, scale, greatest(1, round_even(w * scale, 0)) AS sw, greatest(1, round_even(h * scale, 0)) AS sh FROM s)
SELECT CAST(ceil(sw / 32) * 32 AS INT) AS padded_width, count(*) AS pages, round(avg(scale), 6) AS scale, CAST(max(ceil(sh / 32) * 32) AS INT) AS padded_height FROM t GROUP BY 1""")
def detector_sizes(spark, d):
    """Scaled and padded page sizes for the detector."""
    s = G.detector_scale(F.col("w"), F.col("h"))
    p = table(spark, d, "lineitem").select((F.col("l_partkey") % 5000 + 2).cast("int").alias("w"), (F.col("l_suppkey") % 3000 + 2).cast("int").alias("h")).select(s.alias("s"))
    return p.groupBy(F.col("s.padded_width").alias("padded_width")).agg(F.count("*").alias("pages"), r6(F.avg("s.scale")).alias("scale"), F.max("s.padded_height").alias("padded_height"))


@query("""WITH p AS (SELECT DISTINCT CAST(l_partkey % 1500 + 2 AS INT) AS w, CAST(l_suppkey % 60 + 4 AS INT) AS h FROM lineitem), t AS (SELECT w, h, CAST(ceil((greatest(8, round_even(w * 60 / CAST(h AS DOUBLE), 0)) + 32) / 8) * 8 AS INT) AS total FROM p)
SELECT w, h, CASE WHEN total <= 8192 THEN total END AS total FROM t""")
def line_sizes(spark, d):
    """Normalised line widths; a line over the widest has none."""
    p = table(spark, d, "lineitem").select((F.col("l_partkey") % 1500 + 2).cast("int").alias("w"), (F.col("l_suppkey") % 60 + 4).cast("int").alias("h")).distinct()
    return p.select("w", "h", G.line_width(F.col("w"), F.col("h")).alias("total"))


@query("""WITH p AS (SELECT DISTINCT CAST(l_partkey % 256 AS BIGINT) AS v, CAST(l_suppkey % 256 AS BIGINT) AS a FROM lineitem)
SELECT v, a, CAST((v * 257 * a // 255 + (255 - a) * 257) // 257 AS INT) AS straight, CASE WHEN v <= a THEN CAST(v + 255 - a AS INT) END AS premultiplied FROM p""")
def over_white(spark, d):
    """Channels composited on white, straight and premultiplied; a premultiplied channel over its alpha is an error, and is
    left out here."""
    p = table(spark, d, "lineitem").select((F.col("l_partkey") % 256).cast("long").alias("v"), (F.col("l_suppkey") % 256).cast("long").alias("a")).distinct()
    v, a = F.col("v"), F.col("a")
    return p.select("v", "a", G.composited(v, a).alias("straight"), F.when(v <= a, G.composited(v, a, True)).alias("premultiplied"))


@query()
def minimum_rectangles(spark, d):
    """The smallest rectangle around each page's box centres."""
    b = boxes(spark, d).select("page", (F.col("x") + F.col("width") / 2).alias("x"), (F.col("y") + F.col("height") / 2).alias("y"))
    got = detect.rectangles(b, ["page"])
    return got.select("page", F.round(G.polygon_area(F.col("quad")), 3).alias("area"))


# ---------------------------------------------------------------- routing and layout


@query(f"""WITH {LINES}, w AS (SELECT page, angle, CASE WHEN anchor THEN least(20, chars) ELSE 0 END AS w FROM lines), s AS (SELECT page, sum(w * cos(angle)) AS c, sum(w * sin(angle)) AS s, sum(w) AS w FROM w GROUP BY 1)
SELECT page, CASE WHEN w > 0 AND sqrt(c * c + s * s) / w >= 0.9 THEN round(atan2(s, c), 6) END AS page_angle FROM s""")
def page_orientation(spark, d):
    """The anchors' mean direction by page."""
    got = routing.page_orientation(lines(spark, d), "page", F.col("angle"), F.col("chars"), F.col("anchor"))
    return got.select("page", r6("page_angle").alias("page_angle"))


@query("""WITH a AS (SELECT event_id, (event_id % 629) / 100.0e0 - 3.14e0 AS page_angle, (event_id % 311) / 50.0e0 - 3.1e0 AS region FROM events), t AS (SELECT event_id, atan2(sin(page_angle - region), cos(page_angle - region)) AS delta FROM a),
 q AS (SELECT event_id, delta, sign(delta) * floor(abs(delta) / (pi() / 2) + 0.5) AS n FROM t)
SELECT event_id, CASE WHEN abs(delta - n * (pi() / 2)) <= pi() / 6 THEN CAST((CAST(n AS INT) + 4) % 4 AS INT) ELSE 0 END AS turns, CAST((360 - 90 * (CASE WHEN abs(delta - n * (pi() / 2)) <= pi() / 6 THEN (CAST(n AS INT) + 4) % 4 ELSE 0 END)) % 360 AS INT) AS rotation_degrees FROM q""")
def quarter_turns(spark, d):
    """Quarter turns from a region's direction to its page's."""
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") % 629) / 100.0 - 3.14).alias("p"), ((F.col("event_id") % 311) / 50.0 - 3.1).alias("r"))
    e = e.select("event_id", G.turns(F.col("p"), F.col("r")).alias("turns"))
    return e.select("event_id", "turns", G.rotation_degrees(F.col("turns")).alias("rotation_degrees"))


@query("""WITH r AS (SELECT event_id, (event_id % 9 - 4) * 0.7e0 AS flip, (event_id % 3 = 0) AS compact, (event_id % 2 = 0) AS vertical, 1 + (event_id % 40) / 10.0e0 AS aspect, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 0.1e0 END AS prior FROM events)
SELECT event_id, flip < 0 AND (NOT compact OR abs(flip) >= 2) AS flips, NOT compact AND abs(flip) >= 2 AND event_id % 6 >= 3 AND (event_id % 10) / 10.0e0 >= 0.8 AS anchor, vertical AND (NOT (aspect <= 2) OR (prior IS NULL AND aspect > 1.5)) AS vertical_read FROM r""")
def region_rules(spark, d):
    """Which regions are turned over, which are anchors, and which are read as columns."""
    e = F.col("event_id")
    compact, flip = e % 3 == 0, (e % 9 - 4) * 0.7
    prior = F.when(e % 5 == 0, F.lit(None).cast("double")).otherwise(0.1)
    return table(spark, d, "events").select(
        "event_id", X.flips(flip, compact).alias("flips"), X.is_anchor(compact, flip, F.repeat(F.lit("x"), (e % 6).cast("int")), (e % 10) / 10.0).alias("anchor"), routing.uses_vertical(e % 2 == 0, 1 + (e % 40) / 10.0, prior).alias("vertical_read")
    )


@query("""WITH t AS (SELECT event_id, CAST(event_id % 1200 AS VARCHAR) AS a, CAST(event_id % 400 AS VARCHAR) AS b, (event_id % 100) / 100.0e0 AS ca, (event_id % 50) / 50.0e0 AS cb FROM events)
SELECT event_id, regexp_matches(a, '^[0-9]{1,3}$') AND a = b AND ca >= 0.9 AND cb >= 0.5 AS agreed FROM t""")
def numeral_consensus(spark, d):
    """Short numerals that two recognisers agree on."""
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", X.numeric_consensus((e % 1200).cast("string"), (e % 100) / 100.0, (e % 400).cast("string"), (e % 50) / 50.0).alias("agreed"))


@query(f"WITH {LINES} SELECT script, count(*) AS skipped FROM lines WHERE script NOT IN ('Latin', 'CJK') GROUP BY script")
def skipped_scripts(spark, d):
    """Lines whose script has no recogniser."""
    names = spark.createDataFrame([("Latin",), ("CJK",)], "script string")
    return routing.available(lines(spark, d), names)[1]


@query(f"WITH {LINES} SELECT page, round(atan2(sum(sin(angle)), sum(cos(angle))), 6) AS layout_angle FROM lines GROUP BY page")
def layout_angle(spark, d):
    got = layout.layout_angle(lines(spark, d), "page", F.col("angle"))
    return got.select("page", r6("layout_angle").alias("layout_angle"))


@query(f"""WITH {BOXES}, g AS (SELECT page, y - max(y + height) OVER (PARTITION BY page ORDER BY y, height, x, width, seq, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM boxes)
SELECT page, count(*) AS boxes, count(*) FILTER (gap > 2) AS cuts, max(gap) AS widest FROM g GROUP BY page""")
def layout_gaps(spark, d):
    """Gaps between a page's boxes from top to bottom."""
    g = layout.gaps(boxes(spark, d), "page", "y", "height", ("height", "x", "width", "seq", "score"))
    return g.groupBy("page").agg(F.count("*").alias("boxes"), F.count_if(F.col("gap") > 2).alias("cuts"), F.max("gap").alias("widest"))


@query()
def reading_order(spark, d):
    """Recursive cuts of each page; a checksum of the order of box numbers."""
    from pyspark.sql import Window as W

    n = boxes(spark, d).withColumn("k", F.row_number().over(W.partitionBy("page").orderBy("seq", "x", "y", "width", "height", "score")))
    got = layout.in_reading_order(n, "page", "k")
    return got.groupBy("page").agg(F.count("*").alias("boxes"), F.sum((F.col("position") + 1) * F.col("k")).cast("long").alias("checksum"))


@query(f"WITH {LINES} SELECT page, 2 * count(*) FILTER (script IN ('Arabic', 'Hebrew')) > count(*) AS rtl FROM lines GROUP BY page")
def rtl_vote(spark, d):
    return layout.is_rtl(lines(spark, d), "page")


@query(f"""WITH {LINES}, k AS (SELECT page, tokens, log_sum, coalesce(CASE WHEN tokens > 0 THEN exp(log_sum / tokens) END >= 0.75, false) AS stays FROM lines WHERE text <> '')
SELECT page, count(*) FILTER (stays) AS lines, count(*) FILTER (NOT stays) AS filtered, CASE WHEN sum(tokens) FILTER (stays) > 0 THEN round(exp(sum(log_sum) FILTER (stays) / sum(tokens) FILTER (stays)), 6) END AS confidence FROM k GROUP BY page""")
def page_confidence(spark, d):
    """Pooled token confidence of each page after the line filter."""
    s = page.summary(lines(spark, d), "page", 0.75)
    return s.select("page", "lines", "filtered", r6("confidence").alias("confidence"))


@query(f"""WITH {LINES}, s AS (SELECT page, count(*) FILTER (script = 'Arabic') AS a, count(*) FILTER (script = 'Hebrew') AS h, count(*) FILTER (text = '') AS f FROM lines GROUP BY page)
SELECT page, array_to_string(list_filter([CASE WHEN a > 0 THEN 'Skipped ' || a || ' line(s) classified as Arabic: recognizer not included in this model package.' END, CASE WHEN h > 0 THEN 'Skipped ' || h || ' line(s) classified as Hebrew: recognizer not included in this model package.' END,
 CASE WHEN f > 0 THEN 'Filtered ' || f || ' line(s) below min_line_confidence 0.500.' END], lambda x: x IS NOT NULL), '|') AS warnings FROM s""")
def page_warnings(spark, d):
    s = lines(spark, d).groupBy("page").agg(F.count_if(F.col("script") == "Arabic").alias("a"), F.count_if(F.col("script") == "Hebrew").alias("h"), F.count_if(F.col("text") == "").alias("f"))
    return s.select("page", F.array_join(page.warnings(F.create_map(F.lit("Arabic"), F.col("a"), F.lit("Hebrew"), F.col("h")), F.col("f"), 0.5), "|").alias("warnings"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def page_text(spark, d):
    """A conversation's turns as the lines of a page."""
    return layout.page_text(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT l_returnflag, count(*) AS shown FROM lineitem WHERE 1 - l_discount * 4 >= 0.7 AND 1 - l_tax * 4 >= 0.7 GROUP BY 1")
def display_filter(spark, d):
    """Lines that a rendering shows."""
    t = table(spark, d, "lineitem")
    return page.displayed(t, 1 - F.col("l_discount") * 4, 1 - F.col("l_tax") * 4).groupBy("l_returnflag").agg(F.count("*").alias("shown"))


CENTERS = [40.0, 190.0, 320.0, 450.0, 580.0, 720.0]


@query(f"""WITH {BOXES}, c AS (SELECT page, y, list_transform({CENTERS!r}, lambda m: abs(x - m)) AS far FROM boxes)
SELECT CAST(round_even((y - 200.16) / 21.33, 0) AS INT) AS "row", CAST(list_position(far, list_min(far)) - 1 AS INT) AS "column", count(*) AS lines FROM c GROUP BY 1, 2""")
def nearest_cell(spark, d):
    """Lines by their nearest table cell."""
    got = routing.nearest_cell(boxes(spark, d), F.col("x"), F.col("y"), CENTERS, 200.16, 21.33)
    return got.groupBy("row", "column").agg(F.count("*").alias("lines"))


# ---------------------------------------------------------------- evaluation and batches


@query("""WITH t AS (SELECT item_id, CAST(item_id % 3 AS VARCHAR) AS corpus, regexp_replace(text, '[^ -~]', '', 'g') AS expected FROM benchmark), a AS (SELECT corpus, expected, regexp_replace(expected, '[aeiou]', CASE WHEN item_id % 2 = 0 THEN '' ELSE 'u' END, 'g') AS actual FROM t)
SELECT corpus, count(*) AS cases, count(*) FILTER (expected = actual) AS exact_matches, CAST(sum(levenshtein(expected, actual)) AS BIGINT) AS character_errors, CAST(sum(length(expected)) AS BIGINT) AS reference_characters, round(sum(levenshtein(expected, actual)) / greatest(1, sum(length(expected))), 6) AS character_error_rate FROM a GROUP BY corpus""")
def character_error_rate(spark, d):
    """Edit distance of recognised to expected text by corpus, over whole texts; text is reduced to ASCII, as the SQL counts
    bytes."""
    t = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 3).cast("string").alias("corpus"), F.regexp_replace("text", "[^ -~]", "").alias("expected"))
    vowel = F.when(F.col("item_id") % 2 == 0, "").otherwise("u")
    actual = t.select("item_id", F.regexp_replace(F.col("expected"), F.lit("[aeiou]"), vowel).alias("actual"))
    got = evaluate.error_rates(evaluate.cases(t, actual, "item_id"), "corpus")
    return got.withColumn("character_error_rate", r6("character_error_rate"))


@query("""WITH t AS (SELECT event_id, event_type AS corpus, CAST(event_id % 97 AS VARCHAR) AS expected, CAST(event_id % 89 AS VARCHAR) AS actual, value AS s FROM events WHERE value IS NOT NULL),
 r AS (SELECT corpus, count(*) AS cases, count(*) FILTER (expected = actual) AS exact_matches, CAST(sum(levenshtein(expected, actual)) AS BIGINT) AS character_errors, CAST(sum(length(expected)) AS BIGINT) AS reference_characters, round(sum(levenshtein(expected, actual)) / greatest(1, sum(length(expected))), 6) AS character_error_rate, round(median(s), 6) AS median_seconds FROM t GROUP BY GROUPING SETS ((corpus), ()))
SELECT * FROM r""")
def evaluation_report(spark, d):
    """The full report: each corpus and, with a null corpus, all cases, with median seconds."""
    e = table(spark, d, "events").where("value IS NOT NULL")
    t = e.select("event_id", F.col("event_type").alias("corpus"), (F.col("event_id") % 97).cast("string").alias("expected"))
    cases = evaluate.cases(t, e.select("event_id", (F.col("event_id") % 89).cast("string").alias("actual")), "event_id").join(e.select("event_id", F.col("value").alias("elapsed_seconds")), "event_id")
    return evaluate.report(cases).withColumns({"character_error_rate": r6("character_error_rate"), "median_seconds": r6("median_seconds")})


@query("""SELECT event_type, count(*) AS runs, list_sort(list(value))[least(count(*) - 1, CAST(round_even((count(*) - 1) * 0.5e0, 0) AS BIGINT)) + 1] AS p50, list_sort(list(value))[least(count(*) - 1, CAST(round_even((count(*) - 1) * 0.95e0, 0) AS BIGINT)) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1""")
def latency_percentiles(spark, d):
    """Percentiles by the report's rule, exact for groups of any size."""
    return evaluate.grouped_percentiles(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT event_type, count(*) AS items, round(1 / avg(value + 1), 6) AS items_per_second FROM events GROUP BY 1")
def batch_throughput(spark, d):
    e = table(spark, d, "events").withColumn("s", F.col("value") + 1)
    return evaluate.throughput(e, "event_type", "s").select("event_type", "items", r6("items_per_second").alias("items_per_second"))


@query("SELECT event_type, count(*) AS runs, round(sum(value), 3) AS run_seconds FROM events GROUP BY 1")
def stage_diagnostics(spark, d):
    """Runs and seconds of each stage."""
    return evaluate.diagnostics(table(spark, d, "events"), "event_type", "value").withColumn("run_seconds", F.round("run_seconds", 3))


@query("""WITH e AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'deadline' WHEN page_id % 7 = 1 THEN 'path' WHEN page_id % 7 < 5 THEN 'other' END AS failure, CASE page_id % 7 WHEN 2 THEN 'unavailable script Thai' WHEN 3 THEN 'image: unknown' WHEN 4 THEN 'tensor shape' ELSE 'x' END AS message, length(html) AS n FROM pages)
SELECT page_id AS index, CASE WHEN failure IS NULL THEN n END AS result, CASE WHEN failure IS NULL THEN NULL WHEN failure = 'deadline' THEN 'timeout' WHEN failure = 'path' OR message LIKE 'image:%' THEN 'invalid_input' WHEN message LIKE '%unavailable script%' THEN 'unsupported' ELSE 'inference' END AS code FROM e""")
def batch_items(spark, d):
    """Requests with a result or an error each, never both."""
    p, k = table(spark, d, "pages"), F.col("page_id") % 7
    failure = F.when(k == 0, "deadline").when(k == 1, "path").when(k < 5, "other")
    message = F.when(k == 2, "unavailable script Thai").when(k == 3, "image: unknown").when(k == 4, "tensor shape").otherwise("x")
    got = batch.items(p, F.char_length("html").cast("long"), failure, message, F.col("page_id"))
    return got.select("index", "result", F.col("error.code").alias("code"))


@query("""WITH g AS (SELECT doc_id, text, lang FROM documents), a AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN upper(text) ELSE text END AS text, lang FROM documents WHERE doc_id % 19 <> 0),
 x AS (SELECT * FROM g EXCEPT ALL SELECT * FROM a), y AS (SELECT * FROM a EXCEPT ALL SELECT * FROM g) SELECT 'golden' AS side, count(*) AS rows FROM x UNION ALL SELECT 'actual', count(*) FROM y""")
def golden_difference(spark, d):
    """Rows in which results differ from the golden ones, times aside."""
    t = table(spark, d, "documents").select("doc_id", "text", "lang", F.rand(1).alias("elapsed_seconds"))
    actual = t.where("doc_id % 19 <> 0").withColumn("text", F.when(F.col("doc_id") % 17 == 0, F.upper("text")).otherwise(F.col("text")))
    return evaluate.differences(t, actual).groupBy("side").agg(F.count("*").alias("rows"))


@query("""SELECT CAST(doc_id AS VARCHAR) || '.txt' AS path, CASE WHEN doc_id % 23 = 0 THEN 'missing' WHEN doc_id % 29 = 0 THEN 'wrong size' WHEN doc_id % 31 = 0 THEN 'wrong hash' END AS problem FROM documents WHERE doc_id % 23 = 0 OR doc_id % 29 = 0 OR doc_id % 31 = 0""")
def manifest_check(spark, d):
    """A package's files against its manifest; every 23rd file is missing, every 29th has another size, every 31st another hash."""
    t = table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    files = t.where("doc_id % 23 <> 0").select("path", (F.col("size") + F.when(F.col("doc_id") % 29 == 0, 1).otherwise(0)).alias("size"), F.when(F.col("doc_id") % 31 == 0, F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return batch.check_manifest(t.drop("doc_id"), files)


@query("""WITH RECURSIVE r AS (SELECT DISTINCT l_orderkey % 5000 AS name, l_partkey % 5000 AS need FROM lineitem), c AS (SELECT 3 AS name UNION SELECT r.need FROM c JOIN r ON r.name = c.name) SELECT CAST(name AS BIGINT) AS name FROM c""")
def needed_resources(spark, d):
    """All that a resource needs, over any number of steps; every row is an edge."""
    r = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 5000).alias("name")).agg(F.collect_set(F.col("l_partkey") % 5000).alias("needs"))
    return batch.needed(r, spark.createDataFrame([(3,)], "name long"))


@query("""SELECT row_number() OVER (ORDER BY event_id) - 1 AS index, event_id, user_id FROM events""")
def batch_index(spark, d):
    """Requests numbered in their order."""
    return batch.indexed(table(spark, d, "events").select("event_id", "user_id"), "event_id").select("index", "event_id", "user_id")


@query("""SELECT lower(p_brand) AS path, count(*) AS copies FROM part GROUP BY 1 HAVING count(*) > 1""")
def duplicate_names(spark, d):
    """Names that stand more than once."""
    return batch.duplicates(table(spark, d, "part").select(F.col("p_brand").alias("path")))


@query("""WITH h AS (SELECT 2 + l_linenumber % 3 AS level, CASE WHEN l_orderkey % 2 = 0 THEN 'horizontal' ELSE 'vertical' END AS direction FROM lineitem) SELECT level, direction, count(*) AS regions FROM h GROUP BY 1, 2""")
def detector_heads(spark, d):
    """The regions of all six detector heads as one table; every row belongs to a head."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    level, vertical = 2 + F.col("l_linenumber") % 3, F.col("l_orderkey") % 2 == 1
    heads = {(n, way): t.where((level == n) & (vertical == (way == "vertical"))) for n, way in detect.HEADS}
    return detect.union_heads(heads).groupBy("level", "direction").agg(F.count("*").alias("regions"))


# ---------------------------------------------------------------- composed operations


@query(f"""WITH RECURSIVE e AS (SELECT vec_id AS page, 40 + vec_id % 50 AS w, 30 + vec_id % 30 AS h, list_transform(embedding, lambda x: CAST({SCORE} AS FLOAT)) AS s FROM embeddings),
 c AS (SELECT page, w, h, t.cell, CAST(s[t.cell + 1] AS DOUBLE) AS score, (t.cell % 8) * 4 + 1.5e0 AS cx, (t.cell // 8) * 4 + 1.5e0 AS cy FROM e, range(0, 64) AS t(cell) WHERE s[t.cell + 1] >= 0.52),
 q AS (SELECT page, cell, score, greatest(cx - 9.3e0, 0) AS x, greatest(cy - 9.3e0, 0) AS y, least(cx + 9.3e0, w - 1) AS r, least(cy + 9.3e0, h - 1) AS b FROM c),
 n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, cell) AS k FROM q WHERE (r - x) * (b - y) >= 12),
 f AS (SELECT page, k, [{{'x': x, 'y': y, 'r': r, 'b': b, 's': score}}] AS kept FROM n WHERE k = 1
 UNION ALL SELECT n.page, n.k, CASE WHEN len(list_filter(f.kept, lambda o: greatest(least(o.r, n.r) - greatest(o.x, n.x), 0) * greatest(least(o.b, n.b) - greatest(o.y, n.y), 0)
  / greatest((o.r - o.x) * (o.b - o.y) + (n.r - n.x) * (n.b - n.y) - greatest(least(o.r, n.r) - greatest(o.x, n.x), 0) * greatest(least(o.b, n.b) - greatest(o.y, n.y), 0), 1e-6) > 0.2)) > 0 THEN f.kept ELSE list_append(f.kept, {{'x': n.x, 'y': n.y, 'r': n.r, 'b': n.b, 's': n.score}}) END
 FROM f JOIN n ON n.page = f.page AND n.k = f.k + 1)
SELECT e.page, coalesce(len(f.kept), 0) AS regions, round(list_sum(list_transform(f.kept, lambda o: o.x + 2 * o.y + 3 * (o.r - o.x) + 4 * (o.b - o.y))), 4) AS places, round(list_sum(list_transform(f.kept, lambda o: o.s)), 5) AS score
FROM e LEFT JOIN (SELECT page, max(k) AS k FROM n GROUP BY 1) m ON m.page = e.page LEFT JOIN f ON f.page = m.page AND f.k = m.k""")
def detected_regions(spark, d):
    """Detection as one operation: 8 x 8 score maps to regions that do not overlap. Each cell proposes the square around it."""
    m = maps(spark, d).select(F.col("vec_id").alias("page"), "scores")
    corners = [(-0.3, -0.3), (0.3, -0.3), (0.3, 0.3), (-0.3, 0.3)]
    deltas = F.flatten(F.array(*[F.array_repeat(F.lit(v), 64) for xy in corners for v in xy]))
    heads = m.select("page", F.lit(2).alias("level"), F.lit("horizontal").alias("direction"), F.lit(8).alias("columns"), F.transform("scores", lambda x: x.cast("float")).alias("scores"), deltas.alias("deltas"), F.array_repeat(F.lit(0.0), 512).alias("links"))
    pages = m.select("page", (40 + F.col("page") % 50).cast("int").alias("width"), (30 + F.col("page") % 30).cast("int").alias("height"))
    got = detect.detect(heads, pages, "page", 0.52, {2: 0.5})
    place = F.aggregate("regions", F.lit(0.0), lambda a, r: a + r["bbox"]["x"] + 2 * r["bbox"]["y"] + 3 * r["bbox"]["width"] + 4 * r["bbox"]["height"])
    some = F.size("regions") > 0
    return got.select("page", F.size("regions").cast("long").alias("regions"), F.when(some, F.round(place, 4)).alias("places"), F.when(some, F.round(F.aggregate("regions", F.lit(0.0), lambda a, r: a + r["score"]), 5)).alias("score"))


REGIONS = f"""{BOXES}, regions AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY seq, x, y, width, height, score) - 1 AS seq, x, y, width AS w, height AS h, seq % 2 = 1 AS vertical, score FROM boxes)"""


def region_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their upright regions, as detection gives them."""
    b = boxes(spark, d)
    quad = G.rect("x", "y", "width", "height")
    region = F.struct(quad.alias("quad"), G.quad_bounds(quad).alias("bbox"), "score", (F.col("seq") % 2 == 1).alias("vertical"))
    all_ = F.array_sort(F.collect_list(F.struct("seq", "x", "y", "width", "height", "score", region.alias("region"))))
    return b.groupBy("page").agg(F.transform(all_, lambda r: r["region"]).alias("regions")).select("page", F.lit(900).alias("width"), F.lit(700).alias("height"), "regions")


def stand_in_classifier(df: DataFrame) -> DataFrame:
    """Script and turn by arithmetic on a region's place."""
    x, y = F.col("bbox.x").cast("long"), F.col("bbox.y").cast("long")
    script = F.when(x % 4 == 0, "Latin").when(x % 4 == 1, "CJK").when(x % 4 == 2, "").otherwise("Arabic")
    return df.withColumns({"script": script, "flip": ((x + y) % 9 - 4) * 0.7})


def stand_in_reader(df: DataFrame, reader: str) -> DataFrame:
    """Text by arithmetic on a region's place: numerals where the classifier names no script, else words."""
    x, y = F.col("bbox.x").cast("long"), F.col("bbox.y").cast("long")
    numeral = (x + F.when((F.col(reader) == "CJK") & (y % 3 == 0), 1).otherwise(0)).cast("string")
    text = F.when(F.col(reader).isNotNull(), F.when(x % 4 == 2, numeral).when(y % 29 == 0, "").otherwise(F.concat(F.lit("t"), x.cast("string"))))
    return df.withColumns({"text": text, "tokens": F.char_length(text), "log_sum": -(y % 11) * 0.03 * F.char_length(text)})


PAGE_SQL = f"""WITH {REGIONS}, c AS (SELECT *, CAST(x AS BIGINT) AS u, CAST(y AS BIGINT) AS v, greatest(w, h) / least(w, h) AS aspect, ((CAST(x AS BIGINT) + CAST(y AS BIGINT)) % 9 - 4) * 0.7e0 AS flip,
  CASE CAST(x AS BIGINT) % 4 WHEN 0 THEN 'Latin' WHEN 1 THEN 'CJK' WHEN 2 THEN '' ELSE 'Arabic' END AS script, greatest(2, round_even(h, 0)) > greatest(2, round_even(w, 0)) AS tall FROM regions),
 t AS (SELECT *, aspect <= 2 AS compact, CASE WHEN v % 29 = 0 THEN '' ELSE 't' || u END AS word, exp(-(v % 11) * 0.03e0) AS conf FROM c),
 one AS (SELECT *, CASE WHEN script IN ('Latin', 'CJK') THEN word ELSE '' END AS text, (CASE WHEN vertical AND tall THEN 1 ELSE 0 END + CASE WHEN flip < 0 THEN 2 ELSE 0 END) % 4 AS quarter FROM t WHERE NOT compact),
 o AS (SELECT page, sum(wt * cos(quarter * pi() / 2)) AS c, sum(wt * sin(quarter * pi() / 2)) AS s, sum(wt) AS wt FROM (SELECT *, least(20, length(text)) AS wt FROM one WHERE abs(flip) >= 2 AND length(text) >= 3 AND conf >= 0.8) GROUP BY 1),
 p AS (SELECT page, CASE WHEN sqrt(c * c + s * s) / wt >= 0.9 THEN atan2(s, c) END AS prior FROM o),
 two AS (SELECT t.*, CASE WHEN script IN ('Latin', 'CJK') THEN word WHEN script = '' AND score >= 0.8 AND conf >= 0.9 AND length(CAST(u AS VARCHAR)) <= 3 AND v % 3 <> 0 THEN CAST(u AS VARCHAR) ELSE '' END AS text,
  CAST((CASE WHEN prior IS NOT NULL THEN (sign(prior) * floor(abs(prior) / (pi() / 2) + 0.5) + 4) % 4 WHEN vertical AND aspect > 1.5 AND tall THEN 1 ELSE 0 END + CASE WHEN flip <= -2 THEN 2 ELSE 0 END) % 4 AS INT) AS quarter FROM t LEFT JOIN p ON p.page = t.page WHERE compact),
 r AS (SELECT page, seq, script, word, text, conf, quarter FROM one UNION ALL SELECT page, seq, script, word, text, conf, quarter FROM two)"""


@query(PAGE_SQL + """ SELECT page, count(*) FILTER (text <> '' AND conf >= 0.8) AS lines, coalesce(string_agg(text, chr(10) ORDER BY seq) FILTER (text <> '' AND conf >= 0.8), '') AS text,
 round(exp(sum(ln(conf) * length(text)) FILTER (text <> '' AND conf >= 0.8) / sum(length(text)) FILTER (text <> '' AND conf >= 0.8)), 6) AS confidence, coalesce(CAST(sum((360 - 90 * quarter) % 360) FILTER (text <> '' AND conf >= 0.8) AS BIGINT), 0) AS degrees,
 count(*) FILTER (text <> '' AND conf >= 0.8 AND quarter >= 2) AS rotated, CAST(1 + CAST(count(*) FILTER (text = '' AND script = 'Arabic') > 0 AS INT) + CAST(count(*) FILTER (text <> '' AND conf < 0.8) > 0 AS INT) AS INT) AS warnings FROM r GROUP BY page""")
def recognised_pages(spark, d):
    """Recognition of pages as one operation, with stand-in models: two passes, the page's direction, numerals, filter, text."""
    got = recognise.recognise(region_pages(spark, d), "page", stand_in_classifier, stand_in_reader, ["Latin", "CJK"], reading_order="none", min_line_confidence=0.8)
    r, total = F.col("result"), lambda f, zero: F.aggregate("result.lines", F.lit(zero), lambda a, x: a + f(x))
    return got.select(
        "page", F.size("result.lines").cast("long").alias("lines"), r["text"].alias("text"), r6(r["confidence"]).alias("confidence"), total(lambda x: x["rotation_degrees"], 0).cast("long").alias("degrees"),
        total(lambda x: x["rotated_180"].cast("int"), 0).cast("long").alias("rotated"), F.size("result.warnings").alias("warnings"),
    )


@query()
def recognised_in_order(spark, d):
    """As recognised_pages, without a filter and in reading order, which SQL cannot express."""
    got = recognise.recognise(region_pages(spark, d), "page", stand_in_classifier, stand_in_reader, ["Latin", "CJK"])
    return got.select("page", "result.text", r6("result.confidence").alias("confidence"), F.array_join("result.warnings", "|").alias("warnings"))


@query(f"""WITH {BOXES}, c AS (SELECT page, seq, CAST(x AS BIGINT) AS u, CAST(y AS BIGINT) AS v, width AS w, height AS h, greatest(width, height) <= 2 * least(width, height) AS compact FROM boxes),
 t AS (SELECT *, CASE u % 4 WHEN 0 THEN 'Latin' WHEN 1 THEN 'CJK' WHEN 2 THEN '' ELSE 'Arabic' END AS script, ((u + v) % 9 - 4) * 0.7e0 AS flip, exp(-(v % 11) * 0.03e0) AS conf FROM c),
 r AS (SELECT *, compact AND script = '' AND conf >= 0.9 AND length(CAST(u AS VARCHAR)) <= 3 AND v % 3 <> 0 AS numeral FROM t), s AS (SELECT *, CASE WHEN script IN ('Latin', 'CJK') THEN CASE WHEN v % 29 = 0 THEN '' ELSE 't' || u END WHEN numeral THEN CAST(u AS VARCHAR) ELSE '' END AS text FROM r)
SELECT page, seq, u AS x, v AS y, CASE WHEN script = 'Arabic' THEN NULL ELSE text END AS text, CASE WHEN script <> 'Arabic' AND text <> '' THEN round(conf, 6) END AS confidence, CASE WHEN script = 'Arabic' THEN NULL WHEN numeral THEN 'Latin' ELSE script END AS script,
 CASE WHEN script = 'Arabic' THEN NULL ELSE CAST(CASE WHEN flip < 0 AND (NOT compact OR flip <= -2) THEN 180 ELSE 0 END AS INT) END AS degrees, CASE WHEN script = 'Arabic' THEN 'unsupported' END AS error FROM s""")
def recognised_lines(spark, d):
    """Recognition of single lines as one operation, with stand-in models."""
    b = boxes(spark, d).select("page", "seq", F.struct("x", "y").alias("bbox"), "width", "height")
    got = recognise.recognise_lines(b, stand_in_classifier, stand_in_reader, ["Latin", "CJK"])
    r = F.col("result")
    return got.select("page", "seq", F.col("bbox.x").cast("long").alias("x"), F.col("bbox.y").cast("long").alias("y"), r["text"].alias("text"), r6(r["confidence"]).alias("confidence"), r["script"].alias("script"), r["rotation_degrees"].alias("degrees"), F.col("error.code").alias("error"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'C:\\b\\Model_Edge\\Detector\\' || p_brand || '\\ONNX\\c.onnx' WHEN 1 THEN 'Model_Edge/Character/' || p_brand || '/char2ind.txt' WHEN 2 THEN 'model_edge/AuxMltCls/x/y.onnx' WHEN 3 THEN p_brand || '.onnx' WHEN 4 THEN 'Enums/x/' || p_brand || '.txt' ELSE 'a/b/' || p_brand END AS original, p_brand FROM part),
 s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(p_brand, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9._-]+', '_', 'g'), '^[_.-]+|[_.-]+$', '', 'g') AS slug FROM n),
 l AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9._-]+', '_', 'g'), '^[_.-]+|[_.-]+$', '', 'g') AS low FROM n)
SELECT s.p_partkey, CASE s.p_partkey % 6 WHEN 0 THEN 'models/detection/' || slug || '.onnx' WHEN 1 THEN 'data/recognition/' || slug || '/alphabet.txt' WHEN 2 THEN 'models/classification/script_orientation.onnx' WHEN 3 THEN 'models/' || slug || '.onnx' WHEN 4 THEN 'data/enums/' || low || '.txt' ELSE 'data/' || slug END AS file FROM s JOIN l ON l.p_partkey = s.p_partkey""".replace("\\\\", "\\"))
def resource_names(spark, d):
    """Standard names of a package's resources."""
    k, brand = F.col("p_partkey") % 6, F.col("p_brand")
    original = (
        F.when(k == 0, F.concat(F.lit("C:\\b\\Model_Edge\\Detector\\"), brand, F.lit("\\ONNX\\c.onnx"))).when(k == 1, F.concat(F.lit("Model_Edge/Character/"), brand, F.lit("/char2ind.txt"))).when(k == 2, "model_edge/AuxMltCls/x/y.onnx")
        .when(k == 3, F.concat(brand, F.lit(".onnx"))).when(k == 4, F.concat(F.lit("Enums/x/"), brand, F.lit(".txt"))).otherwise(F.concat(F.lit("a/b/"), brand))
    )
    return table(spark, d, "part").select("p_partkey", X.filename_of(original).alias("file"))
