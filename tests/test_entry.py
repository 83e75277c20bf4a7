import re

import duckdb
import pytest

import __spark_entry__ as entry
from glyphframe.functions.kernels import visual_to_logical
from glyphframe.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "lineitem events documents embeddings pages benchmark labels conversations part".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = con.execute(SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    order = lambda rows: sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])
    want = order([tuple(r[names.index(c)] for c in cols) for r in got.fetchall()])
    assert order([tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]) == want


def test_reading_order_keeps_every_box(spark):
    assert QUERIES["reading_order"](spark, D).agg({"boxes": "sum"}).first()[0] == spark.read.parquet(f"{D}/lineitem.parquet").count()


def test_inverse_bidi_takes_every_line(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").collect()
    want = {(r.doc_id, i): visual_to_logical(f"אבג {x} דה") for r in docs for i, x in enumerate(r.text.split("\n"))}
    got = QUERIES["inverse_bidi"](spark, D).collect()
    assert len(got) == len(want) > len(docs) and {(r.doc_id, r.line): r.logical for r in got} == want


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rate_takes_whole_texts(spark, tmp_path):
    words = "late errors behind the two hundredth character count as well "
    items = [(i, words * (1 + 3 * (i % 2)) + "aé" * i) for i in range(8)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {}
    for i, text in items:
        expected = re.sub("[^ -~]", "", text)
        errors = edit_distance(expected, re.sub("[aeiou]", "" if i % 2 == 0 else "u", expected))
        old = want.get(str(i % 3), (0, 0, 0))
        want[str(i % 3)] = (old[0] + 1, old[1] + errors, old[2] + len(expected))
    got = QUERIES["character_error_rate"](spark, str(tmp_path)).collect()
    assert {r.corpus: (r.cases, r.character_errors, r.reference_characters) for r in got} == want
