import shutil

import corpus_pipeline

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def test_ops_are_registered():
    names = {n.split("_")[0] for n in entry.queries()}
    assert {f"op{i}" for i in range(1, 11)} | {"pipeline"} <= names


def test_pipeline(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    out = docs
    for name in list(stages)[:-1]:
        before, out = out, corpus_pipeline.materialise(stages[name](spark, out, D), name)
        assert out.columns == docs.columns and 0 < out.count() <= before.count()
    pieces = corpus_pipeline.run(spark, D)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in out.select("doc_id").collect()}


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{D}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{D}/labels.parquet", tmp_path / "labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in entry.queries().items():
        if name.startswith("op"):
            assert query(spark, str(tmp_path)).count() == 0, name
