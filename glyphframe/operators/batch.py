"""Batches whose items fail one by one, package manifests, and the plug-in for models."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import error_code
from ..storage import materialise


def items(requests: DataFrame, result: Column, failure: Column, message: Column, index: Column) -> DataFrame:
    """(index, result, error): exactly one of result and error; failure: null for success, else the kind of failure."""
    code = error_code(failure, message)
    return requests.select(index.alias("index"), F.when(failure.isNull(), result).alias("result"), F.when(failure.isNotNull(), F.struct(code.alias("code"), message.alias("message"))).alias("error"))


def as_json(items_: DataFrame) -> DataFrame:
    """One JSON object an item; what is null has no key."""
    return items_.select(F.to_json(F.struct(*items_.columns), {"ignoreNullFields": "true"}).alias("json"))


Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def scored(rows: DataFrame, make: Callable[[], Scorer], schema: str | T.StructType, timeout: float | None = None) -> DataFrame:
    """A model over batches: make() loads it once in each worker and returns a function from a frame to one of schema, which
    has an error column (code, message) last. A batch that fails is tried row by row, so that only bad rows have errors, each
    with its own cause. timeout: seconds that one call of the model may take; what took longer timed out."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = [f.name for f in fields]

    def failure(e: Exception) -> str:
        if isinstance(e, TimeoutError):
            return "timeout"
        if isinstance(e, (ValueError, OSError)):
            return "unsupported" if "unsupported" in str(e) else "invalid_input"
        return "inference"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()

        def timed(pdf: pd.DataFrame) -> pd.DataFrame:
            began = time.monotonic()
            out = scorer(pdf)[names]
            if timeout is not None and time.monotonic() - began > timeout:
                raise TimeoutError("deadline exceeded")
            return out

        def alone(row: pd.DataFrame) -> pd.DataFrame:
            try:
                return timed(row)
            except Exception as e:  # the item's error, never the batch's
                error = {"code": failure(e), "message": str(e)}
                return pd.DataFrame([{n: row[n].iloc[0] if n in row else None for n in names[:-1]} | {names[-1]: error}])

        for pdf in batches:
            if len(pdf) == 1:
                yield alone(pdf)
                continue
            try:
                yield timed(pdf)
            except Exception:  # some row's; each row alone says which and why
                for i in range(len(pdf)):
                    yield alone(pdf.iloc[i : i + 1])

    return rows.mapInPandas(run, fields)


def indexed(requests: DataFrame, *order: str) -> DataFrame:
    """requests with index (long): their place, from 0, in that order, which must tell rows apart. Rows are counted by range,
    and a range's rows are numbered on from the ranges before it, so no task sees all."""
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = requests.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialise(ranged, "indexed").withColumns({"__range": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    return ranged.join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range").withColumn("index", F.col("__before") + F.col("__place")).select("index", *requests.columns)


def check_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem): manifest and files have path, size, sha256; both must hold the same paths, safe, once, and alike."""
    m = manifest.select("path", F.col("size").alias("m_size"), F.col("sha256").alias("m_sha"))
    f = files.select("path", F.col("size").alias("f_size"), F.col("sha256").alias("f_sha"))
    problem = (
        F.when(F.col("m_sha").isNull(), "not in the manifest")
        .when(~F.col("path").rlike("^[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*$") | F.col("path").rlike(r"(^|/)\.\.?(/|$)"), "invalid path")
        .when(~F.col("m_sha").rlike("^[0-9a-f]{64}$"), "invalid hash")
        .when(F.col("f_sha").isNull(), "missing")
        .when(F.col("m_size") != F.col("f_size"), "wrong size")
        .when(F.col("m_sha") != F.col("f_sha"), "wrong hash")
    )
    repeated = m.groupBy("path").count().where("count > 1").select("path", F.lit("repeated").alias("problem"))
    return m.join(f, "path", "full_outer").select("path", problem.alias("problem")).where("problem IS NOT NULL").unionByName(repeated)


def needed(resources: DataFrame, roots: DataFrame) -> DataFrame:
    """(name): the roots and all that they need, over resources (name, needs). A round meets only what the last one found, until
    nothing new is found; chains may be of any length."""
    found = fresh = materialise(roots.select("name").distinct(), "needed")
    edges = materialise(resources.select("name", F.explode("needs").alias("need")).distinct(), "needs")
    while True:
        step = edges.join(fresh, "name", "left_semi").select(F.col("need").alias("name")).distinct()
        fresh = materialise(step.join(found, "name", "left_anti"), "needed")
        if not fresh.head(1):
            return found
        found = materialise(found.union(fresh), "needed")


def duplicates(resources: DataFrame, name: str = "path") -> DataFrame:
    """(name, copies) of names that stand more than once, capitals or not."""
    return resources.groupBy(F.lower(name).alias(name)).agg(F.count("*").alias("copies")).where("copies > 1")
