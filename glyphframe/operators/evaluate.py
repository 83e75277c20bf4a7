"""Evaluation against labels, and timing reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise


def cases(labels: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """labels (key, expected, corpus) with results (key, actual): errors by edit distance in code points."""
    both = labels.join(results, key)
    return both.select(key, "corpus", "expected", "actual", F.levenshtein("expected", "actual").alias("character_errors"), (F.col("expected") == F.col("actual")).alias("exact_match"))


def error_rates(cases_: DataFrame, *by: str) -> DataFrame:
    """Cases, exact matches, errors, reference characters and their rate, whose denominator is 1 at least."""
    got = cases_.groupBy(*by).agg(F.count("*").alias("cases"), F.count_if("exact_match").alias("exact_matches"), F.sum("character_errors").alias("character_errors"), F.sum(F.char_length("expected")).alias("reference_characters"))
    return got.withColumn("character_error_rate", F.col("character_errors") / F.greatest(F.lit(1), F.col("reference_characters")))


def percentile(values: Column, p: float) -> Column:
    """The sorted value at min(n - 1, (n - 1) p rounded half to even); values: an array."""
    at = F.least(F.size(values) - 1, F.rint((F.size(values) - 1) * F.lit(p)).cast("int"))
    return F.get(F.array_sort(values), at)


def grouped_percentiles(df: DataFrame, by: str, value: str, ps: dict[str, float]) -> DataFrame:
    """Exact percentiles by the same rule for few groups of any size: rows are counted by distinct value, and the values are
    dealt by range. A group's place falls into one range, by the ranges' totals, and into one value by the running counts
    within that range, so no task sees a whole group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = materialise(counts.repartitionByRange(parts, by, value).withColumn("range", F.spark_partition_id()), "percentiles")
    totals = counts.groupBy(by, "range").agg(F.sum("c").alias("t"))  # a row a range, two where a range ends a group
    before = W.partitionBy(by).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumns({"before": F.coalesce(F.sum("t").over(before), F.lit(0)), "n": F.sum("t").over(W.partitionBy(by))})
    at = {k: F.least(F.col("n") - 1, F.rint((F.col("n") - 1) * F.lit(p)).cast("long")) for k, p in ps.items()}
    hit = reduce(lambda a, b: a | b, [(F.col("before") <= a) & (a < F.col("before") + F.col("t")) for a in at.values()])
    run = counts.join(F.broadcast(totals.where(hit)), [by, "range"])  # as many rows as groups have percentiles, at most
    upto = F.col("before") + F.sum("c").over(W.partitionBy(by, "range").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    run = run.withColumn("upto", upto)
    return run.groupBy(by).agg(F.max("n").alias("runs"), *[F.min(F.when((F.col("before") <= a) & (F.col("upto") > a), F.col(value))).alias(k) for k, a in at.items()])


def report(cases_: DataFrame, seconds: str = "elapsed_seconds") -> DataFrame:
    """The evaluation report: one row a corpus and, with a null corpus, one of all cases: error_rates and the median seconds."""
    median = lambda df, *by: df.groupBy(*by).agg(F.median(seconds).alias("median_seconds"))
    each = error_rates(cases_, "corpus").join(median(cases_, "corpus"), "corpus")
    everything = error_rates(cases_).crossJoin(median(cases_)).withColumn("corpus", F.lit(None).cast("string"))  # one row each
    return each.unionByName(everything)


def throughput(df: DataFrame, by: str, seconds: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("items"), (1 / F.avg(seconds)).alias("items_per_second"))


def diagnostics(runs: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Runs and total seconds of each stage, by name."""
    return runs.groupBy(stage).agg(F.count("*").alias("runs"), F.sum(seconds).alias("run_seconds")).orderBy(stage)


def differences(golden: DataFrame, actual: DataFrame, leave: tuple[str, ...] = ("elapsed_seconds",)) -> DataFrame:
    """Rows that only one side has, as often as it has them more; columns in leave do not count."""
    golden, actual = golden.drop(*leave), actual.drop(*leave)
    actual = actual.select(*golden.columns)
    return golden.exceptAll(actual).withColumn("side", F.lit("golden")).unionAll(actual.exceptAll(golden).withColumn("side", F.lit("actual")))
