"""A stream of page requests: one path a line in, one JSON object a request out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MOST_BYTES = 1 << 20


def requests(spark: SparkSession, folder: str, files_per_trigger: int = 2) -> DataFrame:
    """(file, id, path) of the lines, that are not empty, of new files in folder; id counts a file's lines from 1, so equal
    paths stay two requests. files_per_trigger bounds what is taken in at once. A line over 1 MiB is an error."""
    lists = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder, wholetext=True)
    lines = F.filter(F.split("value", "\r?\n"), lambda x: x != "")
    asked = lists.select(F.col("_metadata.file_path").alias("file"), F.posexplode(lines).alias("at", "path"))
    path = F.when(F.octet_length("path") > MOST_BYTES, F.raise_error(F.lit("invalid request: line over 1 MiB")).cast("string")).otherwise(F.col("path"))
    return asked.select("file", (F.col("at") + 1).cast("long").alias("id"), path.alias("path"))


def responses(stream: DataFrame, operation: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """operation adds result and error columns to (id, path); a failed request is an error row, never a failed stream."""
    got = operation(stream)
    return got.select(F.to_json(F.struct("id", "path", "result", "error"), {"ignoreNullFields": "true"}).alias("value"))


def write(stream: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """JSON lines to folder, each request exactly once, in the order of completion."""
    writer = stream.writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
