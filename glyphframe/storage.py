"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROOTS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir. Where that is unset, a local session (as in tests) gets one of its
    own; on a cluster it is an error, since each machine's disk is its own there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/glyphframe-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS[root] = spark
        atexit.register(_remove, root)
    return root


def _remove(path: str) -> None:
    """Deletes a folder; without a running session nothing happens."""
    spark = _ROOTS.get(path.partition("/steps-")[0])
    if spark is None or spark.sparkContext._jsc is None:
        return
    with contextlib.suppress(Exception):  # the folder is scratch: what cannot be deleted stays
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has materialised; results that read it must have been written elsewhere."""
    _remove(shared_dir(spark))


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside has its shuffle files removed when it ends, not whenever the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage is cut and any executor may be lost later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/steps-{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gf_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialise() wrote for df; nothing that is still to run may read it."""
    _remove(df._gf_path)
