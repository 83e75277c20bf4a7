"""Sends this package to the Python workers, which need not find it on their own path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package (and the modules beside it that use it) as a zip, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SENT:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="glyphframe"), "glyphframe.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
            if (f := root.parent / "corpus_pipeline.py").exists():
                z.write(f, f.name)
        spark.sparkContext.addPyFile(path)
        _SENT.add(app)
    return spark
