"""Sending this package to the executors, for sessions whose workers do not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: add the package's sources to what Spark distributes to the workers."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="textwarden-"), "textwarden-src.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted((ROOT / "textwarden").rglob("*.py")):
            archive.write(source, source.relative_to(ROOT))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
