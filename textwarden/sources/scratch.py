"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from textwarden.sources.files import delete


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Sessions whose only process is this one may leave it unset: they get a temporary folder for their lifetime.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        configured = tempfile.mkdtemp(prefix="textwarden-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


_scopes: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/textwarden/{label}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables of a step that has written its own result when it is done."""
    scope: list[str] = []
    _scopes.append(scope)
    try:
        yield
    finally:
        _scopes.remove(scope)
        for path in scope:
            delete(spark, path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and continue from the written table.

    This cuts the lineage (a lost executor costs a re-read, not a re-run), evaluates non-deterministic columns
    exactly once, and lets later steps read only the columns they need.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
