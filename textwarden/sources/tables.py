"""Reading tables of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A Parquet table as it is stored.

    Scanning text costs far more than moving it, so a caller whose table is a few large row groups can have its rows
    dealt out to ``partitions`` tasks.
    """
    table = spark.read.parquet(path)
    return table if partitions is None else table.repartition(partitions)
