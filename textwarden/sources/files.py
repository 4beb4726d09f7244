"""File system calls through Hadoop, so that they work wherever the tables are."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _resolve(spark, path)
    return fs.exists(target)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, target = _resolve(spark, path)
    return fs.exists(target) and fs.getFileStatus(target).isFile()


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _resolve(spark, path)
    fs.delete(target, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, source = _resolve(spark, path)
    if not fs.rename(source, _resolve(spark, to)[1]):
        raise OSError(f"cannot rename {path} to {to}")


def create(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; fails if there is one already."""
    fs, target = _resolve(spark, path)
    out = fs.create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, target = _resolve(spark, pattern)
    return [status.getPath().toString() for status in fs.globStatus(target) or []]
