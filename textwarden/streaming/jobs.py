"""Scanning, logging and counting unbounded tables of prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from textwarden.config import ScanConfig
from textwarden.operators.audit import rate_breaches
from textwarden.operators.scan import scan_table
from textwarden.sources.audit_table import AuditTable
from textwarden.sources.files import is_file
from textwarden.sources.scratch import new_path


def scan_stream(stream: DataFrame, text_col: str = "text", config: ScanConfig = ScanConfig(), **catalogs) -> DataFrame:
    """Scan each row as it arrives: the batch scan, which keeps no state."""
    return scan_table(stream, text_col, config, **catalogs)


def audit_stream(
    stream: DataFrame,
    table: AuditTable,
    to_entries: Callable[[DataFrame], DataFrame],
    order_by: tuple[str, ...] = ("timestamp",),
    writer: str = "stream",
) -> DataStreamWriter:
    """Append each micro-batch to the log under its batch number; a replayed one is not appended twice.

    ``to_entries`` turns a batch of the stream into audit entries. The caller sets trigger and checkpoint. Batch numbers
    belong to a checkpoint, so every stream with a checkpoint of its own needs its own ``writer``; a number that comes
    again with other entries stops the stream.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        table.append(to_entries(batch), batch_id, order_by, writer)

    return stream.writeStream.foreachBatch(append)


def statistics_stream(entries: DataFrame, ts_col: str = "ts", delay: str = "1 day") -> DataFrame:
    """Daily counters kept as state. Entries that come more than ``delay`` after newer ones are not counted."""
    return (
        entries.withWatermark(ts_col, delay)
        .groupBy(F.window(ts_col, "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total_scans"),
            F.sum(F.coalesce(F.array_size("pii_detected"), F.lit(0))).cast("long").alias("pii_detections"),
            F.sum(F.coalesce(F.array_size("policy_violations"), F.lit(0))).cast("long").alias("policy_violations"),
            F.sum((F.col("action_taken") == "blocked").cast("long")).alias("blocked_prompts"),
        )
        .select(
            F.to_date("w.start").alias("date"),
            "total_scans",
            "pii_detections",
            "policy_violations",
            "blocked_prompts",
        )
    )


def rate_breach_stream(entries: DataFrame, max_per_minute: int = 60, ts_col: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Users over the rate limit per minute, as the minutes close."""
    return rate_breaches(entries.withWatermark(ts_col, delay), max_per_minute, "1 minute", ts_col)


def read_table_stream(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream of its files; ``partitions`` deals each batch out to so many tasks."""
    folder, _, name = path.rstrip("/").rpartition("/")
    schema = spark.read.parquet(path).schema
    if is_file(spark, path):
        # The source lists folders; a single file is picked by name.
        stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    else:
        stream = spark.readStream.schema(schema).parquet(path)
    return stream if partitions is None else stream.repartition(partitions)


def run_to_table(result: DataFrame, label: str) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote."""
    spark = result.sparkSession
    out = new_path(spark, label)
    query: StreamingQuery = (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/data")


def run_updates(result: DataFrame, key: str, label: str) -> DataFrame:
    """Run an aggregating stream over all that is there now and return the last state of each key.

    Update mode emits a key once per batch that touched it; each emission is written with its batch number.
    """
    spark = result.sparkSession
    out = new_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    query = (
        result.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    written = spark.read.parquet(f"{out}/data")
    values = [c for c in result.columns if c != key]
    latest = written.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return latest.select(key, *[F.col(f"_last.{c}").alias(c) for c in values])
