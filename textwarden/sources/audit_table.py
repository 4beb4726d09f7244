"""The audit log as Parquet folders: entries by day and version, chain heads by bucket, statistics, purge anchors."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.operators.chain import (
    append_chain,
    chain_heads,
    check_chain,
    check_segments,
    cut_tails,
    segment_ends,
)
from textwarden.operators.retention import kept_entries, purge_anchors, purged_entries
from textwarden.operators.stats import daily_statistics, merge_statistics
from textwarden.sources.files import create, delete, exists, glob, rename
from textwarden.sources.scratch import cleaned_up, materialise

ENTRIES_SCHEMA = (
    "chain_id string, timestamp string, ts timestamp_ntz, event_type string, original_text string, "
    "redacted_text string, pii_detected array<struct<type:string,name:string,severity:string>>, "
    "policy_violations array<struct<policy:string,category:string,action:string,message:string>>, "
    "action_taken string, user_id string, session_id string, metadata map<string,string>, seq long, "
    "prev_hash string, hash string, created_at timestamp, dt date, version long"
)
HEADS_SCHEMA = "chain_id string, last_seq long, last_hash string, bucket int, version long"
STATISTICS_SCHEMA = (
    "date date, total_scans long, pii_detections long, policy_violations long, blocked_prompts long, version long"
)
SEGMENTS_SCHEMA = "chain_id string, segment long, last_seq long, last_hash string, version long"
ANCHORS_SCHEMA = "chain_id string, anchor_seq long, anchor_hash string"
COMMITS_SCHEMA = "version long, writer string, batch long, rows long, digest string"
PROPERTIES_SCHEMA = "segment_rows long"

BUCKETS = 64
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


class AuditTable:
    """One log below ``path``, a folder that all executors share.

    Every append is a version. It writes ``entries/dt=D/version=V``, ``statistics/version=V`` and the heads of the
    chain buckets it touched, and then commits by creating the file ``commits/V``, which only one appender can.
    Readers see committed versions only; what a failed append has left is cleared by the next one. A version reads
    and writes the heads of its own buckets, not those of all chains.

    A batch is known by its writer and number. An exact replay is skipped; another batch under a number that was
    used, or under a lower one, is refused. ``segment_rows`` is a property of the log and is kept with it.
    """

    def __init__(self, spark: SparkSession, path: str, segment_rows: int | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        stored = self._stored_properties()
        if stored is not None and segment_rows is not None and stored["segment_rows"] != segment_rows:
            raise ValueError(f"the log was written with segment_rows={stored['segment_rows']}")
        self.segment_rows = segment_rows if stored is None else stored["segment_rows"]

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _stored_properties(self) -> dict | None:
        if not exists(self.spark, self._folder("properties.json")):
            return None
        row = self.spark.read.schema(PROPERTIES_SCHEMA).json(self._folder("properties.json")).first()
        return row.asDict()

    def _committed(self) -> int:
        """The last version; names of files are all that is read."""
        names = (p.rpartition("/")[2] for p in glob(self.spark, f"{self._folder('commits')}/*"))
        return max((int(n) for n in names if n.isdigit()), default=-1)

    def commits(self) -> DataFrame:
        folder = self._folder("commits")
        if self._committed() < 0:
            return self.spark.createDataFrame([], COMMITS_SCHEMA)
        return self.spark.read.schema(COMMITS_SCHEMA).json(folder)

    def _read(self, name: str, schema: str) -> DataFrame:
        """The committed rows of a part of the log."""
        last = self._committed()
        if last < 0 or not exists(self.spark, self._folder(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._folder(name)).filter(F.col("version") <= last)

    def entries(self) -> DataFrame:
        return self._read("entries", ENTRIES_SCHEMA)

    def heads(self, buckets: list[int] | None = None) -> DataFrame:
        """The head of every chain, or of those in some buckets."""
        heads = self._read("heads", HEADS_SCHEMA)
        if buckets is not None:
            heads = heads.filter(F.col("bucket").isin(buckets))
        return heads.groupBy("chain_id").agg(
            F.max("last_seq").alias("last_seq"), F.max_by("last_hash", "last_seq").alias("last_hash")
        )

    def statistics(self) -> DataFrame:
        return merge_statistics(self._read("statistics", STATISTICS_SCHEMA))

    def anchors(self) -> DataFrame:
        if not exists(self.spark, self._folder("anchors")):
            return self.spark.createDataFrame([], ANCHORS_SCHEMA)
        return self.spark.read.schema(ANCHORS_SCHEMA).parquet(self._folder("anchors")).dropDuplicates(
            ["chain_id", "anchor_seq"]
        )

    def append(
        self, entries: DataFrame, batch: int, order_by: tuple[str, ...] = ("timestamp",), writer: str = "batch"
    ) -> bool:
        """Append a batch of a writer; False if it was there already."""
        used = self.commits().filter(F.col("writer") == writer)
        same = used.filter(F.col("batch") == batch).first()
        if same is not None:
            rows, digest = _digest(entries)
            if (rows, digest) != (same["rows"], same["digest"]):
                raise ValueError(f"writer {writer!r} has appended another batch {batch}; each stream needs its own writer")
            return False
        if (used.agg(F.max("batch")).first()[0] or -1) > batch:
            raise ValueError(f"writer {writer!r} has appended a batch after {batch} already")
        with cleaned_up(self.spark):
            self._append_version(entries, batch, order_by, writer)
        return True

    def _append_version(self, entries: DataFrame, batch: int, order_by: tuple[str, ...], writer: str) -> None:
        version = self._committed() + 1
        self._clear(version)
        if self.segment_rows is not None and not exists(self.spark, self._folder("properties.json")):
            create(self.spark, self._folder("properties.json"), json.dumps({"segment_rows": self.segment_rows}))

        touched: list[int] = []

        def own_heads(written: DataFrame) -> DataFrame:
            # At most ``BUCKETS`` numbers.
            touched.extend(r[0] for r in written.select(_bucket().alias("b")).distinct().collect())
            return self.heads(touched)

        hashed = append_chain(entries, own_heads, order_by, self.segment_rows)
        stamped = hashed.withColumns({"created_at": F.current_timestamp(), "version": F.lit(version).cast("long")})
        names = [f.name for f in self.spark.createDataFrame([], ENTRIES_SCHEMA).schema]
        # Gathers each day into files of a good size; adaptive execution splits a day too large for one task.
        self._write(stamped.select(*names).hint("rebalance", "dt"), "entries", "dt", "version")
        own = self.spark.read.schema(ENTRIES_SCHEMA).parquet(self._folder("entries")).filter(F.col("version") == version)
        self._write(_at(daily_statistics(own), version), "statistics", "version")
        heads = self.heads(touched).unionByName(chain_heads(own)).groupBy("chain_id").agg(
            F.max("last_seq").alias("last_seq"), F.max_by("last_hash", "last_seq").alias("last_hash")
        )
        # A bucket lies in one task, or every task would write a file of nearly every bucket.
        bucketed = _at(heads.withColumn("bucket", _bucket()), version).hint("rebalance", "bucket")
        self._write(bucketed, "heads", "bucket", "version")
        if self.segment_rows is not None:
            self._write(_at(segment_ends(own, self.segment_rows), version), "segments", "version")
        rows, digest = _digest(own)
        commit = {"version": version, "writer": writer, "batch": batch, "rows": rows, "digest": digest}
        create(self.spark, f"{self._folder('commits')}/{version:012d}", json.dumps(commit))
        for bucket in touched:
            for old in glob(self.spark, f"{self._folder('heads')}/bucket={bucket}/version=*"):
                if int(old.rpartition("=")[2]) < version:
                    delete(self.spark, old)

    def _write(self, rows: DataFrame, name: str, *by: str) -> None:
        rows.write.mode("append").partitionBy(*by).parquet(self._folder(name))

    def _clear(self, version: int) -> None:
        """Remove what an append that was not committed has left."""
        for part in ("entries/dt=*", "heads/bucket=*", "statistics", "segments"):
            for left in glob(self.spark, f"{self._folder(part)}/version={version}"):
                delete(self.spark, left)

    def check(self, limit: int | None = None, newest: bool = False) -> DataFrame:
        return check_chain(self.entries(), self.segment_rows, self.anchors(), limit, newest)

    def recorded_segments(self) -> DataFrame:
        """The ends of all segments as they were recorded when they were appended."""
        ends = self._read("segments", SEGMENTS_SCHEMA).groupBy("chain_id", "segment")
        return ends.agg(F.max("last_seq").alias("last_seq"), F.max_by("last_hash", "last_seq").alias("last_hash"))

    def check_segments(self) -> DataFrame:
        """Segments that were replaced as a whole, which a check of neighbours cannot see; nothing if chains are
        unbroken. Segments that a purge has cut are left out."""
        if self.segment_rows is None:
            return self.spark.createDataFrame([], "chain_id string, segment long, recorded_hash string, found_hash string")
        return check_segments(self.entries(), self.recorded_segments(), self.segment_rows).filter("found_hash IS NOT NULL")

    def cut_tails(self) -> DataFrame:
        """Chains that lost entries at their end without a purge."""
        purged = self.anchors().select("chain_id", F.col("anchor_seq").alias("last_seq"))
        return cut_tails(self.entries(), self.heads()).join(purged, ["chain_id", "last_seq"], "left_anti")

    def purge(self, before: dt.datetime) -> int:
        """Remove entries older than ``before`` and return how many; statistics stay.

        The anchors are written first. Whole days are removed as folders; what stays of the day of ``before`` is
        written elsewhere in one job, and takes the place of the day when it is complete.
        """
        self._finish_purge()
        entries = self.entries()
        purged = purged_entries(entries, before).count()
        if not purged:
            return 0
        with cleaned_up(self.spark):
            # Written first, as a table is not appended to while it is read.
            anchors = materialise(purge_anchors(entries, before), "anchors")
            anchors.write.mode("append").parquet(self._folder("anchors"))
        day = before.date()
        for folder in glob(self.spark, f"{self._folder('entries')}/dt=*"):
            name = folder.rpartition("=")[2]
            if name != NO_DAY and name < day.isoformat():
                delete(self.spark, folder)
        if exists(self.spark, f"{self._folder('entries')}/dt={day}"):
            rest = kept_entries(entries, before).filter(F.col("dt") == F.lit(day)).drop("dt")
            rest.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("version").parquet(
                self._folder(f"purge/{day}")
            )
        self._finish_purge()
        return purged

    def _finish_purge(self) -> None:
        # Also after a purge that was cut off: what it had written counts once it is complete.
        for staged in glob(self.spark, f"{self._folder('purge')}/*"):
            day = f"{self._folder('entries')}/dt={staged.rpartition('/')[2]}"
            if exists(self.spark, f"{staged}/_SUCCESS"):
                delete(self.spark, day)
                if glob(self.spark, f"{staged}/version=*"):
                    rename(self.spark, staged, day)
            if exists(self.spark, staged):
                delete(self.spark, staged)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("chain_id"), F.lit(BUCKETS)).cast("int")


def _at(rows: DataFrame, version: int) -> DataFrame:
    return rows.withColumn("version", F.lit(version).cast("long"))


def _digest(entries: DataFrame) -> tuple[int, str]:
    """Number of entries and a sum over what they say, whatever their order."""
    chain = F.coalesce("chain_id", F.lit("main"))
    said = F.xxhash64(chain, "event_type", "original_text", "action_taken", "user_id", "session_id").cast("decimal(38,0)")
    rows, total = entries.agg(F.count(F.lit(1)), F.coalesce(F.sum(said), F.lit(0))).first()
    return rows, str(int(total))
