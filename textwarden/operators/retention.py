"""Removing old entries from the audit log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_KEEP_DAYS = 90


def cutoff(as_of: dt.datetime, days_to_keep: int = DEFAULT_KEEP_DAYS) -> dt.datetime:
    return as_of - dt.timedelta(days=days_to_keep)


def kept_entries(audit: DataFrame, before: dt.datetime) -> DataFrame:
    """Entries not older than ``before``; whole days are skipped by partition."""
    return audit.filter((F.col("dt") >= F.lit(before.date())) & (F.col("ts") >= _ntz(before)))


def purged_entries(audit: DataFrame, before: dt.datetime) -> DataFrame:
    return audit.filter((F.col("dt") <= F.lit(before.date())) & (F.col("ts") < _ntz(before)))


def purge_anchors(audit: DataFrame, before: dt.datetime) -> DataFrame:
    """``chain_id, anchor_seq, anchor_hash``: the entries that a purge removes without their successor.

    With them the kept entries can still be checked, also where late entries make a purge leave holes, and where
    a chain ends can still be told. Numbers and hashes are all that is shuffled.
    """
    gone = purged_entries(audit, before).select("chain_id", "seq", "hash")
    followed = gone.select("chain_id", (F.col("seq") - 1).alias("seq"))
    return gone.join(followed, ["chain_id", "seq"], "left_anti").select(
        "chain_id", F.col("seq").alias("anchor_seq"), F.col("hash").alias("anchor_hash")
    )


def _ntz(moment: dt.datetime):
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
