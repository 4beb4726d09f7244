"""Daily statistics of the audit log."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("total_scans", "pii_detections", "policy_violations", "blocked_prompts")
DEFAULT_DAYS = 30
TOOL_DAYS = 7


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_scans"),
        F.sum(F.coalesce(F.array_size("pii_detected"), F.lit(0))).cast("long").alias("pii_detections"),
        F.sum(F.coalesce(F.array_size("policy_violations"), F.lit(0))).cast("long").alias("policy_violations"),
        F.count_if(F.col("action_taken") == "blocked").alias("blocked_prompts"),
    ]


def daily_statistics(audit: DataFrame) -> DataFrame:
    """Counters per day of the entries; additive, so partial results can be merged."""
    return audit.groupBy(F.col("dt").alias("date")).agg(*_counts())


def merge_statistics(*parts: DataFrame) -> DataFrame:
    """Add counters of several runs up to one row per day."""
    rows = parts[0].select("date", *COUNTERS)
    for part in parts[1:]:
        rows = rows.unionByName(part.select("date", *COUNTERS))
    return rows.groupBy("date").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def unique_users_daily(audit: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct users per day, exact or by a sketch of fixed size. Not additive: computed from the entries."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return audit.groupBy(F.col("dt").alias("date")).agg(count(F.col("user_id")).alias("unique_users"))


def _last_days(statistics: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    first = as_of - dt.timedelta(days=days - 1)
    return statistics.filter(F.col("date").between(F.lit(first), F.lit(as_of)))


def statistics_summary(statistics: DataFrame, as_of: dt.date, days: int = DEFAULT_DAYS) -> DataFrame:
    """One row of totals over the ``days`` days up to and including ``as_of``; zeros if there are none."""
    names = ("total_scans", "total_pii_detections", "total_policy_violations", "total_blocked")
    return _last_days(statistics, as_of, days).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in zip(COUNTERS, names)],
        F.count_distinct("date").alias("days_active"),
    )


def statistics_breakdown(statistics: DataFrame, as_of: dt.date, days: int = DEFAULT_DAYS) -> DataFrame:
    """One row per day of the same period, newest first."""
    names = ("scans", "pii", "violations", "blocked")
    return (
        _last_days(statistics, as_of, days)
        .orderBy(F.desc("date"))
        .select("date", *[F.col(c).alias(n) for c, n in zip(COUNTERS, names)])
    )
