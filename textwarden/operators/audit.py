"""Audit entries: made from scans, queried and exported."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.config import ScanConfig
from textwarden.functions.canonical import iso_timestamp
from textwarden.functions.sql import ident, lit
from textwarden.operators.chain import MAIN_CHAIN, append_chain
from textwarden.operators.scan import scan_table
from textwarden.sources.scratch import cleaned_up, materialise

DEFAULT_LIMIT = 100
RECENT_LIMIT = 50
EXPORT_FORMATS = ("json", "csv")
PII_JSON = "array<struct<type:string,name:string,severity:string>>"
VIOLATIONS_JSON = "array<struct<policy:string,category:string,action:string,message:string>>"


def audit_entries(
    scanned: DataFrame,
    ts: str,
    user_id: str = "NULL",
    session_id: str = "NULL",
    metadata: str = "map()",
    chain_id: str = lit(MAIN_CHAIN),
    event_type: str = "NULL",
    store_original: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Entries for all rows of a scan, rejected ones too. A missing timestamp is the time of the run.

    The arguments are SQL expressions over the columns of the scan. ``store_original=False`` stores, and
    hashes, only the SHA-256 of the original text. Columns named in ``keep`` are carried along, for instance
    to order the entries.
    """
    moment = f"coalesce(CAST({ts} AS timestamp_ntz), localtimestamp())"
    return scanned.selectExpr(
        *[ident(c) for c in keep],
        f"CAST({chain_id} AS string) AS chain_id",
        f"{iso_timestamp(moment)} AS timestamp",
        f"{moment} AS ts",
        f"to_date({moment}) AS dt",
        f"coalesce({event_type}, 'scan') AS event_type",
        f"{'original_prompt' if store_original else 'sha2(original_prompt, 256)'} AS original_text",
        "redacted_text",
        "pii_detected",
        "policy_violations",
        "coalesce(action, 'allowed') AS action_taken",
        f"CAST({user_id} AS string) AS user_id",
        f"CAST({session_id} AS string) AS session_id",
        f"CAST({metadata} AS map<string, string>) AS metadata",
    )


def scan_and_log(
    df: DataFrame,
    ts: str,
    text_col: str = "text",
    config: ScanConfig = ScanConfig(),
    heads: DataFrame | None = None,
    order_by: Sequence[str] = ("ts",),
    keep: Sequence[str] = (),
    segment_rows: int | None = None,
    **entry,
) -> DataFrame:
    """Scan a table and log it: the audit entries with ``seq`` and links, the columns named in ``keep``, and the
    outcome for the caller (``redacted_prompt``, ``safe_to_send``, ``summaries``, ``error``, ``max_length``,
    ``audit_hash``), one row for every text given.

    ``entry`` takes the further arguments of ``audit_entries``. With logging switched off it is the plain scan.
    """
    scanned = scan_table(df, text_col, config)
    if not config.audit_logging_enabled:
        return scanned
    entries = audit_entries(scanned, ts, keep=(*keep, "redacted_prompt", "safe_to_send", "summaries", "error", "max_length"), **entry)
    return append_chain(entries, heads, order_by, segment_rows).withColumn("audit_hash", F.col("hash"))


def import_log(rows: DataFrame) -> DataFrame:
    """A log kept elsewhere as plain columns, in one chain: ``id`` for the number, and JSON texts in
    ``pii_detected``, ``policy_violations`` and ``metadata``.
    """
    ts = "CAST(timestamp AS timestamp_ntz)"
    return rows.selectExpr(
        f"{lit(MAIN_CHAIN)} AS chain_id",
        "CAST(id AS long) AS seq",
        "timestamp",
        f"{ts} AS ts",
        f"to_date({ts}) AS dt",
        "event_type",
        "original_text",
        "redacted_text",
        f"from_json(pii_detected, {lit(PII_JSON)}) AS pii_detected",
        f"from_json(policy_violations, {lit(VIOLATIONS_JSON)}) AS policy_violations",
        "action_taken",
        "user_id",
        "session_id",
        "from_json(metadata, 'map<string,string>') AS metadata",
        "hash",
        "prev_hash",
    )


def query_audit(
    audit: DataFrame,
    limit: int | None = DEFAULT_LIMIT,
    offset: int = 0,
    start_date: str | None = None,
    end_date: str | None = None,
    event_type: str | None = None,
    action_taken: str | None = None,
    chain_id: str | None = None,
) -> DataFrame:
    """Newest entries that meet all filters; ``limit`` None gives all.

    Dates are ISO texts and compare with the entry's timestamp text; they also select partitions by day. The entries
    of one chain come in the order of appending, last first. Chains have no common order of appending, so entries of
    several come by their time.
    """
    found = audit
    if start_date is not None:
        found = found.filter(F.col("timestamp") >= start_date)
        if day := _day(start_date):
            found = found.filter(F.col("dt") >= F.lit(day).cast("date"))
    if end_date is not None:
        found = found.filter(F.col("timestamp") <= end_date)
        if day := _day(end_date):
            found = found.filter(F.col("dt") <= F.lit(day).cast("date"))
    if event_type is not None:
        found = found.filter(F.col("event_type") == event_type)
    if action_taken is not None:
        found = found.filter(F.col("action_taken") == action_taken)
    if chain_id is not None:
        found = found.filter(F.col("chain_id") == chain_id).orderBy(F.desc("seq"))
    else:
        found = found.orderBy(F.desc("ts"), F.desc("seq"), "chain_id")
    found = found.offset(offset) if offset else found
    return found if limit is None else found.limit(limit)


def _day(iso: str) -> str | None:
    return iso[:10] if re.match(r"\d{4}-\d{2}-\d{2}", iso) else None


def recent_audit(audit: DataFrame) -> DataFrame:
    return query_audit(audit, limit=RECENT_LIMIT)


def export_rows(audit: DataFrame, format: str = "json", limit: int | None = None, **filters) -> DataFrame:
    """Entries in the shape of an export, newest first: whole entries for json, seven columns for csv. ``limit`` keeps
    the newest; None exports all."""
    if format not in EXPORT_FORMATS:
        raise ValueError(f"Unsupported format: {format}")
    rows = query_audit(audit, limit=limit, **filters)
    if format == "json":
        return rows
    return rows.select(
        F.col("seq").alias("id"),
        "timestamp",
        "event_type",
        "action_taken",
        F.coalesce(F.array_size("pii_detected"), F.lit(0)).alias("pii_count"),
        F.coalesce(F.array_size("policy_violations"), F.lit(0)).alias("violation_count"),
        "hash",
    )


def export_logs(
    audit: DataFrame, path: str, format: str = "json", limit: int | None = None, **filters
) -> None:
    """Write an export as a JSON-lines or CSV folder; a CSV with rows has a header."""
    rows = export_rows(audit, format, limit, **filters)
    if format == "json":
        rows.write.json(path)
        return
    with cleaned_up(audit.sparkSession):
        rows = materialise(rows, "export")
        rows.write.option("header", not rows.isEmpty()).csv(path)


def rate_limit_report(audit: DataFrame, config: ScanConfig) -> DataFrame:
    """Breaches of the configured rate limit; none if it is switched off."""
    breaches = rate_breaches(audit, config.max_per_minute)
    return breaches if config.rate_limit_enabled else breaches.filter("false")


def rate_breaches(
    audit: DataFrame, max_per_window: int = 60, window: str = "1 minute", ts_col: str = "ts", user_col: str = "user_id"
) -> DataFrame:
    """Users with more entries in a window of the clock than allowed; also on a stream with a watermark."""
    return (
        audit.groupBy(user_col, F.window(ts_col, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .filter(F.col("requests") > max_per_window)
        .select(user_col, F.col("w.start").alias("window_start"), "requests")
    )
