"""Properties of the physical plans that matter on large tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from textwarden.config import ScanConfig
from textwarden.operators.pii import match_rows, pii_totals, with_matches
from textwarden.operators.scan import risk_levels, scan_table, with_findings, with_risk
from textwarden.plans import views
from textwarden.plans.registry import QUERIES

from conftest import SF_DIR


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def searches_for_email(df):
    # A search names the pattern twice: to find out whether it occurs, and to mark where.
    return optimized(df).count("._%+-]+@") / 2


def test_row_wise_operators_do_not_shuffle(spark):
    for df in (
        scan_table(documents(spark)),
        match_rows(with_matches(documents(spark)), ["doc_id"]),
        with_risk(with_findings(documents(spark))),
    ):
        assert "Exchange" not in physical(df)


def test_registered_scans_do_not_shuffle(spark):
    for name in ("scan_prompts", "scan_without_pii", "scan_without_policies", "redact_type", "compliance", "policy_actions"):
        assert "Exchange" not in physical(QUERIES[name](spark, SF_DIR)), name


def test_each_text_is_searched_once(spark):
    scanned = scan_table(documents(spark))
    for df in (
        scanned,
        scanned.groupBy("lang", "action").agg(F.sum(F.size("pii_detected")), F.sum(F.size("policy_violations"))),
        match_rows(with_matches(documents(spark)), ["doc_id"]),
        pii_totals(with_matches(documents(spark)), by=["lang"]),
        risk_levels(with_risk(with_findings(documents(spark)))),
    ):
        assert searches_for_email(df) == 1, optimized(df)[:2000]


def test_only_needed_columns_are_read(spark):
    plan = physical(pii_totals(with_matches(documents(spark)), by=["lang"]))
    assert re.search(r"ReadSchema: struct<text:string,lang:string>", plan)


def test_totals_shuffle_only_counts(spark):
    plan = physical(pii_totals(with_matches(documents(spark))))
    assert plan.count("Exchange hashpartitioning(type") == 1
    assert "partial_sum" in plan


def test_switched_off_detection_leaves_no_trace(spark):
    off = scan_table(documents(spark), config=ScanConfig(pii_detection_enabled=False))
    assert searches_for_email(off) == 0


def test_chains_are_sorted_and_hashed_after_one_shuffle(spark):
    plan = physical(QUERIES["audit_chain"](spark, SF_DIR))
    assert plan.count("Exchange") == 1
    assert "MapInArrow" in plan


def test_events_of_one_file_are_scanned_by_all_cores(spark, tmp_path):
    spark.range(4_000).selectExpr(
        "id AS event_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS ts",
        "id % 7 AS user_id", "'view' AS event_type", "'{}' AS props",
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    entries = views.event_entries(views.table(spark, str(tmp_path), "events"))
    spread = entries.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in spread) == 4_000
    assert len(spread) >= 8 and max(r["count"] for r in spread) < 1_000
