from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textwarden.config import ScanConfig
from textwarden.functions.risk import risk_recommendation, risk_score
from textwarden.functions.text import sanitize_for_logging, truncate_text
from textwarden.operators.scan import check_compliance, risk_levels, scan_table, top_risks, with_findings, with_risk


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def scanned(spark, text, config=ScanConfig(), **more):
    return scan_table(frame(spark, [text]), config=config, **more).first()


def test_clean(spark):
    row = scanned(spark, "Rain is due on Sunday.")
    assert (row.action, row.safe_to_send, row.pii_detected, row.policy_violations) == ("allowed", True, [], [])
    assert row.redacted_prompt == row.original_prompt == "Rain is due on Sunday."
    assert row.error is None


def test_personal_data_alone_is_allowed(spark):
    row = scanned(spark, "Mail ada@orchard.example, badge 219-09-9999")
    assert (row.action, row.safe_to_send) == ("allowed", True)
    assert row.redacted_prompt == "Mail [REDACTED], badge [REDACTED]"
    assert [p.asDict() for p in row.pii_detected] == [
        {"type": "email", "name": "Email Address", "severity": "medium"},
        {"type": "ssn", "name": "Social Security Number", "severity": "high"},
    ]
    assert row.summaries.pii.total_count == 2


def test_blocked_prompt_is_withheld_but_kept_for_the_log(spark):
    row = scanned(spark, "Good medical advice, mail a@b.cc")
    assert (row.action, row.safe_to_send, row.redacted_prompt) == ("blocked", False, None)
    assert row.redacted_text == "Good medical advice, mail [REDACTED]"
    assert row.policy_violations[0].policy == "medical_advice"
    assert row.summaries.policy.should_block


def test_switches(spark):
    text = "confidential a@b.cc"
    assert scanned(spark, text, ScanConfig(pii_detection_enabled=False)).redacted_prompt == text
    assert scanned(spark, text, ScanConfig(policy_enforcement_enabled=False)).action == "allowed"
    row = scanned(spark, text, ScanConfig(auto_redact=False))
    assert (row.redacted_prompt, len(row.pii_detected), row.action) == (text, 1, "warned")


def test_length_guard_counts_code_points(spark):
    config = ScanConfig(max_prompt_length=5)
    assert scanned(spark, "😀" * 5, config).error is None
    row = scanned(spark, "😀" * 6, config)
    assert (row.error, row.max_length, row.action, row.pii_detected) == ("Prompt exceeds maximum length", 5, "rejected", None)
    assert (row.original_prompt, row.safe_to_send, row.summaries) == ("😀" * 6, False, None)


def test_texts_of_any_length_are_scanned_by_default(spark):
    row = scanned(spark, "x " * 10_000 + "a@b.cc")
    assert (row.error, [p.type for p in row.pii_detected]) == (None, ["email"])


def test_missing_text_is_empty(spark):
    row = scanned(spark, None)
    assert (row.original_prompt, row.action, row.pii_detected) == ("", "allowed", [])


def test_other_columns_stay(spark):
    df = spark.createDataFrame([("x", "a@b.cc")], "`odd name` string, body string")
    assert scan_table(df, "body").columns[0] == "odd name"


def test_compliance(spark):
    # Keywords match inside words: "issues" holds "sue".
    texts = ["Rain is due on Sunday.", "A dry summer with no issues", "a@b.cc", "confidential"]
    rows = check_compliance(frame(spark, texts)).orderBy("id").collect()
    assert [r.compliant for r in rows] == [True, False, False, False]
    assert [r.recommendation for r in rows] == ["Safe to send"] + ["Review and remediate issues"] * 3


@pytest.mark.parametrize(
    "severities,actions,score,level",
    [
        ([], [], 0, "low"),
        (["critical", "high"], [], 17, "low"),
        (["critical", "odd"], ["redact"], 19, "low"),
        (["medium"] * 5, [], 20, "medium"),
        (["high"] * 5, ["warn", "allow"], 40, "high"),
        (["critical"] * 6, ["block"], 70, "critical"),
        (["critical"] * 20, ["block"] * 5, 100, "critical"),
    ],
)
def test_risk(spark, severities, actions, score, level):
    df = spark.createDataFrame(
        [([(s,) for s in severities], [(a,) for a in actions])],
        "m array<struct<severity:string>>, v array<struct<action:string>>",
    )
    row = df.select(F.expr(risk_score("m", "v")).alias("r")).first().r
    assert (row.score, row.level) == (score, level)


def test_risk_reports(spark):
    df = with_risk(with_findings(frame(spark, ["x", "medical advice, legal advice", "a@b.cc", "legal advice"])))
    assert {r.level: r.texts for r in risk_levels(df).collect()} == {"low": 3, "medium": 1}
    assert [(r.id, r.score) for r in top_risks(df, 2, ["id"]).collect()] == [(1, 20), (3, 10)]
    assert spark.range(1).select(F.expr(risk_recommendation("'none'"))).first()[0] == "Review before sending."


def test_text_functions(spark):
    texts = ["short", "x" * 100, "😀" * 101, "a\x00b\x1fc\n\r\td\x7f", "y" * 501]
    rows = frame(spark, texts).select(
        F.expr(truncate_text("text")).alias("t"), F.expr(truncate_text("text", 2)).alias("two"),
        F.expr(sanitize_for_logging("text")).alias("s"),
    ).collect()
    assert [r.t for r in rows] == ["short", "x" * 100, "😀" * 97 + "...", texts[3], "y" * 97 + "..."]
    assert [r.two for r in rows] == [t[:-1] + "..." for t in texts]
    assert [r.s for r in rows] == ["short", "x" * 100, "😀" * 101, "abc\n\r\td\x7f", "y" * 500 + "... [truncated]"]
