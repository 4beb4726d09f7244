"""The full scan of a table of prompts, the compliance check and the risk reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.config import ScanConfig
from textwarden.functions import pii, policy, risk
from textwarden.functions.hints import odd_letters
from textwarden.functions.sql import ident, lit, struct
from textwarden.sources.catalogs import Pattern, Policy, active_patterns, active_policies

# Texts of the results.
TOO_LONG = "Prompt exceeds maximum length"
REJECTED = "rejected"
SAFE = "Safe to send"
REVIEW = "Review and remediate issues"


def scan_table(
    df: DataFrame,
    text_col: str = "text",
    config: ScanConfig = ScanConfig(),
    custom_patterns: Iterable[Pattern] = (),
    custom_policies: Iterable[Policy] = (),
) -> DataFrame:
    """Detect, check, redact and decide for every row; works the same on a stream.

    Keeps the other columns of ``df`` and puts ``original_prompt``, ``redacted_prompt``, ``pii_detected``,
    ``policy_violations``, ``action``, ``safe_to_send`` and ``summaries`` in place of the text, and
    ``redacted_text`` for the audit log, which keeps it for blocked prompts too. A missing text is empty. With a
    maximum length, longer texts keep ``original_prompt`` and get the action ``rejected``, ``error`` and
    ``max_length``; nothing else is evaluated for them.

    Results that depend on the detections should be written before they are filtered: a filter on them is
    pushed below this projection and evaluates them again.
    """
    kept = [ident(c) for c in df.columns if c != text_col]
    patterns = active_patterns(config.extended_patterns, custom_patterns) if config.pii_detection_enabled else ()
    policies = (
        active_policies(config.extended_policies, custom_policies) if config.policy_enforcement_enabled else ()
    )
    given = f"coalesce({ident(text_col)}, '')"
    redacted = "_text"
    if config.auto_redact:
        redacted = pii.redact_pii("_text", "_matches", config.redaction_style, config.overlap)
    limit = config.max_prompt_length
    accepted = given if limit is None else f"if(length({given}) <= {limit}, {given}, NULL)"
    return (
        df.selectExpr(*kept, f"{given} AS _given", f"{accepted} AS _text")
        .selectExpr("*", "lower(_text) AS _lowered", f"{odd_letters('_text')} AS _odd")
        .selectExpr(
            *kept,
            "_given",
            "_text",
            f"{pii.detect_pii('_text', patterns, '_lowered', '_odd', config.unicode_regex)} AS _matches",
            f"{_checked('_text', policies, config)} AS _violations",
        )
        .selectExpr(
            "*",
            f"{redacted} AS _redacted",
            f"if(_text IS NULL, {lit(REJECTED)}, {policy.decide_action('_violations')}) AS _action",
        )
        .selectExpr(
            *kept,
            "_given AS original_prompt",
            "if(_action != 'blocked', _redacted, NULL) AS redacted_prompt",
            "transform(_matches, m -> struct(m.type AS type, m.name AS name, m.severity AS severity)) AS pii_detected",
            "transform(_violations, v -> struct(v.policy_name AS policy, v.category AS category, "
            "v.action AS action, v.message AS message)) AS policy_violations",
            "_action AS action",
            f"_action NOT IN ('blocked', {lit(REJECTED)}) AS safe_to_send",
            f"if(_text IS NULL, NULL, {_summaries('_matches', '_violations')}) AS summaries",
            "_redacted AS redacted_text",
            f"if(_text IS NULL, {lit(TOO_LONG)}, NULL) AS error",
            f"if(_text IS NULL, {'NULL' if limit is None else limit}, NULL) AS max_length",
        )
    )


def _checked(text: str, policies: Iterable[Policy], config: ScanConfig) -> str:
    return policy.check_policies(text, policies, "_lowered", "_odd", config.unicode_regex, config.whole_word)


def _summaries(matches: str, violations: str) -> str:
    return struct(pii=pii.pii_summary(matches), policy=policy.policy_summary(violations))


def with_findings(
    df: DataFrame,
    text_col: str = "text",
    config: ScanConfig = ScanConfig(),
    custom_patterns: Iterable[Pattern] = (),
    custom_policies: Iterable[Policy] = (),
) -> DataFrame:
    """Add ``matches`` and ``violations``, whatever the enabling switches and the length of the text."""
    patterns = active_patterns(config.extended_patterns, custom_patterns)
    policies = active_policies(config.extended_policies, custom_policies)
    text = ident(text_col)
    return df.selectExpr("*", f"lower({text}) AS _lowered", f"{odd_letters(text)} AS _odd").selectExpr(
        *[ident(c) for c in df.columns],
        f"{pii.detect_pii(text, patterns, '_lowered', '_odd', config.unicode_regex)} AS matches",
        f"{_checked(text, policies, config)} AS violations",
    )


def check_compliance(
    df: DataFrame,
    text_col: str = "text",
    config: ScanConfig = ScanConfig(),
    custom_patterns: Iterable[Pattern] = (),
    custom_policies: Iterable[Policy] = (),
) -> DataFrame:
    """Whether each text is free of personal data and violations, with both summaries; nothing is logged."""
    found = with_findings(df, text_col, config, custom_patterns, custom_policies)
    compliant = "size(matches) = 0 AND size(violations) = 0"
    return found.selectExpr(
        *[ident(c) for c in df.columns],
        f"{compliant} AS compliant",
        f"{_summaries('matches', 'violations')} AS issues",
        f"if({compliant}, {lit(SAFE)}, {lit(REVIEW)}) AS recommendation",
    )


def with_risk(df: DataFrame, matches_col: str = "matches", violations_col: str = "violations") -> DataFrame:
    """Add the ``risk`` struct."""
    return df.withColumn("risk", F.expr(risk.risk_score(ident(matches_col), ident(violations_col))))


def risk_levels(df: DataFrame) -> DataFrame:
    """Rows per risk level."""
    return df.groupBy(F.col("risk.level").alias("level")).agg(
        F.count(F.lit(1)).alias("texts"), F.sum("risk.score").alias("total_score")
    )


def top_risks(df: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """The ``k`` riskiest texts, ties by key; runs as a top-k per partition, not as a full sort."""
    return (
        df.select(*keys, F.col("risk.score").alias("score"), F.col("risk.level").alias("level"))
        .orderBy(F.desc("score"), *keys)
        .limit(k)
    )
