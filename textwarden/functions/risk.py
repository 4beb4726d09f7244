"""Risk score of a text from its matches and violations."""

from __future__ import annotations

from textwarden.functions.sql import let, lookup, struct

# Points, thresholds and texts.
PII_POINTS = {"critical": 10, "high": 7, "medium": 4, "low": 2}
PII_POINTS_OTHER = 4
POLICY_POINTS = {"block": 10, "warn": 5, "allow": 0}
POLICY_POINTS_OTHER = 5
MAX_SCORE = 100
LEVELS = {"critical": 70, "high": 40, "medium": 20}
LOWEST_LEVEL = "low"
RECOMMENDATIONS = {
    "critical": "Do not send. Multiple critical issues detected.",
    "high": "Review and remediate before sending.",
    "medium": "Consider reviewing sensitive information.",
    "low": "Generally safe to send.",
}
RECOMMENDATION_OTHER = "Review before sending."


def _points(items: str, field: str, table: dict, other: int) -> str:
    return f"aggregate({items}, 0, (acc, x) -> acc + {lookup(f'x.{field}', table, other)})"


def pii_score(matches: str) -> str:
    return _points(matches, "severity", PII_POINTS, PII_POINTS_OTHER)


def policy_score(violations: str) -> str:
    return _points(violations, "action", POLICY_POINTS, POLICY_POINTS_OTHER)


def risk_level(score: str) -> str:
    cases = " ".join(f"WHEN {score} >= {least} THEN '{level}'" for level, least in LEVELS.items())
    return f"CASE {cases} ELSE '{LOWEST_LEVEL}' END"


def risk_recommendation(level: str) -> str:
    return lookup(level, RECOMMENDATIONS, RECOMMENDATION_OTHER)


def risk_score(matches: str, violations: str) -> str:
    """``STRUCT<score, level, pii_score, policy_score, recommendation>``."""
    points = struct(pii=pii_score(matches), policy=policy_score(violations))
    score = f"least(p.pii + p.policy, {MAX_SCORE})"
    level = risk_level(score)
    return let(
        "p",
        points,
        struct(
            score=score,
            level=level,
            pii_score="p.pii",
            policy_score="p.policy",
            recommendation=risk_recommendation(level),
        ),
    )
