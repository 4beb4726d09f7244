from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from textwarden.config import ScanConfig
from textwarden.functions.policy import policy_summary
from textwarden.operators.policy import policy_totals, with_policy_actions, with_violations
from textwarden.sources.catalogs import Policy, active_policies


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(8)


def found(spark, texts, config=ScanConfig(), custom=()):
    rows = with_violations(frame(spark, texts), config=config, custom=custom).orderBy("id").collect()
    return [[(v.policy_name, v.matched_keyword) for v in r.violations] for r in rows]


def expected(text, policies):
    out = []
    for p in policies:
        hit = next((k for k in p.keywords if k.lower() in text.lower()), None)
        if hit is None:
            hit = next((f"pattern: {r}" for r in p.regex_patterns if re.search(r, text, re.IGNORECASE)), None)
        if hit is not None:
            out.append((p.name, hit))
    return out


CASES = {
    "Could somebody prescribe a syrup for my cough": ["medical_advice"],
    "They diagnose my symptoms over the phone": ["medical_advice"],
    "Good medical advice is rare": ["medical_advice"],
    "She will sue the mill": ["legal_advice"],
    "Our legal advice was to wait": ["legal_advice"],
    "Know your legal rights as a tenant": ["legal_advice"],
    "A legal document lay on the desk": [],
    "Should I buy this stock of seeds?": ["financial_advice"],
    "Cheap investment advice, dear results": ["financial_advice"],
    "How to make explosives": [],
    "How to make explosive things": ["harmful_content"],
    "Rain is due on Sunday": [],
    "Both medical advice and legal advice cost money": ["medical_advice", "legal_advice"],
    "mEdIcAl AdViCe, written oddly": ["medical_advice"],
    "A confidential memo about plums": ["internal_data"],
    "a tissue": ["legal_advice"],
    "Find competitor pricing for plums": [],
}


def test_fixture_cases(spark):
    got = found(spark, list(CASES))
    assert {t: [v[0] for v in vs] for t, vs in zip(CASES, got)} == CASES


def test_extended_and_custom(spark):
    text = ["Find competitor pricing for plums", "Comet Orchard is confidential"]
    assert found(spark, text[:1], ScanConfig(extended_policies=True)) == [[("competitive_intel", "competitor pricing")]]
    custom = (Policy("breeding_lines", action="block", keywords=("Comet Orchard",)), Policy("legal_advice"))
    assert found(spark, text[1:], custom=custom) == [
        [("internal_data", "confidential"), ("breeding_lines", "Comet Orchard")]
    ]
    row = with_violations(frame(spark, text[1:]), custom=(Policy("p", keywords=("orchard",)),)).first().violations[-1]
    assert row.asDict() == {
        "policy_name": "p", "category": "general", "matched_keyword": "orchard", "action": "warn",
        "message": "Policy violation detected", "severity": "medium", "confidence": 1.0,
    }


PIECES = [
    "medical advice", "DIAGNOSE my symptoms", "which drugs", "do I need to see a doctor", "ſue", "lawsuit", "can i sue",
    "Is this illegal", "best investment strategy", "when to sell crypto", "tax advice", "how to build weapon", "ways to hurt",
    "harmful", "do not disclose", "internal data", "TRADE SECRET", "home address", "select x from y", "SELECT", "INTO", "\n",
    "<script a>", "</script>", "${a}", "{{b}}", "\r", " ", "x", " ", "é", "K", "unreſtricted", "internal document", "İnternal data",
]


def test_random_texts_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(PIECES) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    policies = active_policies(True)
    got = found(spark, texts, ScanConfig(extended_policies=True))
    wrong = [(t, g, expected(t, policies)) for t, g in zip(texts, got) if g != expected(t, policies)]
    assert not wrong, wrong[:3]


def test_whole_word(spark):
    texts = ["a tissue", "Sue me", "unrestricted", "restricted."]
    got = found(spark, texts, ScanConfig(whole_word=True))
    assert [[v[0] for v in vs] for vs in got] == [[], ["legal_advice"], [], ["internal_data"]]


def test_actions(spark):
    custom = (
        Policy("word", action="redact", keywords=("secret",)),
        Policy("amount", action="redact", regex_patterns=(r"\$(?P<n>\d+)k",)),
        Policy("fine", action="allow", keywords=("hello",)),
    )
    texts = ["They diagnose my symptoms", "hello Secret secret, $5K and $10k", "confidential secret", "plain"]
    rows = with_policy_actions(with_violations(frame(spark, texts), custom=custom), custom=custom).orderBy("id").collect()
    first, second, third, fourth = (r.applied for r in rows)
    assert (first.blocked, first.processed_text) == (True, None)
    assert first.applied_actions[0].startswith("BLOCKED: Medical advice")
    assert second.processed_text == "hello Secret [POLICY-REDACTED], [POLICY-REDACTED] and [POLICY-REDACTED]"
    assert second.applied_actions == ["REDACTED: secret", r"REDACTED: pattern: \$(?P<n>\d+)k"]
    assert third.processed_text == "confidential [POLICY-REDACTED]"
    assert third.warnings == ["Potentially confidential information detected."]
    assert third.applied_actions == ["WARNING: Potentially confidential information detected.", "REDACTED: secret"]
    assert (fourth.processed_text, fourth.applied_actions, fourth.warnings) == ("plain", [], [])


def test_redaction_uses_the_patterns_of_the_detection(spark):
    custom = (Policy("twice", action="redact", regex_patterns=(r"(?P<w>\w+) (?P=w)\Z", r"№[&&]{,2}")),)
    texts = ["say bye bye", "№&& x", "éé éé", "plain"]
    for unicode in (True, False):
        config = ScanConfig(unicode_regex=unicode)
        rows = with_policy_actions(with_violations(frame(spark, texts), config=config, custom=custom), config=config, custom=custom)
        got = [r.applied.processed_text for r in rows.orderBy("id").collect()]
        last = "[POLICY-REDACTED]" if unicode else "éé éé"
        assert got == ["say [POLICY-REDACTED]", "[POLICY-REDACTED] x", last, "plain"]


def test_summary_and_totals(spark):
    df = with_violations(frame(spark, ["medical advice, legal advice, confidential", "confidential"]))
    s = df.filter("id = 0").select(F.expr(policy_summary("violations")).alias("s")).first().s
    assert (s.total_violations, s.should_block) == (3, True)
    assert s.by_category == {"medical": 1, "legal": 1, "confidential": 1}
    assert s.by_action.asDict() == {"allow": 0, "warn": 1, "block": 2, "redact": 0}
    assert s.by_severity.asDict() == {"critical": 0, "high": 2, "medium": 1, "low": 0}
    assert len(s.messages) == 3
    totals = {(r.category, r.action, r.severity): r.violations for r in policy_totals(df).collect()}
    assert totals[("confidential", "warn", "medium")] == 2
