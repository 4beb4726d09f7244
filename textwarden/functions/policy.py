"""Policy checks as SQL expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import zip_longest

from textwarden.functions.hints import LiteralTests, odd_letters
from textwarden.functions.pii import count_map, field_counts
from textwarden.functions.sql import array, let, lit, struct
from textwarden.sources.catalogs import ACTIONS, SEVERITIES, Policy, java_regex

VIOLATION_TYPE = (
    "struct<policy_name:string,category:string,matched_keyword:string,action:string,"
    "message:string,severity:string,confidence:double>"
)
POLICY_MARK = "[POLICY-REDACTED]"


def check_policies(
    text: str,
    policies: Iterable[Policy],
    lowered: str | None = None,
    odd: str | None = None,
    unicode: bool = True,
    whole_word: bool = False,
) -> str:
    """At most one violation per policy, in catalog order, as ``ARRAY<VIOLATION_TYPE>``.

    ``lowered`` is the lower-cased text and ``odd`` the result of ``odd_letters``, if the caller has them as
    columns already.
    """
    policies = tuple(policies)
    if not policies:
        return f"if({text} IS NULL, NULL, {array([], VIOLATION_TYPE)})"
    lowered = f"lower({text})" if lowered is None else lowered
    literals = [k.lower() for p in policies for k in p.keywords]
    literals += [h for p in policies for hints in p.regex_hints for h in hints]
    tests = LiteralTests(literals, lowered, "t")
    checked = array(
        struct(
            policy_name=lit(p.name),
            category=lit(p.category),
            matched_keyword=_matched_rule(p, tests, unicode, whole_word),
            action=lit(p.action),
            message=lit(p.message),
            severity=lit(p.severity),
            confidence=lit(1.0),
        )
        for p in policies
    )
    shared = struct(
        text=text,
        lowered=lowered,
        odd=odd_letters(text) if odd is None else odd,
        **tests.fields,
    )
    found = let("t", shared, f"filter({checked}, v -> v.matched_keyword IS NOT NULL)")
    return f"if({text} IS NULL, NULL, {found})"


def _matched_rule(policy: Policy, literals: LiteralTests, unicode: bool, whole_word: bool) -> str:
    """The first keyword found in the text, else the first regex (as ``pattern: ...``), else null."""
    cases = []
    for keyword in policy.keywords:
        hit = literals.contains(keyword.lower())
        if whole_word:
            hit += f" AND rlike(t.text, {lit(java_regex(rf'\b{re.escape(keyword)}\b', unicode))})"
        cases.append(f"WHEN {hit} THEN {lit(keyword)}")
    for regex, hints in zip_longest(policy.regex_patterns, policy.regex_hints, fillvalue=()):
        hit = f"{literals.may_match(hints)} AND rlike(t.text, {lit(java_regex(regex, unicode))})"
        cases.append(f"WHEN {hit} THEN {lit(f'pattern: {regex}')}")
    return f"CASE {' '.join(cases)} END" if cases else "CAST(NULL AS string)"


def should_block(violations: str) -> str:
    return f"exists({violations}, v -> v.action = 'block')"


def policy_summary(violations: str) -> str:
    """Total, blocking or not, counts by category, severity and action, and the distinct messages in order."""
    return struct(
        total_violations=f"size({violations})",
        should_block=should_block(violations),
        by_category=count_map(f"transform({violations}, v -> v.category)"),
        by_severity=field_counts(violations, "severity", SEVERITIES),
        by_action=field_counts(violations, "action", ACTIONS),
        messages=f"array_distinct(transform({violations}, v -> v.message))",
    )


def apply_policy_actions(text: str, violations: str, policies: Iterable[Policy], unicode: bool = True) -> str:
    """Carry out what the violations ask for: withhold the text, warn, or replace what was matched.

    A regex is replaced in any case of letters, a keyword only as it is written in the catalog. ``policies`` and
    ``unicode`` are those the violations were found with: what is replaced is what was detected.
    """
    # One replacement per rule of the policies that redact, in their order, each with a literal pattern.
    redacted = text
    for p in policies:
        if p.action != "redact":
            continue
        rules = {k: f"replace(before, {lit(k)}, {lit(POLICY_MARK)})" for k in p.keywords}
        for r in p.regex_patterns:
            rules[f"pattern: {r}"] = f"regexp_replace(before, {lit(java_regex(r, unicode))}, {lit(POLICY_MARK)})"
        matched = f"get(filter({violations}, v -> v.policy_name = {lit(p.name)}), 0).matched_keyword"
        cases = " ".join(f"WHEN {lit(rule)} THEN {replaced}" for rule, replaced in rules.items())
        if cases:
            redacted = let("before", redacted, f"CASE {matched} {cases} ELSE before END")
    done = (
        f"transform(filter({violations}, v -> v.action != 'allow'), v -> CASE v.action "
        "WHEN 'block' THEN concat('BLOCKED: ', v.message) WHEN 'warn' THEN concat('WARNING: ', v.message) "
        "ELSE concat('REDACTED: ', v.matched_keyword) END)"
    )
    return struct(
        original_text=text,
        processed_text=f"if({should_block(violations)}, NULL, {redacted})",
        blocked=should_block(violations),
        warnings=f"transform(filter({violations}, v -> v.action = 'warn'), v -> v.message)",
        applied_actions=done,
    )


def decide_action(violations: str) -> str:
    """``blocked`` if any violation blocks, ``warned`` if there is any, else ``allowed``."""
    return f"CASE WHEN {should_block(violations)} THEN 'blocked' WHEN size({violations}) > 0 THEN 'warned' ELSE 'allowed' END"
