from __future__ import annotations

import json
import re

import pytest

from textwarden.config import ScanConfig
from textwarden.operators.scan import scan_table
from textwarden.sources.catalogs import (
    Pattern,
    Policy,
    active_patterns,
    active_policies,
    check_patterns,
    java_regex,
    load_patterns,
    load_policies,
    pattern_catalog,
    policy_catalog,
)


def write(tmp_path, content):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(content, indent=2))
    return str(path)


def test_listing(spark):
    assert pattern_catalog(spark).count() == 10
    assert pattern_catalog(spark, extended=True).count() == 15
    assert policy_catalog(spark).count() == 5
    assert policy_catalog(spark, extended=True).count() == 8
    row = policy_catalog(spark).orderBy("ordinal").first()
    assert (row.name, row.action, len(row.keywords)) == ("medical_advice", "block", 11)


def test_custom_files(spark, tmp_path):
    patterns = load_patterns(
        spark,
        write(tmp_path, {"badge": {"pattern": "HX-\\d{4}", "name": "Badge", "severity": "high"}, "plan": {"pattern": "orchard/(?P<p>\\w+)", "value_group": 1}}),
    )
    assert [(p.type, p.name, p.severity) for p in patterns] == [("badge", "Badge", "high"), ("plan", "plan", "medium")]
    policies = load_policies(
        spark,
        write(tmp_path, {"lines": {"keywords": ["comet orchard"], "action": "block", "message": "No."}, "legal_advice": {"keywords": ["jury"]}}),
    )
    df = spark.createDataFrame([("HX-4471 orchard/77 on Comet Orchard with a lawyer",)], "text string")
    row = scan_table(df, config=ScanConfig(), custom_patterns=patterns, custom_policies=policies).first()
    assert [p.type for p in row.pii_detected] == ["badge", "plan"]
    assert [(v.policy, v.category, v.message) for v in row.policy_violations] == [("lines", "general", "No.")]


def test_classes_and_repetitions_mean_what_they_mean_in_python(spark):
    regexes = ["[a-z&&0-9]+!", "[[(]x", "y{,3}z", r"[\]a]q", r"[^&&[]w", r"\{,3\}", "[]x]v"]
    texts = ["ab&1!", "[x", "(x", "yyz", "yyyyz", "]q", "aq", "&w", "[w", "bw", "{,3}", "]v", "xv", "z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for regex in regexes:
        check_patterns(spark, [Pattern("p", "P", "low", regex)])
        got = [r.text for r in df.filter(df.text.rlike(java_regex(regex))).collect()]
        assert got == [t for t in texts if re.search(regex, t, re.IGNORECASE)], regex


def test_replaced_entries_keep_their_place():
    names = [p.name for p in active_policies(custom=[Policy("legal_advice"), Policy("new")])]
    assert names.index("legal_advice") == 1 and names[-1] == "new"
    assert [p.type for p in active_patterns(custom=[Pattern("ssn", "S", "low", "x")])][0] == "ssn"


def test_bad_catalogs(spark, tmp_path):
    with pytest.raises(ValueError, match="policy 'p'"):
        load_policies(spark, write(tmp_path, {"p": {"regex_patterns": ["("]}}))
    with pytest.raises(ValueError, match="pattern 'q'"):
        load_patterns(spark, write(tmp_path, {"q": {"pattern": "[a"}}))
    with pytest.raises(ValueError, match="unknown severity"):
        load_patterns(spark, write(tmp_path, {"q": {"pattern": "a", "severity": "huge"}}))
    with pytest.raises(ValueError, match="unknown action"):
        Policy("p", action="stop")
    bad = [
        ("{", "not valid JSON"),
        ("", "expected one file"),
        ("[1]", "keyed by name"),
        ('{"p": 1}', "not an object"),
        ('{"custom": {"policies": {"p": {"keywords": ["x"]}}}}', "unknown fields"),
        ('{"p": {"keywords": "x"}}', "wrong type"),
        ('{"p": {"keywords": [1]}}', "wrong type"),
        ('{"p": {"keywords": []}}', "neither keywords nor regexes"),
    ]
    for i, (text, message) in enumerate(bad):
        path = tmp_path / f"bad-{i}.json"
        path.write_text(text)
        with pytest.raises(ValueError, match=message):
            load_policies(spark, str(path))
    with pytest.raises(ValueError, match="no regex"):
        load_patterns(spark, write(tmp_path, {"q": {"name": "Q"}}))
    assert load_policies(spark, write(tmp_path, {})) == ()
    with pytest.raises(ValueError, match="overlap"):
        ScanConfig(overlap="x")
