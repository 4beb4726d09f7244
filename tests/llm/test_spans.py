from __future__ import annotations

import random
import re

from textwarden.llm.bootstrap_pii import KINDS, find_pii
from textwarden.llm.secrets import RULES, Rule, redacted, scan_secrets, trigram_query


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24),
]
PRIVATE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
]


def plain(text, kinds):
    return sorted(
        (m.start(), k, m.end()) for k, (_, regex, ok) in enumerate(kinds) for m in re.finditer(regex, text or "", re.ASCII) if ok(m)
    )


def spans(row):
    return [(s.start, s.kind, s.end) for s in row]


PIECES = [
    "password", "PassWd", "secret", "Token", "api_key", "APIKEY", "=", ":", " ", " ", '"', "'", "abc123", "abcdefgh", "x", "é", "😀",
    "AKIA", "AKIA" + "Q1" * 9, "0123456789abcdef" * 2, "deadbeef", "\n", "a.b", "@", "post.example", "ſecret", "_", ".", "..", "%+",
    "1.2.3.4", "255.255.0.1", "256.1.1.1", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111", "-1111-1111", "+1 (646) 555-0182", "+", "12",
    "7" * 20, "  ", "- ", "(", ")", "﷐", "﷑", "﷒", "ghp_" + "aB3" * 12, "٣",
]


def test_random_texts_against_another_engine(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))) for _ in range(3000)] + [None, "a" * 30_000 + "@", "9" * 30_000, "f." * 9_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for row in scan_secrets(df).collect():
        own = [s for s in spans(row.spans) if s[1] < 3]
        assert own == plain(row.text, SECRETS), row.text
    base = {r.doc_id: spans(r.base_spans) for r in find_pii(df).collect()}
    for i, text in enumerate(texts):
        assert base[i] == plain(text, PRIVATE), text


def test_trigram_queries():
    query = lambda regex: {frozenset(x) for x in trigram_query(regex) or []}
    assert trigram_query("[0-9a-f]+") is None and trigram_query("ab") is None and trigram_query("(abcd)?x") is None
    assert query("AKIA[A-Z]{16}") == {frozenset(["aki", "kia"])}
    assert query("(abc|xabcx)y") == {frozenset(["abc", "bcy"]), frozenset(["xab", "abc", "bcx", "cxy"])}
    assert query("(?:ab){2}") == {frozenset(["aba", "bab"])}
    assert query("gh[pq]_.*token") == {frozenset(["ghp", "hp_", "tok", "oke", "ken"]), frozenset(["ghq", "hq_", "tok", "oke", "ken"])}
    assert query("[abcdefgh][abcdefgh][abcdefgh]xyz") == {frozenset([f"{c}xy", "xyz"]) for c in "abcdefgh"}


def test_no_query_hides_a_match():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for rule in RULES:
        query = trigram_query(rule.regex)
        for text in texts:
            if re.search(rule.regex, text, re.ASCII) and query is not None:
                assert any(all(g in text.lower() for g in grams) for grams in query)


def test_other_rules_and_redaction(spark):
    text = f"use ghp_{'zQ' * 18} or AIza{'x' * 35}; token = ghp_{'zQ' * 18}"
    df = spark.createDataFrame([(1, text, "own"), (2, "plain", "own"), (3, None, "own")], "doc_id long, text string, key string")
    found = scan_secrets(df, spans_col="found")
    assert found.columns == ["doc_id", "text", "key", "found"]
    rows = {r.doc_id: r for r in found.selectExpr("*", f"{redacted('text', 'found')} AS masked").collect()}
    kinds = [RULES[s.kind].kind for s in rows[1].found]
    assert kinds == ["github", "google", "assign", "github"]
    assert rows[1].masked == "use [SECRET] or [SECRET]; [SECRET]"
    assert (rows[2].masked, rows[3].masked, rows[3].found) == ("plain", None, [])
    only = scan_secrets(df, [Rule("digits", "[0-9]+")]).where("doc_id = 1").first()
    assert len(only.spans) == len(re.findall("[0-9]+", text))


def test_patterns_discover_identifiers_that_no_format_has(spark):
    rows = [f"customer {i}: reach me via hotline +1 646 555 01{i:02}, thanks" for i in range(30)]
    rows += ["you can also call hotline 5550-7788 today", "the year 2024 and hotlines 5550-7788", "page 12345 of the book"]
    rows += [f"on page {i}0000 nothing" for i in range(9)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r for r in find_pii(df).collect()}
    more = {i: [s for s in spans(r.spans) if s not in spans(r.base_spans)] for i, r in found.items()}
    at = rows[30].index("5550-7788")
    assert {i: m for i, m in more.items() if m} == {30: [(at, KINDS.index("phone"), at + 9)]}
    strict = find_pii(df, min_confidence=0.999)
    assert all(spans(r.spans) == spans(r.base_spans) for r in strict.collect())


def test_awkward_rows(awkward, empty):
    n = awkward.count()
    found = find_pii(awkward).collect()
    assert len(found) == n and all(r.spans == [] for r in found)
    scanned = scan_secrets(awkward, spans_col="found")
    assert scanned.columns == [*awkward.columns, "found"] and scanned.where("size(found) = 0 AND spans = 'own'").count() == n
    assert find_pii(empty).count() == 0 and scan_secrets(empty).count() == 0
