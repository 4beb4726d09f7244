"""The registered queries once more, as SQL for DuckDB over the same tables.

The SQL shares the catalogs and the texts planted into the tables with the Spark side, but none of its ways:
offsets, overlaps, summaries and chains are computed by joins, window functions and recursion.
"""

from __future__ import annotations

from collections.abc import Iterable

from textwarden.functions import risk
from textwarden.operators.audit import RECENT_LIMIT
from textwarden.operators.scan import REVIEW, SAFE, TOO_LONG
from textwarden.operators.stats import TOOL_DAYS
from textwarden.plans import registry, views
from textwarden.sources.catalogs import (
    ACTIONS,
    BUILTIN_PATTERNS,
    SEVERITIES,
    Pattern,
    Policy,
    active_patterns,
    active_policies,
)

CORE_PATTERNS = active_patterns()
ALL_PATTERNS = active_patterns(True)
CORE_POLICIES = active_policies()
ALL_POLICIES = active_policies(True)
MAX_LENGTH = registry.MAX_LENGTH


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _planted(key: str, text: str) -> str:
    return f"([{', '.join(q(s) for s in views.SNIPPETS)}])[{key} % {len(views.SNIPPETS)} + 1] || ' ' || {text}"


# Sources: key, text and what else the query needs.
PROMPTS = f"SELECT doc_id AS key, lang, source, {_planted('doc_id', 'text')} AS text FROM documents"
DOCUMENTS = "SELECT doc_id AS key, lang, text FROM documents"
PAGES = "SELECT page_id AS key, html AS text FROM pages"
TURNS = (
    "SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS key, conv_id, turn, role, "
    f"{_planted('(conv_id + turn)', 'text')} AS text FROM conversations"
)
EVENTS = (
    "SELECT event_id AS key, event_id, ts, user_id, event_type, "
    f"{_planted('event_id', 'props')} AS text FROM events"
)


def _with(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(ctes) + " "


def _src(source: str) -> str:
    return f"src AS MATERIALIZED ({source})"


def _luhn(value: str) -> str:
    digits = rf"regexp_replace({value}, '[-\s]', '', 'g')"
    d = f"CAST(substr({digits}, i, 1) AS INTEGER)"
    doubled = f"(length({digits}) - i) % 2 = 1"
    return (
        f"list_sum([CASE WHEN {doubled} AND {d} > 4 THEN 2 * {d} - 9 WHEN {doubled} THEN 2 * {d} ELSE {d} END "
        f"FOR i IN range(1, length({digits}) + 1)]) % 10 = 0"
    )


def _matches(patterns: Iterable[Pattern]) -> tuple[str, ...]:
    """CTE ``m``: key, ord, type, name, severity, value, s, e."""
    patterns = tuple(patterns)
    op, group, close = "chr(64976)", "chr(64978)", "chr(64977)"
    parts = " UNION ALL ".join(
        f"SELECT key, {i} AS ord, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM ("
        f"SELECT key, string_split(regexp_replace(text, {q(p.pattern)}, "
        rf"{op} || '\0' || {group} || '\{p.value_group}' || {close}, 'gi'), {op}) AS parts "
        f"FROM src WHERE regexp_matches(text, {q(p.pattern)}, 'i'))"
        for i, p in enumerate(patterns)
    )
    labels = ", ".join(
        f"({i}, {q(p.type)}, {q(p.name)}, {q(p.severity)}, {p.validator == 'luhn'})" for i, p in enumerate(patterns)
    )
    head = f"split_part(part, {close}, 1)"
    length = f"length(split_part({head}, {group}, 1))"
    return (
        f"parts AS ({parts})",
        f"labels(ord, type, name, severity, luhn) AS (VALUES {labels})",
        f"widths AS (SELECT key, ord, k, {length} AS n, split_part({head}, {group}, 2) AS value, "
        f"CASE WHEN k = 1 THEN length(part) ELSE length(part) - length({head}) - 1 + {length} END AS width FROM parts)",
        "placed AS (SELECT key, ord, k, n, value, CAST(sum(width) OVER (PARTITION BY key, ord ORDER BY k "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS s FROM widths)",
        "m AS MATERIALIZED (SELECT p.key, p.ord, l.type, l.name, l.severity, p.value, p.s, p.s + p.n AS e "
        f"FROM placed p JOIN labels l USING (ord) WHERE p.k > 1 AND (NOT l.luhn OR {_luhn('p.value')}))",
    )


def _replacement(style: str, name: str, length: str) -> str:
    if style == "[REDACTED-TYPE]":
        return f"'[REDACTED-' || upper({name}) || ']'"
    if style == "[REDACTED-XXX]":
        return f"'[' || repeat('X', CAST(greatest({length} - 2, 0) AS INTEGER)) || ']'"
    return q(style)


def _merged(style: str = "[REDACTED]") -> tuple[str, ...]:
    """CTE ``red``: key, redacted; overlapping spans joined first."""
    order = "ORDER BY s, e DESC, ord"
    return (
        f"marked AS (SELECT *, coalesce(s >= max(e) OVER (PARTITION BY key {order} ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND 1 PRECEDING), true) AS opens FROM m)",
        f"numbered AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY key {order} ROWS UNBOUNDED PRECEDING) AS island FROM marked)",
        f"islands AS (SELECT key, island, min(s) AS s, max(e) AS e, first(name {order}) AS name FROM numbered GROUP BY key, island)",
        "gaps AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY key ORDER BY island), 0) AS before FROM islands)",
        "pieces AS (SELECT g.key, g.island, g.e, substr(src.text, g.before + 1, g.s - g.before) || "
        f"{_replacement(style, 'g.name', '(g.e - g.s)')} AS piece FROM gaps g JOIN src USING (key))",
        "joined AS (SELECT key, string_agg(piece, '' ORDER BY island) AS start, max(e) AS e FROM pieces GROUP BY key)",
        "red AS (SELECT src.key, CASE WHEN j.key IS NULL THEN src.text ELSE j.start || substr(src.text, j.e + 1) END AS redacted "
        "FROM src LEFT JOIN joined j USING (key))",
    )


def _spliced(style: str) -> tuple[str, ...]:
    """CTE ``red``: key, redacted; every span replaced on its own from right to left."""
    return (
        "steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, ord) AS n FROM m)",
        "walk AS (SELECT key, text, CAST(0 AS BIGINT) AS n FROM src UNION ALL "
        f"SELECT w.key, substr(w.text, 1, t.s) || {_replacement(style, 't.name', '(t.e - t.s)')} || substr(w.text, t.e + 1), t.n "
        "FROM walk w JOIN steps t ON t.key = w.key AND t.n = w.n + 1)",
        "red AS (SELECT key, arg_max(text, n) AS redacted FROM walk GROUP BY key)",
    )


def _rule(policy: Policy, whole_word: bool = False) -> str:
    cases = []
    for k in policy.keywords:
        hit = f"contains(lower(text), {q(k.lower())})"
        if whole_word:
            hit += f" AND regexp_matches(text, {q(rf'\b{k}\b')}, 'i')"
        cases.append(f"WHEN {hit} THEN {q(k)}")
    for r in policy.regex_patterns:
        cases.append(f"WHEN regexp_matches(text, {q(r)}, 'i') THEN {q(f'pattern: {r}')}")
    return f"CASE {' '.join(cases)} END"


def _violations(policies: Iterable[Policy], whole_word: bool = False) -> str:
    """CTE ``v``: key, ord, policy_name, category, matched_keyword, action, message, severity."""
    parts = " UNION ALL ".join(
        f"SELECT key, {i} AS ord, {q(p.name)} AS policy_name, {q(p.category)} AS category, "
        f"{_rule(p, whole_word)} AS matched_keyword, {q(p.action)} AS action, {q(p.message)} AS message, "
        f"{q(p.severity)} AS severity FROM src"
        for i, p in enumerate(policies)
    )
    return f"v AS MATERIALIZED (SELECT * FROM ({parts}) WHERE matched_keyword IS NOT NULL)"


NO_MATCHES = (
    "m AS (SELECT key, 0 AS ord, '' AS type, '' AS name, '' AS severity, '' AS value, CAST(0 AS BIGINT) AS s, "
    "CAST(0 AS BIGINT) AS e FROM src WHERE false)"
)
NO_VIOLATIONS = (
    "v AS (SELECT key, 0 AS ord, '' AS policy_name, '' AS category, '' AS matched_keyword, '' AS action, "
    "'' AS message, '' AS severity FROM src WHERE false)"
)
UNREDACTED = "red AS (SELECT key, text AS redacted FROM src)"

PER_TEXT_M = (
    "pm AS (SELECT key, count(*) AS n_pii, string_agg(type || ':' || name || ':' || severity, '|' ORDER BY s, ord) AS pii_detected FROM m GROUP BY key)"
)
PER_TEXT_V = (
    "pv AS (SELECT key, count(*) AS n_violations, bool_or(action = 'block') AS blocks, "
    "string_agg(policy_name || ':' || category || ':' || action || ':' || message, '|' ORDER BY ord) AS policy_violations FROM v GROUP BY key)"
)
SCANNED = (
    "scanned AS (SELECT src.*, red.redacted AS redacted_text, coalesce(pm.pii_detected, '') AS pii_detected, "
    "coalesce(pm.n_pii, 0) AS n_pii, coalesce(pv.policy_violations, '') AS policy_violations, "
    "coalesce(pv.n_violations, 0) AS n_violations, CASE WHEN pv.blocks THEN 'blocked' WHEN pv.n_violations > 0 "
    "THEN 'warned' ELSE 'allowed' END AS action FROM src JOIN red USING (key) LEFT JOIN pm USING (key) LEFT JOIN pv USING (key))"
)


def _scan(source: str, matches: tuple[str, ...], redaction: tuple[str, ...], violations: str) -> tuple[str, ...]:
    """CTE ``scanned``."""
    return (_src(source), *matches, *redaction, violations, PER_TEXT_M, PER_TEXT_V, SCANNED)


CORE_SCAN = (_matches(CORE_PATTERNS), _merged(), _violations(CORE_POLICIES))


def _scan_rows(source: str, keys: str, parts: tuple) -> str:
    return (
        _with(*_scan(source, *parts))
        + f"SELECT {keys}, CASE WHEN action <> 'blocked' THEN redacted_text END AS redacted_prompt, pii_detected, "
        "policy_violations, action, action <> 'blocked' AS safe_to_send, n_pii, n_violations, redacted_text, "
        "CAST(NULL AS VARCHAR) AS error, CAST(NULL AS BIGINT) AS max_length FROM scanned"
    )


def _pii_rows(patterns: Iterable[Pattern]) -> str:
    return (
        _with(_src(PROMPTS), *_matches(patterns))
        + "SELECT key AS doc_id, type, name, value, s AS match_start, e AS match_end, severity, CAST(1.0 AS DOUBLE) AS confidence FROM m"
    )


def _pii_totals(source: str, by: str = "") -> str:
    keyed = f"src.{by}, " if by else ""
    return (
        _with(_src(source), *_matches(ALL_PATTERNS))
        + f"SELECT {keyed}m.type, m.severity, count(*) AS matches, count(DISTINCT m.key) AS texts FROM m JOIN src USING (key) GROUP BY ALL"
    )


def _redacted(style: str, patterns: Iterable[Pattern] = ALL_PATTERNS) -> str:
    return _with(_src(PROMPTS), *_matches(patterns), *_merged(style)) + "SELECT key AS doc_id, redacted FROM red"


def _redact_spliced(style: str) -> str:
    return (
        _with(_src(PROMPTS), *_matches(ALL_PATTERNS), *_spliced(style), recursive=True)
        + "SELECT key AS doc_id, redacted FROM red"
    )


def _violation_rows(policies: Iterable[Policy], whole_word: bool = False) -> str:
    return (
        _with(_src(PROMPTS), _violations(policies, whole_word))
        + "SELECT key AS doc_id, policy_name, category, matched_keyword, action, message, severity, CAST(1.0 AS DOUBLE) AS confidence FROM v"
    )


def _pattern_catalog() -> str:
    rows = ", ".join(
        f"({i}, {q(p.type)}, {q(p.pattern)}, {q(p.name)}, {q(p.severity)}, {q(p.description)}, {p.extended})"
        for i, p in enumerate(ALL_PATTERNS)
    )
    return (
        _with(_src(PROMPTS), *_matches(ALL_PATTERNS))
        + "SELECT c.ordinal, c.type, c.pattern, c.name, c.severity, c.description, c.extended, "
        "(SELECT count(*) FROM m WHERE m.type = c.type) AS matches "
        f"FROM (VALUES {rows}) c(ordinal, type, pattern, name, severity, description, extended)"
    )


def _policy_catalog() -> str:
    rows = ", ".join(
        f"({i}, {q(p.name)}, {q(p.category)}, {q('|'.join(p.keywords))}, {q(' ; '.join(p.regex_patterns))}, "
        f"{q(p.action)}, {q(p.message)}, {q(p.severity)})"
        for i, p in enumerate(ALL_POLICIES)
    )
    return (
        _with(_src(PROMPTS), _violations(ALL_POLICIES))
        + "SELECT c.*, (SELECT count(*) FROM v WHERE v.policy_name = c.name) AS violations "
        f"FROM (VALUES {rows}) c(ordinal, name, category, keywords, regex_patterns, action, message, severity)"
    )


def _luhn_cards() -> str:
    card = next(p for p in BUILTIN_PATTERNS if p.type == "credit_card").pattern
    return (
        f"SELECT doc_id, card, {_luhn('card')} AS valid FROM (SELECT doc_id, "
        f"unnest(regexp_extract_all(text, {q(card)})) AS card FROM documents)"
    )


def _pii_summary_row() -> str:
    severities = ", ".join(f"coalesce(count(*) FILTER (severity = '{s}'), 0) AS {s}" for s in SEVERITIES)
    zeros = ", ".join(f"coalesce(a.{s}, 0) AS {s}" for s in SEVERITIES)
    return (
        _with(
            _src(PROMPTS),
            *_matches(ALL_PATTERNS),
            "t AS (SELECT key, type, count(*) AS n FROM m GROUP BY key, type)",
            "bt AS (SELECT key, string_agg(type || '=' || n, ',' ORDER BY type || '=' || n) AS by_type FROM t GROUP BY key)",
            "un AS (SELECT key, string_agg(name, ',' ORDER BY name) AS unique_types FROM (SELECT DISTINCT key, name FROM m) GROUP BY key)",
            f"a AS (SELECT key, count(*) AS total_count, {severities} FROM m GROUP BY key)",
        )
        + f"SELECT src.key AS doc_id, coalesce(a.total_count, 0) AS total_count, coalesce(bt.by_type, '') AS by_type, {zeros}, "
        "coalesce(un.unique_types, '') AS unique_types FROM src LEFT JOIN a USING (key) LEFT JOIN bt USING (key) LEFT JOIN un USING (key)"
    )


def _policy_summary_row() -> str:
    names = [*SEVERITIES, *[f"n_{a}" for a in ACTIONS]]
    counts = ", ".join(
        [f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES]
        + [f"count(*) FILTER (action = '{a}') AS n_{a}" for a in ACTIONS]
    )
    zeros = ", ".join(f"coalesce(a.{n}, 0) AS {n}" for n in names)
    return (
        _with(
            _src(PROMPTS),
            _violations(ALL_POLICIES),
            "t AS (SELECT key, category, count(*) AS n FROM v GROUP BY key, category)",
            "bc AS (SELECT key, string_agg(category || '=' || n, ',' ORDER BY category || '=' || n) AS by_category FROM t GROUP BY key)",
            "f AS (SELECT key, message, min(ord) AS ord FROM v GROUP BY key, message)",
            "ms AS (SELECT key, string_agg(message, '|' ORDER BY ord) AS messages FROM f GROUP BY key)",
            f"a AS (SELECT key, count(*) AS total, bool_or(action = 'block') AS blocks, {counts} FROM v GROUP BY key)",
        )
        + "SELECT src.key AS doc_id, coalesce(a.total, 0) AS total_violations, coalesce(a.blocks, false) AS should_block, "
        f"coalesce(bc.by_category, '') AS by_category, {zeros}, coalesce(ms.messages, '') AS messages "
        "FROM src LEFT JOIN a USING (key) LEFT JOIN bc USING (key) LEFT JOIN ms USING (key)"
    )


def _policy_actions() -> str:
    policies = active_policies(custom=views.CUSTOM_POLICIES)
    # One nested query per policy that redacts, in catalog order.
    text = "SELECT key, text AS original, text AS current FROM src"
    for p in policies:
        if p.action != "redact":
            continue
        cases = "".join(
            f" WHEN v.matched_keyword = {q(f'pattern: {r}')} THEN regexp_replace(x.current, {q(r)}, '[POLICY-REDACTED]', 'gi')"
            for r in p.regex_patterns
        ) + "".join(
            f" WHEN v.matched_keyword = {q(k)} THEN replace(x.current, {q(k)}, '[POLICY-REDACTED]')" for k in p.keywords
        )
        text = (
            f"SELECT x.key, x.original, CASE{cases} ELSE x.current END AS current FROM ({text}) x "
            f"LEFT JOIN v ON v.key = x.key AND v.policy_name = {q(p.name)}"
        )
    return (
        _with(
            _src(PROMPTS),
            _violations(policies),
            f"x AS ({text})",
            "a AS (SELECT key, bool_or(action = 'block') AS blocked, "
            "string_agg(message, '|' ORDER BY ord) FILTER (action = 'warn') AS warnings, "
            "string_agg(CASE action WHEN 'block' THEN 'BLOCKED: ' || message WHEN 'warn' THEN 'WARNING: ' || message "
            "ELSE 'REDACTED: ' || matched_keyword END, '|' ORDER BY ord) AS applied_actions FROM v GROUP BY key)",
        )
        + "SELECT x.key AS doc_id, CASE WHEN NOT coalesce(a.blocked, false) THEN x.current END AS processed_text, "
        "coalesce(a.blocked, false) AS blocked, coalesce(a.warnings, '') AS warnings, "
        "coalesce(a.applied_actions, '') AS applied_actions FROM x LEFT JOIN a USING (key)"
    )


def _findings(*more: str) -> str:
    return _with(_src(PROMPTS), *_matches(ALL_PATTERNS), _violations(ALL_POLICIES), PER_TEXT_M, PER_TEXT_V, *more)


def _risks() -> str:
    def points(field: str, table: dict, other: int) -> str:
        return f"CASE {field} " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in table.items()) + f" ELSE {other} END"

    levels = " ".join(f"WHEN score >= {least} THEN '{level}'" for level, least in risk.LEVELS.items())
    return (
        f"sm AS (SELECT key, CAST(sum({points('severity', risk.PII_POINTS, risk.PII_POINTS_OTHER)}) AS BIGINT) AS n FROM m GROUP BY key), "
        f"sv AS (SELECT key, CAST(sum({points('action', risk.POLICY_POINTS, risk.POLICY_POINTS_OTHER)}) AS BIGINT) AS n FROM v GROUP BY key), "
        "scores AS (SELECT src.key, coalesce(sm.n, 0) AS pii_score, coalesce(sv.n, 0) AS policy_score, "
        f"least(coalesce(sm.n, 0) + coalesce(sv.n, 0), {risk.MAX_SCORE}) AS score "
        "FROM src LEFT JOIN sm USING (key) LEFT JOIN sv USING (key)), "
        f"risks AS (SELECT *, CASE {levels} ELSE '{risk.LOWEST_LEVEL}' END AS level FROM scores)"
    )


# JSON text with ASCII-only escapes, as the hashes cover it.
def _json(text: str) -> str:
    short = "".join(
        f" WHEN {code} THEN '{escape}'"
        for code, escape in ((34, '\\"'), (92, "\\\\"), (10, "\\n"), (13, "\\r"), (9, "\\t"), (8, "\\b"), (12, "\\f"))
    )
    unit = "'\\u' || lower(lpad(hex({}), 4, '0'))".format
    code = "unicode(c)"
    escaped = (
        f"CASE {code}{short} ELSE CASE WHEN {code} BETWEEN 32 AND 126 THEN c WHEN {code} < 65536 THEN {unit(code)} "
        f"ELSE {unit(f'55296 + (({code} - 65536) >> 10)')} || {unit(f'56320 + (({code} - 65536) & 1023)')} END END"
    )
    return f"'\"' || array_to_string([{escaped} FOR c IN regexp_extract_all({text}, '(?s).')], '') || '\"'"


def _entry_hashes() -> str:
    return (
        "SELECT key AS doc_id, sha256('{\"action_taken\": \"allowed\", \"event_type\": \"scan\", \"original_text\": ' || "
        f"{_json('text')} || ', \"prev_hash\": \"genesis\", \"timestamp\": \"2024-01-01T12:00:00\"}}') AS hash FROM ({PROMPTS})"
    )


# Rows of a segment, for a chain that is not cut.
UNBROKEN = 2**62


def _log(*more: str, chain: str = "user", segment_rows: int = UNBROKEN) -> str:
    """CTE ``log``: the scanned and hashed events."""
    chain_id = "'user-' || user_id" if chain == "user" else "'main'"
    return _with(
        *_scan(EVENTS, *CORE_SCAN),
        f"e AS MATERIALIZED (SELECT *, {chain_id} AS chain_id, row_number() OVER (PARTITION BY {chain_id} ORDER BY ts, key) AS seq, "
        "regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') AS timestamp, "
        "'session-' || strftime(ts, '%Y%m%d') AS session_id FROM scanned)",
        f"hashed AS MATERIALIZED (SELECT *, (seq - 1) // {segment_rows} AS segment, '{{\"action_taken\": \"' || action || '\", \"event_type\": \"' || "
        f"event_type || '\", \"original_text\": ' || {_json('text')} || ', \"prev_hash\": \"' AS head, "
        "'\", \"timestamp\": \"' || timestamp || '\"}' AS tail FROM e)",
        "seeds AS (SELECT *, CASE WHEN segment = 0 THEN 'genesis' ELSE sha256('genesis:' || chain_id || ':' || segment) END AS seed FROM hashed "
        f"WHERE (seq - 1) % {segment_rows} = 0)",
        "walk AS (SELECT chain_id, segment, seq, seed AS prev_hash, sha256(head || seed || tail) AS hash FROM seeds UNION ALL "
        "SELECT h.chain_id, h.segment, h.seq, w.hash, sha256(h.head || w.hash || h.tail) FROM walk w JOIN hashed h "
        "ON h.chain_id = w.chain_id AND h.segment = w.segment AND h.seq = w.seq + 1)",
        "log AS MATERIALIZED (SELECT h.*, w.prev_hash, w.hash FROM hashed h JOIN walk w USING (chain_id, seq))",
        *more,
        recursive=True,
    )


LOG_COLUMNS = (
    "SELECT event_id, chain_id, seq, timestamp, event_type, action AS action_taken, CAST(user_id AS VARCHAR) AS user_id, "
    "session_id, redacted_text, n_pii, n_violations, hash FROM log"
)
NEWEST = "ORDER BY ts DESC, seq DESC, chain_id"
CHECKED = (
    "checked AS (SELECT *, sha256(head || before || tail) <> hash AS wrong, before <> prev_hash AS unlinked FROM (SELECT *, "
    "coalesce(lag(hash) OVER (PARTITION BY chain_id ORDER BY seq), 'genesis') AS before FROM log))"
)
REPORT = (
    "SELECT NOT bool_or(wrong) AS valid, count(*) AS entries_checked, count(*) FILTER (wrong) AS invalid_count, "
    "count(*) FILTER (unlinked) AS broken_links, CAST(0 AS BIGINT) AS gaps, CASE WHEN bool_or(wrong) THEN 'Found ' || "
    "count(*) FILTER (wrong) || ' invalid entries' ELSE 'Hash chain is intact' END AS message FROM "
)
DAILY = (
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS total_scans, CAST(sum(n_pii) AS BIGINT) AS pii_detections, "
    "CAST(sum(n_violations) AS BIGINT) AS policy_violations, count(*) FILTER (action = 'blocked') AS blocked_prompts FROM scanned GROUP BY 1"
)
PERIOD = f"CAST(date AS DATE) BETWEEN DATE '{registry.AS_OF}' - {TOOL_DAYS - 1} AND DATE '{registry.AS_OF}'"
HIT = f"event_id % {registry.TAMPERED_EVERY} = 0"
HEADS = "SELECT chain_id, max(seq) AS last_seq, arg_max(hash, seq) AS last_hash"


# Queries whose SQL would be too slow on whole tables; their tests compare them with brute force instead.
WITHOUT_SQL = {"keywords_indexed": "every document against every keyword with contains; tests/test_keyword_index.py"}


def oracle_queries() -> dict[str, str]:
    event_scan = _with(*_scan(EVENTS, *CORE_SCAN))
    before = f"TIMESTAMP '{registry.PURGE_BEFORE}'"
    extended = (_matches(ALL_PATTERNS), _merged(), _violations(ALL_POLICIES))
    turns = "conv_id, turn, role"
    return {
        "scan_actions_by_role": _with(*_scan(TURNS, *extended))
        + "SELECT role, action, count(*) AS turns, CAST(sum(n_pii) AS BIGINT) AS pii_found, CAST(sum(n_violations) AS BIGINT) AS violations "
        "FROM scanned GROUP BY role, action",
        "pattern_catalog": _pattern_catalog(),
        "policy_catalog": _policy_catalog(),
        "pii_matches": _pii_rows(CORE_PATTERNS),
        "pii_matches_extended": _pii_rows(ALL_PATTERNS),
        "pii_matches_custom": _pii_rows(active_patterns(custom=views.CUSTOM_PATTERNS)),
        "pii_matches_from_file": _pii_rows(active_patterns(custom=views.CUSTOM_PATTERNS)),
        "pii_conversations": _with(_src(TURNS), *_matches(ALL_PATTERNS))
        + f"SELECT {turns}, type, value, s AS match_start, e AS match_end FROM m JOIN src USING (key)",
        "luhn_cards": _luhn_cards(),
        "redact_literal": _redacted("[REDACTED]"),
        "redact_custom_literal": _redacted("***", CORE_PATTERNS),
        "redact_type": _redacted("[REDACTED-TYPE]"),
        "redact_xxx": _redacted("[REDACTED-XXX]"),
        "redact_splice": _redact_spliced("[REDACTED]"),
        "redact_splice_type": _redact_spliced("[REDACTED-TYPE]"),
        "redact_tool": _with(
            _src(PROMPTS),
            *_matches(CORE_PATTERNS),
            *_merged(),
            PER_TEXT_M,
            "ty AS (SELECT key, string_agg(type, ',' ORDER BY type) AS pii_types FROM (SELECT DISTINCT key, type FROM m) GROUP BY key)",
        )
        + "SELECT src.key AS doc_id, src.text AS original, red.redacted, coalesce(pm.n_pii, 0) AS pii_found, "
        "coalesce(ty.pii_types, '') AS pii_types FROM src JOIN red USING (key) LEFT JOIN pm USING (key) LEFT JOIN ty USING (key)",
        "pii_summary_row": _pii_summary_row(),
        "pii_by_type": _pii_totals(PROMPTS),
        "pii_by_lang": _pii_totals(DOCUMENTS, "lang"),
        "pii_cube": _with(_src(PROMPTS), *_matches(ALL_PATTERNS))
        + "SELECT coalesce(lang, '*') AS lang, coalesce(type, '*') AS type, count(*) AS matches FROM m JOIN src USING (key) GROUP BY CUBE (lang, type)",
        "pii_pages": _pii_totals(PAGES),
        "policy_violations": _violation_rows(CORE_POLICIES),
        "policy_violations_extended": _violation_rows(ALL_POLICIES),
        "policy_violations_custom": _violation_rows(active_policies(custom=views.CUSTOM_POLICIES)),
        "policy_violations_from_file": _violation_rows(active_policies(custom=views.CUSTOM_POLICIES)),
        "policy_violations_whole_word": _violation_rows(CORE_POLICIES, whole_word=True),
        "policy_pages": _with(_src(PAGES), _violations(ALL_POLICIES))
        + "SELECT policy_name, matched_keyword, count(*) AS pages FROM v GROUP BY policy_name, matched_keyword",
        "policy_summary_row": _policy_summary_row(),
        "policy_by_category": _with(_src(PROMPTS), _violations(ALL_POLICIES))
        + "SELECT category, action, severity, count(*) AS violations FROM v GROUP BY category, action, severity",
        "policy_rollup": _with(_src(PROMPTS), _violations(ALL_POLICIES))
        + "SELECT coalesce(category, '*') AS category, coalesce(policy_name, '*') AS policy_name, count(*) AS violations "
        "FROM v GROUP BY ROLLUP (category, policy_name)",
        "policy_actions": _policy_actions(),
        "policy_actions_ascii": _policy_actions(),
        "scan_prompts": _scan_rows(PROMPTS, "key AS doc_id", CORE_SCAN),
        "scan_without_pii": _scan_rows(
            PROMPTS, "key AS doc_id", ((NO_MATCHES,), (UNREDACTED,), _violations(ALL_POLICIES))
        ),
        "scan_without_policies": _scan_rows(
            PROMPTS, "key AS doc_id", (_matches(ALL_PATTERNS), (UNREDACTED,), NO_VIOLATIONS)
        ),
        "scan_overlong": f"SELECT doc_id, {q(TOO_LONG)} AS error, CAST({MAX_LENGTH} AS BIGINT) AS max_length FROM documents "
        f"WHERE length(text) > {MAX_LENGTH}",
        "compliance": _findings()
        + "SELECT src.key AS doc_id, pm.key IS NULL AND pv.key IS NULL AS compliant, coalesce(pm.n_pii, 0) AS n_pii, "
        "coalesce(pv.n_violations, 0) AS n_violations, coalesce(pv.blocks, false) AS should_block, "
        f"CASE WHEN pm.key IS NULL AND pv.key IS NULL THEN {q(SAFE)} ELSE {q(REVIEW)} END AS recommendation "
        "FROM src LEFT JOIN pm USING (key) LEFT JOIN pv USING (key)",
        "risk_scores": _findings(_risks())
        + "SELECT key AS doc_id, score, level, pii_score, policy_score, CASE level "
        + " ".join(f"WHEN '{k}' THEN {q(t)}" for k, t in risk.RECOMMENDATIONS.items())
        + " END AS recommendation FROM risks",
        "risk_levels": _findings(_risks())
        + "SELECT level, count(*) AS texts, CAST(sum(score) AS BIGINT) AS total_score FROM risks GROUP BY level",
        "risk_topk": _findings(_risks())
        + f"SELECT key AS doc_id, score, level FROM risks ORDER BY score DESC, key LIMIT {registry.TOP_K}",
        "truncate": "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS short FROM documents",
        "sanitize": "SELECT key AS doc_id, CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '... [truncated]' ELSE t END AS logged "
        f"FROM (SELECT key, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS t FROM ({PROMPTS}))",
        "entry_hashes": _entry_hashes(),
        "audit_chain": _log()
        + "SELECT event_id, chain_id, seq, timestamp, event_type, text AS original_text, action AS action_taken, prev_hash, hash FROM log",
        "audit_chain_segments": _log(chain="main", segment_rows=registry.SEGMENT_ROWS)
        + "SELECT event_id, chain_id, seq, prev_hash, hash FROM log",
        "scan_logged": _log()
        + "SELECT event_id, CASE WHEN action <> 'blocked' THEN redacted_text END AS redacted_prompt, action <> 'blocked' AS safe_to_send, "
        "action, n_pii, hash AS audit_hash FROM log",
        # The chain recomputed from the entries, then held against its neighbours.
        "audit_verify": _log(CHECKED, chain="main") + REPORT + "checked",
        "audit_seals": _log(
            f"ends AS (SELECT chain_id, segment, arg_max(hash, seq) AS last_hash FROM log GROUP BY ALL)",
            "sealed AS (SELECT chain_id, segment, sha256('genesis:' || segment || ':' || last_hash) AS seal FROM ends WHERE segment = 0 "
            "UNION ALL SELECT e.chain_id, e.segment, sha256(s.seal || ':' || e.segment || ':' || e.last_hash) FROM sealed s JOIN ends e "
            "ON e.chain_id = s.chain_id AND e.segment = s.segment + 1)",
            chain="main",
            segment_rows=registry.SEGMENT_ROWS,
        )
        + "SELECT chain_id, max(segment) + 1 AS segments, arg_max(seal, segment) AS seal FROM sealed GROUP BY chain_id",
        "audit_forged_segment": _log(
            f"fresh AS (SELECT seq, CASE WHEN seq = 7 THEN regexp_replace(head, '\"original_text\": .*$', '\"original_text\": \"changed\", \"prev_hash\": \"', 's') "
            f"ELSE head END AS head, tail FROM hashed WHERE seq <= {registry.SEGMENT_ROWS})",
            "again AS (SELECT seq, sha256(head || 'genesis' || tail) AS hash FROM fresh WHERE seq = 1 UNION ALL "
            "SELECT f.seq, sha256(f.head || a.hash || f.tail) FROM again a JOIN fresh f ON f.seq = a.seq + 1)",
            chain="main",
            segment_rows=registry.SEGMENT_ROWS,
        )
        + "SELECT l.chain_id, CAST(0 AS BIGINT) AS segment, l.hash AS recorded_hash, a.hash AS found_hash, CAST(0 AS BIGINT) AS wrong_entries "
        f"FROM log l JOIN again a USING (seq) WHERE seq = least({registry.SEGMENT_ROWS}, (SELECT max(seq) FROM log))",
        "audit_verify_tampered": _log() + f"SELECT chain_id, seq, hash AS actual_hash FROM log WHERE {HIT}",
        "audit_verify_rehashed": _log(
            f"changed AS (SELECT *, CASE WHEN {HIT} THEN sha256(hash) ELSE hash END AS stored FROM log)",
            "seen AS (SELECT *, coalesce(lag(stored) OVER (PARTITION BY chain_id ORDER BY seq), 'genesis') AS before FROM changed)",
        )
        + "SELECT chain_id, seq, sha256(head || before || tail) AS expected_hash, stored AS actual_hash, before = prev_hash AS link_ok "
        "FROM seen WHERE sha256(head || before || tail) <> stored",
        "audit_import": _log(CHECKED, chain="main")
        + "SELECT seq, pii_detected, policy_violations, 'events' AS origin, NOT wrong AS hash_ok, NOT unlinked AS link_ok FROM checked",
        "audit_heads": _log() + HEADS + " FROM log GROUP BY chain_id",
        "audit_cut_tails": _log(
            "ends AS (SELECT chain_id, max(seq) AS last_seq, max(seq) FILTER (CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) FROM events)) "
            "AS found_seq FROM log GROUP BY chain_id)"
        )
        + "SELECT chain_id, last_seq, found_seq FROM ends WHERE found_seq IS DISTINCT FROM last_seq",
        "audit_query": _log()
        + f"{LOG_COLUMNS} WHERE timestamp >= '2024-01-05' AND timestamp <= '2024-01-12T18:00:00' AND action = 'blocked' {NEWEST} LIMIT 200",
        "audit_page": _log() + f"{LOG_COLUMNS} WHERE event_type = 'view' {NEWEST} LIMIT 100 OFFSET 300",
        "audit_recent": _log() + f"{LOG_COLUMNS} {NEWEST} LIMIT {RECENT_LIMIT}",
        "audit_export_csv": _log()
        + "SELECT seq AS id, timestamp, event_type, action AS action_taken, n_pii AS pii_count, n_violations AS violation_count, hash "
        f"FROM log WHERE timestamp >= '2024-01-10' {NEWEST}",
        "audit_export_json": _log()
        + "SELECT event_id, seq, text AS original_text, redacted_text, CAST(user_id AS VARCHAR) AS user_id, pii_detected, 'events' AS origin, hash "
        f"FROM log WHERE timestamp >= '2024-01-10' {NEWEST}",
        "audit_purge": _log()
        + f"SELECT chain_id, count(*) AS kept, min(seq) AS first_seq FROM log WHERE ts >= {before} GROUP BY chain_id",
        "audit_purge_anchors": _log()
        + f"SELECT chain_id, max(seq) AS anchor_seq, arg_max(hash, seq) AS anchor_hash FROM log WHERE ts < {before} GROUP BY chain_id",
        "audit_verify_purged": _log(CHECKED) + REPORT + f"checked WHERE ts >= {before}",
        "audit_two_writers": _log() + HEADS + ", count(*) AS entries FROM log GROUP BY chain_id",
        "audit_life": f"SELECT true AS valid, count(*) FILTER (ts >= {before}) AS entries_checked, CAST(0 AS BIGINT) AS invalid_count, "
        "CAST(0 AS BIGINT) AS broken_links, CAST(0 AS BIGINT) AS gaps, 'Hash chain is intact' AS message, "
        f"count(*) FILTER (ts < {before}) AS purged, CAST(0 AS BIGINT) AS cut FROM events",
        "audit_table": _log() + HEADS + ", count(*) AS entries FROM log GROUP BY chain_id",
        "stats_daily": event_scan + DAILY,
        "stats_merged": event_scan + DAILY,
        "stats_summary": event_scan
        + "SELECT CAST(coalesce(sum(total_scans), 0) AS BIGINT) AS total_scans, CAST(coalesce(sum(pii_detections), 0) AS BIGINT) AS total_pii_detections, "
        "CAST(coalesce(sum(policy_violations), 0) AS BIGINT) AS total_policy_violations, CAST(coalesce(sum(blocked_prompts), 0) AS BIGINT) AS total_blocked, "
        f"count(DISTINCT date) AS days_active FROM ({DAILY}) WHERE {PERIOD}",
        "stats_breakdown": event_scan
        + "SELECT date, total_scans AS scans, pii_detections AS pii, policy_violations AS violations, blocked_prompts AS blocked "
        f"FROM ({DAILY}) WHERE {PERIOD} ORDER BY date DESC",
        "unique_users_daily": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(DISTINCT user_id) AS unique_users FROM events GROUP BY 1",
        "rate_breaches": "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') AS window_start, count(*) AS requests "
        "FROM events GROUP BY 1, 2 HAVING count(*) > 1",
        "scan_stream": _scan_rows(TURNS, turns, extended),
        "audit_stream": _log() + "SELECT chain_id, seq, timestamp, action AS action_taken, prev_hash, hash FROM log",
        "audit_stream_state": _log() + "SELECT chain_id, seq, timestamp, action AS action_taken, prev_hash, hash FROM log",
        "stats_stream": event_scan + DAILY,
    }
