"""JSON text of audit entries exactly as the hash covers it, and the hash."""

from __future__ import annotations

from textwarden.functions.sql import let, lit

# The hashed JSON has these keys in this order, ", " and ": " as separators, ASCII-only escapes
# with lower-case digits, and null for absent values. The first entry of a log links to GENESIS.
HASH_KEYS = ("action_taken", "event_type", "original_text", "prev_hash", "timestamp")
GENESIS = "genesis"
SHORT_ESCAPES = (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))

# Markers for the characters to escape; their own occurrences are escaped before the marking.
_OPEN, _CLOSE = "\x01", "\x02"


def json_string(text: str) -> str:
    """The JSON literal of a string, non-ASCII characters as ``\\uXXXX``; ``null`` for null."""
    plain = f"rlike({text}, {lit(r'\A[ !#-\[\]-~]*\z')})"
    return f"CASE WHEN {text} IS NULL THEN 'null' WHEN {plain} THEN concat('\"', {text}, '\"') ELSE concat('\"', {_escaped(text)}, '\"') END"


def _escaped(text: str) -> str:
    for char, escape in (("\\", "\\\\"), ('"', '\\"'), (_OPEN, "\\u0001"), (_CLOSE, "\\u0002"), *SHORT_ESCAPES):
        text = f"replace({text}, {lit(char)}, {lit(escape)})"
    marked = f"regexp_replace({text}, '([^ -~])', {lit(f'{_OPEN}$1{_CLOSE}')})"
    # All pieces but the first begin with one character to escape and the closing marker.
    units = "lower(hex(encode(substr(p, 1, 1), 'UTF-16BE')))"
    escaped = f"concat(regexp_replace({units}, '(.{{4}})', {lit(r'\\u$1')}), substr(p, 3))"
    pieces = f"transform(ps, (p, i) -> if(i = 0, p, {escaped}))"
    return let("ps", f"split({marked}, {lit(_OPEN)}, -1)", f"array_join({pieces}, '')")


def hash_head(action_taken: str, event_type: str, original_text: str) -> str:
    """The hashed JSON up to the value of ``prev_hash``."""
    values = [json_string(v) for v in (action_taken, event_type, original_text)]
    parts = []
    for key, value in zip(HASH_KEYS, values):
        parts += [lit(f'{"," if parts else "{"}{" " if parts else ""}"{key}": '), value]
    return f"concat({', '.join(parts)}, {lit(f', "{HASH_KEYS[3]}": ')})"


def hash_tail(timestamp: str) -> str:
    """The hashed JSON after the value of ``prev_hash``."""
    return f"concat({lit(f', "{HASH_KEYS[4]}": ')}, {json_string(timestamp)}, '}}')"


def entry_hash(action_taken: str, event_type: str, original_text: str, timestamp: str, prev_hash: str) -> str:
    """SHA-256, in hex, of one audit entry linked to ``prev_hash``."""
    head = hash_head(action_taken, event_type, original_text)
    return f"sha2(concat({head}, {json_string(prev_hash)}, {hash_tail(timestamp)}), 256)"


def iso_timestamp(ts: str) -> str:
    """ISO 8601 text of a timestamp; the fraction is left out when it is zero."""
    pattern = lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return f"regexp_replace(date_format({ts}, {pattern}), {lit(r'\.000000$')}, '')"
