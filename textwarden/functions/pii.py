"""Personal data and secrets: matches, redaction and summaries as SQL expressions."""

from __future__ import annotations

from collections.abc import Iterable

from textwarden.functions.arrays import running_max
from textwarden.functions.hints import LiteralTests, digit_run, odd_letters
from textwarden.functions.spans import mark_matches, marked_spans
from textwarden.functions.sql import array, let, lit, struct
from textwarden.functions.text import luhn_valid
from textwarden.sources.catalogs import SEVERITIES, Pattern

STYLE_TYPE = "[REDACTED-TYPE]"
STYLE_XXX = "[REDACTED-XXX]"
STYLE_DEFAULT = "[REDACTED]"

MATCH_TYPE = (
    "struct<type:string,name:string,value:string,start:int,end:int,severity:string,confidence:double>"
)


def detect_pii(
    text: str,
    patterns: Iterable[Pattern],
    lowered: str | None = None,
    odd: str | None = None,
    unicode: bool = True,
) -> str:
    """All matches of all patterns as ``ARRAY<MATCH_TYPE>``, ordered by start, ties in catalog order.

    ``lowered`` is the lower-cased text and ``odd`` the result of ``odd_letters``, if the caller has them as
    columns already.
    """
    patterns = tuple(patterns)
    if not patterns:
        return f"if({text} IS NULL, NULL, {array([], MATCH_TYPE)})"
    labels = array(
        struct(type=lit(p.type), name=lit(p.name), severity=lit(p.severity), luhn=lit(p.validator == "luhn"))
        for p in patterns
    )
    lowered = f"lower({text})" if lowered is None else lowered
    tests = LiteralTests((h for p in patterns for h in p.hints), lowered, "t")
    # Marked texts of the patterns that occur; other patterns take none of the marking and splitting.
    marked = array(
        struct(ordinal=lit(i), marked=_marked(p, tests, unicode)) for i, p in enumerate(patterns)
    )
    shared = struct(
        text=text,
        lowered=lowered,
        odd=odd_letters(text) if odd is None else odd,
        digits=digit_run(text, unicode),
        **tests.fields,
    )
    occurring = let("t", shared, f"filter({marked}, m -> m.marked IS NOT NULL)")
    # The sort key (start, ordinal) leads.
    spans = (
        f"flatten(transform({occurring}, m -> transform({marked_spans('m.marked')}, "
        "s -> struct(s.start AS start, m.ordinal AS ordinal, s.end AS end, s.value AS value))))"
    )
    if any(p.validator == "luhn" for p in patterns):
        spans = f"filter({spans}, s -> NOT get({labels}, s.ordinal).luhn OR {luhn_valid('s.value')})"
    label = f"get({labels}, s.ordinal)"
    match = struct(
        type=f"{label}.type",
        name=f"{label}.name",
        value="s.value",
        start="s.start",
        end="s.end",
        severity=f"{label}.severity",
        confidence=lit(1.0),
    )
    return f"if({text} IS NULL, NULL, transform(array_sort({spans}), s -> {match}))"


def _marked(pattern: Pattern, literals: LiteralTests, unicode: bool) -> str:
    regex = pattern.regex(unicode)
    tests = [f"rlike(t.text, {lit(regex)})"]
    if pattern.digits:
        tests.insert(0, "t.digits")
    tests.insert(0, literals.may_match(pattern.hints))
    return f"if({' AND '.join(tests)}, {mark_matches('t.text', regex, pattern.value_group)}, NULL)"


def redact_pii(text: str, matches: str, style: str = STYLE_DEFAULT, overlap: str = "merge") -> str:
    """Replace the matches in ``text``.

    ``[REDACTED-TYPE]`` names what was found, ``[REDACTED-XXX]`` keeps the length, any other style is inserted
    as it is.
    """
    if overlap == "merge":
        redacted = _redact_merged(text, matches, style)
    elif overlap == "splice":
        redacted = _redact_spliced(text, matches, style)
    else:
        raise ValueError(f"overlap must be 'merge' or 'splice', not {overlap!r}")
    return f"if(size({matches}) > 0, {redacted}, {text})"


def _replacement(style: str, name: str, length: str) -> str:
    if style == STYLE_TYPE:
        return f"concat('[REDACTED-', upper({name}), ']')"
    if style == STYLE_XXX:
        return f"concat('[', repeat('X', greatest({length} - 2, 0)), ']')"
    return lit(style)


def _redact_spliced(text: str, matches: str, style: str) -> str:
    # From right to left with the offsets of the original text, also where spans overlap.
    backwards = (
        f"array_sort(transform({matches}, (m, i) -> "
        "struct(-m.start AS back, i AS i, m.start AS start, m.end AS end, m.name AS name)))"
    )
    replacement = _replacement(style, "m.name", "m.end - m.start")
    return (
        f"aggregate({backwards}, {text}, (acc, m) -> "
        f"concat(substr(acc, 1, m.start), {replacement}, substr(acc, m.end + 1)))"
    )


def _redact_merged(text: str, matches: str, style: str) -> str:
    # Earliest first and longest first among equals, so the first span of a run of overlaps lends its name.
    ordered = (
        f"array_sort(transform({matches}, (m, i) -> "
        "struct(m.start AS start, -m.end AS back, i AS i, m.end AS end, m.name AS name)))"
    )
    # A run of overlaps begins where nothing before it reaches, and ends where the text was covered when the
    # next run began.
    runs = (
        f"filter(zip_with(ms, {running_max('transform(ms, m -> m.end)')}, "
        "(m, covered) -> struct(m.start AS start, m.name AS name, covered AS covered)), r -> r.start >= r.covered)"
    )
    end = "coalesce(get(rs, k + 1).covered, last)"
    piece = (
        f"concat(substr({text}, r.covered + 1, r.start - r.covered), {_replacement(style, 'r.name', f'{end} - r.start')})"
    )
    rebuilt = f"concat(array_join(transform(rs, (r, k) -> {piece}), ''), substr({text}, last + 1))"
    return let(
        "ms", ordered, let("last", "array_max(transform(ms, m -> m.end))", let("rs", runs, rebuilt))
    )


def pii_types(matches: str) -> str:
    """Distinct pattern types, sorted."""
    return f"array_sort(array_distinct(transform({matches}, m -> m.type)))"


def count_map(keys: str) -> str:
    """``MAP<STRING, INT>`` of the occurrences of each string in an array."""
    return f"map_from_entries(transform(array_distinct({keys}), k -> struct(k, size(filter({keys}, x -> x = k)))))"


def field_counts(items: str, field: str, values: Iterable[str]) -> str:
    """Struct with the number of structs that have each of ``values`` in ``field``."""
    return struct(**{v: f"size(filter({items}, x -> x.{field} = {lit(v)}))" for v in values})


def pii_summary(matches: str) -> str:
    """Total, counts by type and severity, and the distinct names found in one text."""
    return struct(
        total_count=f"size({matches})",
        by_type=count_map(f"transform({matches}, m -> m.type)"),
        by_severity=field_counts(matches, "severity", SEVERITIES),
        unique_types=f"array_sort(array_distinct(transform({matches}, m -> m.name)))",
    )
