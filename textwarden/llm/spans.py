"""Spans of several kinds in one array per text, and how they are written down."""

from __future__ import annotations

from collections.abc import Sequence

from textwarden.functions.spans import find_spans
from textwarden.functions.sql import array, lit

SPAN_TYPE = "array<struct<start:int,kind:int,end:int>>"
NO_SPANS = f"CAST(array() AS {SPAN_TYPE})"


def spans_of(text: str, regex: str, kind: int, when: str = "true", group: int = 0, keep: str = "true") -> str:
    """Spans of a Java regex, for the texts that meet ``when`` and have a match at all; others pay for no marking.

    ``keep`` is a condition on a span ``s`` with ``s.value`` the capture group.
    """
    found = f"filter({find_spans(text, regex, group)}, s -> {keep})"
    made = f"transform({found}, s -> struct(s.start AS start, {kind} AS kind, s.end AS end))"
    return f"if({when} AND rlike({text}, {lit(regex)}), {made}, {NO_SPANS})"


def in_order(spans: Sequence[str]) -> str:
    """One array, by start, then in the order of the kinds."""
    return f"array_sort(concat({', '.join(spans)}))" if len(spans) > 1 else f"array_sort({spans[0]})"


def written(spans: str, kinds: Sequence[str]) -> str:
    """``kind:start:end``, comma-joined."""
    name = f"get({array(map(lit, kinds))}, s.kind)"
    return f"array_join(transform({spans}, s -> concat_ws(':', {name}, s.start, s.end)), ',')"


def how_many(spans: str, kind: int) -> str:
    return f"CAST(size(filter({spans}, s -> s.kind = {kind})) AS long)"
