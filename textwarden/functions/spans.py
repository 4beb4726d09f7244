"""Positions of all regex matches as a native array expression.

Spark can replace, extract and count matches but not say where they are. Here every match is wrapped in marker
characters by ``regexp_replace``; splitting at the opening marker gives one piece per match, whose lengths add
up to the start offsets. All of it runs in the JVM.
"""

from __future__ import annotations

from textwarden.functions.arrays import running_sum
from textwarden.functions.sql import let, lit

# Noncharacters: never valid in interchanged text. Texts that hold them all the same see U+FFFD in values.
OPEN, GROUP, CLOSE = "\ufdd0", "\ufdd2", "\ufdd1"


def mark_matches(text: str, regex: str, group: int = 0) -> str:
    """``text`` with every match of a Java regex wrapped as OPEN match GROUP value CLOSE."""
    clean = f"translate({text}, {lit(OPEN + GROUP + CLOSE)}, {lit(chr(0xFFFD) * 3)})"
    return f"regexp_replace({clean}, {lit(regex)}, {lit(f'{OPEN}$0{GROUP}${group}{CLOSE}')})"


def marked_spans(marked: str) -> str:
    """``ARRAY<STRUCT<start, end, value>>`` of the matches in a marked text, leftmost first.

    Offsets count code points of the unmarked text from 0, ``end`` is exclusive and covers the whole match.
    """
    # Piece 0 is the text before the first match; the others are: match, value, rest up to the next match.
    head = f"substring_index(p, {lit(CLOSE)}, 1)"
    match = f"length(substring_index({head}, {lit(GROUP)}, 1))"
    piece = (
        f"struct(if(i = 0, length(p), length(p) - length({head}) - 1 + {match}) AS width, "
        f"if(i = 0, 0, {match}) AS matched, substr({head}, {match} + 2) AS value)"
    )
    spans = (
        f"zip_with(ps, {running_sum('transform(ps, p -> p.width)')}, "
        "(p, s) -> struct(s AS start, s + p.matched AS end, p.value AS value))"
    )
    pieces = f"transform(split({marked}, {lit(OPEN)}, -1), (p, i) -> {piece})"
    return let("ps", pieces, f"slice({spans}, 2, size(ps))")


def find_spans(text: str, regex: str, group: int = 0) -> str:
    """Spans of all non-overlapping matches of a Java regex; ``value`` is capture group ``group`` (0: all)."""
    return marked_spans(mark_matches(text, regex, group))
