"""Cheap tests that spare most texts the regexes.

A hint is a lower-case literal without which a regex cannot match. Looking for literals in bytes costs a small
part of a regex search, and most texts have none of them.
"""

from __future__ import annotations

from collections.abc import Iterable

from textwarden.functions.sql import lit

# These letters equal ASCII letters when a regex ignores case, but lower() does not turn them into those.
FOLDING_LETTERS = ("\u0130", "\u0131", "\u017f", "\u212a")

# Every built-in pattern about numbers needs three digits in a row or two digits around a dot.
DIGIT_RUN = r"\d(?:\d\d|\.\d)"

MIN_WORD = 4


class LiteralTests:
    """Tests for many literals in one text, in as few passes over it as they share parts.

    ``fields`` are computed once per text: for each part that several literals have in common, such as a word,
    whether it occurs. A literal is only looked for where its part occurs.
    """

    def __init__(self, literals: Iterable[str], lowered: str, scope: str):
        self.lowered = lowered
        self.scope = scope
        self.parts = common_parts(literals)
        self.fields = {f"part{i}": f"contains({lowered}, {lit(p)})" for i, p in enumerate(self.parts)}

    def contains(self, literal: str) -> str:
        test = f"contains({self.scope}.lowered, {lit(literal)})"
        for i, part in enumerate(self.parts):
            if part == literal:
                return f"{self.scope}.part{i}"
            if part in literal:
                return f"({self.scope}.part{i} AND {test})"
        return test

    def may_match(self, hints: tuple[str, ...]) -> str:
        """Condition under which a regex with these hints can match at all."""
        if not hints:
            return "true"
        tests = [self.contains(h) for h in hints]
        if any(ch.isalpha() for hint in hints for ch in hint):
            tests.append(f"{self.scope}.odd")
        return f"({' OR '.join(tests)})"


def common_parts(literals: Iterable[str]) -> list[str]:
    """Words or literals that occur in two or more of the literals, the most frequent first."""
    left = set(literals)
    candidates = left | {word for text in left for word in text.split() if len(word) >= MIN_WORD}
    parts = []
    while candidates:
        best = max(sorted(candidates), key=lambda c: (sum(c in text for text in left), len(c)))
        covered = {text for text in left if best in text}
        if len(covered) < 2:
            break
        parts.append(best)
        left -= covered
    return parts


def odd_letters(text: str) -> str:
    """Whether hints about letters cannot be trusted for this text."""
    return "(" + " OR ".join(f"contains({text}, {lit(x)})" for x in FOLDING_LETTERS) + ")"


def digit_run(text: str, unicode: bool = True) -> str:
    return f"rlike({text}, {lit(('(?U)' if unicode else '') + DIGIT_RUN)})"
