"""A hint that does not hold would hide matches."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textwarden.functions.hints import DIGIT_RUN, FOLDING_LETTERS
from textwarden.sources.catalogs import BUILTIN_PATTERNS, BUILTIN_POLICIES

quick = settings(max_examples=100, deadline=None, suppress_health_check=list(HealthCheck))


def holds(text, hints):
    return not hints or any(h in text.lower() for h in hints) or any(c in text for c in FOLDING_LETTERS)


@pytest.mark.parametrize("pattern", BUILTIN_PATTERNS, ids=lambda p: p.type)
@quick
@given(data=st.data())
def test_patterns(pattern, data):
    regex = re.compile(pattern.pattern, re.IGNORECASE)
    text = data.draw(st.from_regex(regex))
    match = regex.search(text)
    assert holds(match.group(), pattern.hints)
    if pattern.digits:
        assert re.search(DIGIT_RUN, match.group())
    if pattern.first:
        assert re.match(pattern.first, match.group(), re.IGNORECASE)


RULES = [(regex, hints) for p in BUILTIN_POLICIES for regex, hints in zip(p.regex_patterns, p.regex_hints)]


def test_every_builtin_regex_has_hints():
    assert all(len(p.regex_patterns) == len(p.regex_hints) for p in BUILTIN_POLICIES)


@pytest.mark.parametrize("regex,hints", RULES, ids=[r for r, _ in RULES])
@quick
@given(data=st.data())
def test_policies(regex, hints, data):
    compiled = re.compile(regex, re.IGNORECASE)
    assert holds(compiled.search(data.draw(st.from_regex(compiled))).group(), hints)
