"""Small text functions."""

from __future__ import annotations

from textwarden.functions.sql import lit


def luhn_valid(number: str) -> str:
    """Luhn check of a number written with optional dashes and blanks; anything else is false."""
    digits = f"regexp_replace({number}, {lit(r'(?U)[-\s]')}, '')"
    return f"if({digits} = '', false, luhn_check({digits}))"


def truncate_text(text: str, max_length: int = 100) -> str:
    """Cut texts longer than ``max_length`` code points and end them with ``...``."""
    return f"if(length({text}) > {max_length}, concat({_head(text, max_length - 3)}, '...'), {text})"


def sanitize_for_logging(text: str, max_length: int = 500) -> str:
    """Drop control characters below blank except newline, return and tab, then cut."""
    clean = f"regexp_replace({text}, {lit(r'[\x00-\x08\x0B\x0C\x0E-\x1F]')}, '')"
    return f"if(length({clean}) > {max_length}, concat({_head(clean, max_length)}, '... [truncated]'), {clean})"


def _head(text: str, n: int) -> str:
    # A negative count leaves off that many code points at the end, as a slice does.
    return f"substring({text}, 1, {n})" if n >= 0 else f"substring({text}, 1, greatest(length({text}) - {-n}, 0))"
