"""Options of a scan, passed to operators instead of a mutable settings store."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScanConfig:
    pii_detection_enabled: bool = True
    policy_enforcement_enabled: bool = True
    audit_logging_enabled: bool = True
    auto_redact: bool = True
    extended_patterns: bool = False
    extended_policies: bool = False
    redaction_style: str = "[REDACTED]"
    # Longer texts are rejected: kept and logged, but not scanned. None takes texts of any length.
    max_prompt_length: int | None = None
    rate_limit_enabled: bool = False
    max_per_minute: int = 60
    # "merge" joins overlapping spans before they are replaced; "splice" replaces every span on its own,
    # right to left, which garbles text where spans overlap.
    overlap: str = "merge"
    # False restricts \b, \d, \s and case folding to ASCII.
    unicode_regex: bool = True
    # True matches policy keywords as whole words instead of substrings.
    whole_word: bool = False

    def __post_init__(self) -> None:
        if self.overlap not in ("merge", "splice"):
            raise ValueError(f"overlap must be 'merge' or 'splice', not {self.overlap!r}")
        if self.max_prompt_length is not None and self.max_prompt_length < 0:
            raise ValueError("max_prompt_length must not be negative")
