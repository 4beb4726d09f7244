"""What a Python worker keeps from task to task: one operator's words at a time."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_held: tuple[Any, Any] | None = None


def remembered(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gave for this key, if it was the last one asked for; else it is made anew and the other let go.

    A worker that is used again by another operator does not hold the memory of both.
    """
    global _held
    if _held is None or _held[0] != key:
        _held = None
        _held = key, make()
    return _held[1]
