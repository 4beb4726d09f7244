"""Running folds over arrays, which Spark's higher-order functions lack."""

from __future__ import annotations

from textwarden.functions.sql import let

# The folds work on chunks of this many elements, so that appending to an array stays cheap for texts with
# very many matches.
CHUNK = 512


def running_sum(values: str) -> str:
    """For each element of a non-empty ``ARRAY<INT>`` the sum of the elements before it."""
    return _running(values, "{a} + {b}")


def running_max(values: str) -> str:
    """For each element of a non-empty array of non-negative ``INT`` the greatest element before it, or 0."""
    return _running(values, "greatest({a}, {b})")


def _running(values: str, op: str) -> str:
    def scan(items: str) -> str:
        total = op.format(a="acc.total", b="item")
        return (
            f"aggregate({items}, struct(0 AS total, CAST(array() AS array<int>) AS before), (acc, item) -> "
            f"struct({total} AS total, concat(acc.before, array(acc.total)) AS before))"
        )

    chunks = f"transform(sequence(1, size(arr), {CHUNK}), first -> {scan(f'slice(arr, first, {CHUNK})')})"
    joined = (
        f"flatten(zip_with(chunks, {scan('transform(chunks, c -> c.total)')}.before, "
        f"(chunk, base) -> transform(chunk.before, v -> {op.format(a='base', b='v')})))"
    )
    return let("arr", values, let("chunks", chunks, joined))
