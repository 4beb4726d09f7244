"""Writing expressions as SQL text.

The functions of this package take and return SQL expression text. The expressions are large (a test per
keyword and pattern); as text they reach the JVM in one piece instead of one call per node.
"""

from __future__ import annotations

from collections.abc import Iterable


def lit(value: str | int | float | bool) -> str:
    """A SQL literal."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    quoted = value.replace("\\", "\\\\").replace("'", "\\'")
    # Spark would take ${...} for a configuration variable, in literals too.
    return "'" + quoted.replace("${", "\\u0024{") + "'"


def ident(name: str) -> str:
    """A column name as an expression."""
    return "`" + name.replace("`", "``") + "`"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"{lit(k)}, {v}" for k, v in fields.items()) + ")"


def array(items: Iterable[str], of: str | None = None) -> str:
    text = f"array({', '.join(items)})"
    return text if of is None else f"CAST({text} AS array<{of}>)"


def let(variable: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it in ``body`` any number of times by the name ``variable``."""
    return f"element_at(transform(array({value}), {variable} -> {body}), 1)"


def lookup(key: str, table: dict, other) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {key} {cases} ELSE {lit(other)} END"
