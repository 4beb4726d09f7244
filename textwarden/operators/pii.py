"""Personal data over whole tables. Everything up to the totals is row-wise: no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.config import ScanConfig
from textwarden.functions import pii
from textwarden.functions.sql import ident, lit
from textwarden.sources.catalogs import Pattern, active_patterns

SEPARATOR = "\x1f"


def with_matches(
    df: DataFrame,
    text_col: str = "text",
    config: ScanConfig = ScanConfig(),
    custom: Iterable[Pattern] = (),
    out: str = "matches",
) -> DataFrame:
    """Add the array of matches found in ``text_col``."""
    patterns = active_patterns(config.extended_patterns, custom)
    return df.withColumn(out, F.expr(pii.detect_pii(ident(text_col), patterns, unicode=config.unicode_regex)))


def match_rows(df: DataFrame, keys: Sequence[str], matches_col: str = "matches") -> DataFrame:
    """One row per match, with the keys of the text it was found in."""
    # The outer form keeps the optimizer from filtering on the array first, which would detect twice.
    return df.select(*keys, F.inline_outer(matches_col)).filter(F.col("type").isNotNull())


def redact_table(
    df: DataFrame,
    text_col: str = "text",
    config: ScanConfig = ScanConfig(),
    custom: Iterable[Pattern] = (),
    style: str | None = None,
) -> DataFrame:
    """Add ``redacted``, ``pii_found`` and ``pii_types`` to each row."""
    found = with_matches(df, text_col, config, custom, "_matches")
    style = config.redaction_style if style is None else style
    return found.withColumns(
        {
            "redacted": F.expr(pii.redact_pii(ident(text_col), "_matches", style, config.overlap)),
            "pii_found": F.coalesce(F.array_size("_matches"), F.lit(0)),
            "pii_types": F.expr(pii.pii_types("_matches")),
        }
    ).drop("_matches")


def pii_totals(df: DataFrame, matches_col: str = "matches", by: Sequence[str] = ()) -> DataFrame:
    """Matches, and texts with at least one, per pattern type and ``by``.

    Each text is counted down to one row per type before the shuffle, so texts need no distinct count.
    """
    labels = f"transform({ident(matches_col)}, m -> concat_ws({lit(SEPARATOR)}, m.type, m.severity))"
    per_text = (
        f"transform(map_entries({pii.count_map(labels)}), e -> "
        f"struct(substring_index(e.key, {lit(SEPARATOR)}, 1) AS type, "
        f"substring_index(e.key, {lit(SEPARATOR)}, -1) AS severity, e.value AS n))"
    )
    return (
        df.select(*by, F.inline_outer(F.expr(per_text)))
        .filter(F.col("type").isNotNull())
        .groupBy(*by, "type", "severity")
        .agg(F.sum("n").alias("matches"), F.count(F.lit(1)).alias("texts"))
    )


def pii_cube(df: DataFrame, dimension: str, matches_col: str = "matches") -> DataFrame:
    """Totals for each dimension value and type, and over all of either (null)."""
    return (
        pii_totals(df, matches_col, [dimension])
        .cube(dimension, "type")
        .agg(F.sum("matches").alias("matches"))
    )
