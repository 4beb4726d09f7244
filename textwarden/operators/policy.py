"""Policy checks over whole tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.config import ScanConfig
from textwarden.functions import policy
from textwarden.functions.sql import ident
from textwarden.sources.catalogs import Policy, active_policies


def with_violations(
    df: DataFrame,
    text_col: str = "text",
    config: ScanConfig = ScanConfig(),
    custom: Iterable[Policy] = (),
    out: str = "violations",
) -> DataFrame:
    """Add the array of policy violations of ``text_col``."""
    policies = active_policies(config.extended_policies, custom)
    checked = policy.check_policies(
        ident(text_col), policies, unicode=config.unicode_regex, whole_word=config.whole_word
    )
    return df.withColumn(out, F.expr(checked))


def violation_rows(df: DataFrame, keys: Sequence[str], violations_col: str = "violations") -> DataFrame:
    """One row per violation, with the keys of its text."""
    return df.select(*keys, F.inline_outer(violations_col)).filter(F.col("policy_name").isNotNull())


def policy_totals(df: DataFrame, violations_col: str = "violations", by: Sequence[str] = ()) -> DataFrame:
    """Violations per category, action and severity; a policy occurs at most once per text."""
    return (
        violation_rows(df, by, violations_col)
        .groupBy(*by, "category", "action", "severity")
        .agg(F.count(F.lit(1)).alias("violations"))
    )


def policy_rollup(df: DataFrame, violations_col: str = "violations") -> DataFrame:
    """Violations per policy, per category and in total."""
    return (
        violation_rows(df, [], violations_col)
        .rollup("category", "policy_name")
        .agg(F.count(F.lit(1)).alias("violations"))
    )


def with_policy_actions(
    df: DataFrame,
    text_col: str = "text",
    violations_col: str = "violations",
    config: ScanConfig = ScanConfig(),
    custom: Iterable[Policy] = (),
    out: str = "applied",
) -> DataFrame:
    """Add the outcome of carrying out the violations' actions; ``config`` and ``custom`` are those of the check."""
    policies = active_policies(config.extended_policies, custom)
    applied = policy.apply_policy_actions(ident(text_col), ident(violations_col), policies, config.unicode_regex)
    return df.withColumn(out, F.expr(applied))
