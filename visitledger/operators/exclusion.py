"""Exclusion with SQL's NULL rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitledger.sources.staging import stage


def drop_excluded(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """SQL `column NOT IN (values)`: listed values go, and so do NULLs."""
    return df.where(~F.col(column).isin(*values))


def null_aware_anti(
    left: DataFrame,
    right: DataFrame,
    left_key: Column | str,
    right_key: Column | str,
) -> DataFrame:
    """SQL `left_key NOT IN (SELECT right_key FROM right)`, without a broadcast.

    Spark's own plan for NOT IN broadcasts the right side whatever its size. Here
    the distinct right keys, a NULL among them, are staged, so that `right` is
    read once; the NULL rules come from one scalar over them:

    - right empty: every left row stays, also with a NULL key;
    - right holds a NULL: nothing stays;
    - otherwise rows with a NULL left key go, before they reach the shuffle.
    """
    probe = F.col(left_key) if isinstance(left_key, str) else left_key
    member = F.col(right_key) if isinstance(right_key, str) else right_key
    keys = stage(right.select(member.alias("__member")).distinct(), "excluded")
    state = exclusion_state(keys.select(F.col("__member").isNull().alias("missing")))
    kept = left.where(
        (state == "empty") | ((state == "keys") & probe.isNotNull())
    ).withColumn("__probe", probe)
    on = F.col("__probe") == F.col("__member")
    return kept.join(keys.where(F.col("__member").isNotNull()), on, "left_anti").drop("__probe")


def exclusion_state(members: DataFrame) -> Column:
    """"empty", "null" or "keys": what NOT IN over `members` (missing boolean) comes to."""
    return members.agg(
        F.when(F.count(F.lit(1)) == 0, "empty")
        .when(F.count_if("missing") > 0, "null")
        .otherwise("keys")
        .alias("state")
    ).scalar()
