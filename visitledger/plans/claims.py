"""Claims: which of them count, and which visit days each one takes."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitledger import constants as k
from visitledger.functions import money_sum
from visitledger.operators import (
    as_of,
    drop_excluded,
    first_per_key,
    latest_per_key,
    null_aware_anti,
    spans_without_points,
)
from visitledger.operators.intervals import cover_days, cover_days_or_none, distinct_points, point_rows
from visitledger.plans.visits import insurance_lookup
from visitledger.sources.staging import stage

CLAIM_COLUMNS = (
    "unique_claim_id",
    "updated_at",
    "billed_date",
    "patient_name",
    "mrn",
    "claim_number",
    "claim_status",
    "billing_period_start_date",
    "billing_period_end_date",
    "tob",
    "insurance",
    "payer_type",
    "branch",
    "medicare_subscriber_number",
    "anticipated_payment",
    "agency",
)
CLAIM_EQ = [("mrn", "mrn"), ("agency", "agency")]
PERIOD = {"lo": "billing_period_start_date", "hi": "billing_period_end_date"}


def standing_claims(claims: DataFrame, day: date) -> DataFrame:
    """All versions of the claims known before `day` that were not voided."""
    return drop_excluded(
        as_of(claims, "updated_at", day), "claim_status", k.VOID_CLAIM_STATUSES
    )


def drop_advance_claims(claims: DataFrame) -> DataFrame:
    """Leave out zero-payment one-day advance claims and all rows like them.

    Whatever shares id and payment with such a row goes, under any type of bill.
    The pair counts as NULL if either part is, with SQL's NOT IN rules on top.
    """
    advance = claims.where(
        (F.col("tob") == k.ADVANCE_TYPE_OF_BILL)
        & (F.col("billing_period_start_date") == F.col("billing_period_end_date"))
        & (F.col("anticipated_payment") == 0)
    )
    ident, paid = F.col("unique_claim_id"), F.col("anticipated_payment")
    pair = F.when(ident.isNotNull() & paid.isNotNull(), F.struct(ident, paid))
    return null_aware_anti(claims, advance, pair, pair)


#: Claims of one patient and agency that meet in one task at most.
CROWD = 10_000


def allocate_first_claim(claims: DataFrame, revenue: DataFrame) -> DataFrame:
    """Give each patient day to the first claim over it; sum what claims expect.

    First means earliest billed, then newest version. A day brings the revenue
    of one visit, the one with the lowest id; the sums do not depend on the order. Claims that cover visit days but
    win none disappear; claims that cover none stay, with NULL. Versions of one
    claim compete like strangers; equal rows are one. Both tables are read more
    than once: stage them first.

    The claims of a patient and agency move once, to one task, which finds the
    days they win and those that cover none. Where they are more than CROWD, they
    are thinned and spread instead, at the price of moving them several times.
    """
    credit = revenue.select("mrn", "agency", "visit_date", "unique_id", "revenue")
    worth = first_per_key(
        point_rows(credit, CLAIM_EQ, "visit_date", ["unique_id", "revenue"]),
        ["__k0", "__k1", "__at"],
        [F.col("unique_id").asc_nulls_first(), F.col("revenue").asc_nulls_first()],
    ).drop("unique_id")

    def summed(won: DataFrame) -> DataFrame:
        # Spark leaves this join out where the sums are not asked for
        named = won.join(worth, ["__k0", "__k1", "__at"], "left").withColumnsRenamed({"__k0": "mrn", "__k1": "agency"})
        return named.groupBy(*CLAIM_COLUMNS).agg(money_sum("revenue").alias("expected_revenue"))

    return _allocated(claims, distinct_points(credit, CLAIM_EQ, "visit_date"), credit, summed)


def surviving_claims(claims: DataFrame, days: DataFrame) -> DataFrame:
    """The claims of `allocate_first_claim`, without what they expect, from the distinct patient days alone.

    `days` has mrn, agency and visit_date, no NULL among them.
    """

    def named(won: DataFrame) -> DataFrame:
        return won.withColumnsRenamed({"__k0": "mrn", "__k1": "agency"}).select(*CLAIM_COLUMNS).distinct()

    found = _allocated(claims, point_rows(days, CLAIM_EQ, "visit_date", []), days, named)
    return found.select(*CLAIM_COLUMNS)


def _allocated(
    claims: DataFrame, days: DataFrame, points: DataFrame, summed: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Claims that win one of the distinct `days` of `points`, summed up, and those that cover none."""
    typed = claims.select(*CLAIM_COLUMNS).withColumns(
        {c: F.col(c).cast("date") for c in PERIOD.values()}
    )
    take = [c for c in CLAIM_COLUMNS if c not in ("mrn", "agency")]
    rest = [c for c in take if c not in ("billed_date", "updated_at")]
    order = [F.col("billed_date").asc_nulls_first(), F.col("updated_at").desc_nulls_last()]
    order += [F.col(c).asc_nulls_first() for c in rest]

    def idle(rows: DataFrame) -> DataFrame:
        return rows.distinct().withColumn("expected_revenue", F.lit(None).cast("double"))

    lo, hi = (F.col(c) for c in PERIOD.values())
    fits = F.col("mrn").isNotNull() & F.col("agency").isNotNull() & F.coalesce(lo <= hi, F.lit(False))
    key = [c for c, _ in CLAIM_EQ]
    crowds = typed.where(fits).groupBy(*key).count().where(F.col("count") > CROWD).select(*key)
    few, crowded = typed, []
    if not crowds.isEmpty():
        crowds = stage(crowds, "crowded_patients")
        few, many = typed.join(crowds, key, "left_anti"), typed.join(crowds, key, "left_semi")
        won = cover_days(days, many, CLAIM_EQ, order=order, take=take, **PERIOD)
        crowded = [summed(won), idle(spans_without_points(many, points, CLAIM_EQ, "visit_date", **PERIOD))]
    found = summed(cover_days_or_none(days, few, CLAIM_EQ, order=order, take=take, **PERIOD))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [found, idle(few.where(~fits)), *crowded])


def latest_claims(allocated: DataFrame) -> DataFrame:
    """The newest surviving version of every claim."""
    rest = [c for c in CLAIM_COLUMNS if c not in ("unique_claim_id", "updated_at")]
    return latest_per_key(allocated, ["unique_claim_id"], "updated_at", rest)


def map_claims(claims: DataFrame, insurance_map: DataFrame) -> DataFrame:
    """Attach the payer's parent and type to claims."""
    payers = insurance_lookup(insurance_map).drop("payment_model", "payment_multiplier")
    return claims.join(payers, ["insurance", "agency"], "left")
