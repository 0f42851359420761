from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tests.frames import at, day, explained, frame, rows
from visitledger.plans import claims as steps
from visitledger.plans.claims import (
    allocate_first_claim,
    drop_advance_claims,
    latest_claims,
    map_claims,
    standing_claims,
)
from visitledger.plans.report import billed_visits, paid_periods
from visitledger.sources import schemas


def claim(ident, billed="2024-02-10", start="2024-01-01", end="2024-01-30", version="2024-02-11", **more):
    base = {
        "unique_claim_id": ident,
        "mrn": "1",
        "agency": "N",
        "claim_status": "Paid",
        "tob": "329",
        "billed_date": day(billed),
        "billing_period_start_date": day(start),
        "billing_period_end_date": day(end),
        "anticipated_payment": 100.0,
        "updated_at": at(f"{version} 00:00:00"),
    }
    return base | more


def claims(spark, *found):
    return frame(spark, schemas.CLAIMS, list(found))


def revenue(spark, *found):
    columns = "unique_id string, mrn string, agency string, visit_date date, revenue double"
    base = {"mrn": "1", "agency": "N"}
    return frame(
        spark,
        columns,
        [base | {"unique_id": u, "visit_date": day(d), "revenue": r} for u, d, r in found],
    )


def test_void_and_unknown_status_go(spark):
    found = claims(spark, claim("a"), claim("b", claim_status="Void"), claim("c", claim_status=None))
    assert rows(standing_claims(found, date(2024, 3, 1)), "unique_claim_id") == [("a",)]
    assert rows(standing_claims(found, date(2024, 2, 11)), "unique_claim_id") == []


def advance(ident, **more):
    return claim(ident, tob="322", end="2024-01-01", anticipated_payment=0.0, **more)


def test_advance_claims_take_their_like_along(spark):
    found = claims(
        spark,
        advance("a"),
        claim("a", anticipated_payment=0.0),  # same id and payment, other type of bill
        claim("a"),
        claim("b"),
        claim(None),
        claim("c", anticipated_payment=None),
    )
    got = rows(drop_advance_claims(found), "unique_claim_id", "anticipated_payment")
    assert got == [("a", 100.0), ("b", 100.0)]


def test_without_advance_claims_nulls_stay(spark):
    found = claims(spark, claim("a"), claim(None), claim("c", anticipated_payment=None))
    assert drop_advance_claims(found).count() == 3


def test_advance_claim_without_id_empties_all(spark):
    assert drop_advance_claims(claims(spark, claim("a"), advance(None))).count() == 0


def test_first_billed_claim_takes_the_day(spark):
    found = claims(
        spark,
        claim("first", billed="2024-02-01"),
        claim("second", billed="2024-02-02"),
        claim("later period", start="2024-01-20", end="2024-02-20", billed="2024-03-01"),
        claim("no visits", start="2023-01-01", end="2023-01-30"),
        claim("other patient", mrn="2"),
        claim("no patient", mrn=None),
    )
    visits = revenue(spark, ("v1", "2024-01-05", 10.0), ("v2", "2024-01-06", 20.0), ("v3", "2024-02-01", 7.0))
    got = rows(allocate_first_claim(found, visits), "unique_claim_id", "expected_revenue")
    # "second" covers visit days but wins none: it disappears.
    assert got == [
        ("first", 30.0),
        ("later period", 7.0),
        ("no patient", None),
        ("no visits", None),
        ("other patient", None),
    ]


def test_ties_go_to_the_newest_version(spark):
    found = claims(
        spark,
        claim("a", version="2024-02-11", claim_number="old"),
        claim("a", version="2024-02-12", claim_number="new"),
        claim("b", version="2024-02-12", claim_number="zz"),
    )
    got = allocate_first_claim(found, revenue(spark, ("v", "2024-01-05", 10.0)))
    assert rows(got, "claim_number", "expected_revenue") == [("new", 10.0)]


def test_null_billed_date_comes_first(spark):
    found = claims(spark, claim("a", billed="2020-01-01"), claim("b", billed=None))
    got = allocate_first_claim(found, revenue(spark, ("v", "2024-01-05", 10.0)))
    assert rows(got, "unique_claim_id") == [("b",)]


def test_one_visit_a_day_is_credited(spark):
    visits = revenue(spark, ("v2", "2024-01-05", 10.0), ("v1", "2024-01-05", 3.0), ("v9", "2024-01-06", None))
    got = allocate_first_claim(claims(spark, claim("a")), visits)
    assert rows(got, "expected_revenue") == [(3.0,)]


def test_equal_claim_rows_are_one(spark):
    found = claims(spark, claim("a"), claim("a"), claim("n", mrn="2"), claim("n", mrn="2"))
    got = allocate_first_claim(found, revenue(spark, ("v", "2024-01-05", 10.0)))
    assert rows(got, "unique_claim_id", "expected_revenue") == [("a", 10.0), ("n", None)]


def test_a_stale_version_can_win_and_then_be_dropped(spark):
    """The older version takes the day, the newer one covers no visit and stays.

    The newest version is kept afterwards, so the day stays open.
    """
    found = claims(
        spark,
        claim("a", version="2024-02-11"),
        claim("a", version="2024-02-20", start="2023-01-01", end="2023-01-30"),
    )
    visits = revenue(spark, ("v", "2024-01-05", 10.0))
    counted = latest_claims(allocate_first_claim(found, visits))
    assert rows(counted, "billing_period_start_date") == [(day("2023-01-01"),)]
    assert billed_visits(visits, paid_periods(counted)).count() == 0


def test_unpaid_winner_leaves_the_day_open(spark):
    found = claims(
        spark,
        claim("unpaid", billed="2024-02-01", anticipated_payment=None),
        claim("paid", billed="2024-02-02"),
    )
    visits = revenue(spark, ("v", "2024-01-05", 10.0))
    counted = latest_claims(allocate_first_claim(found, visits))
    assert rows(counted, "unique_claim_id") == [("unpaid",)]
    assert billed_visits(visits, paid_periods(counted)).count() == 0


def test_claims_get_their_payer_once(spark):
    payers = [
        {"insurance": "M", "office": "N", "parent_insurance": p, "insurance_type": "t"} for p in "ba"
    ]
    got = map_claims(claims(spark, claim("a", insurance="M"), claim("b")), frame(spark, schemas.INSURANCE_MAP, payers))
    assert rows(got, "unique_claim_id", "parent_insurance") == [("a", "a"), ("b", None)]


def test_sums_do_not_depend_on_the_order(spark):
    """Amounts that doubles add up differently in every order."""
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(30)]
    amounts = [0.1, 1e11, 0.2, -1e11, 0.3, 1 / 3, 2 / 3] * 5
    visits = [(f"v{i}", d.isoformat(), amounts[i]) for i, d in enumerate(days)]
    found = set()
    for seed in range(5):
        made = revenue(spark, *visits).orderBy(F.rand(seed)).repartition(seed + 1)
        found.add(allocate_first_claim(claims(spark, claim("a")), made).first()["expected_revenue"])
    assert found == {sum(Decimal(str(round(amounts[i], 6))) for i in range(30)).__float__()}


def test_claims_move_once(spark, no_broadcast):
    """Only the days move twice, and nothing moves for sums that are not asked for."""
    found = claims(spark, claim("a"), claim("b", mrn="2"))
    visits = revenue(spark, ("v1", "2024-01-05", 10.0))
    plan = explained(paid_periods(allocate_first_claim(found, visits)))
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len(moved) == 4  # two of days, one of claims, one of claims without key or days


def test_patients_with_many_claims(spark, monkeypatch):
    """The same claims and sums whether the claims of a patient meet in one task or are spread."""
    found = [
        claim(f"{i}", billed=f"2024-02-{i % 9 + 10}", start=f"2024-01-{i % 20 + 1:02}", end=f"2024-01-{i % 28 + 1:02}", mrn=str(i % 3), claim_number=str(i % 7))
        for i in range(60)
    ]
    found += [found[5], claim("n", mrn=None), claim("o", start=None), claim("p", end=None, mrn="0")]
    df = claims(spark, *found)
    visits = revenue(spark, *[(f"v{i}", f"2024-01-{i % 9 * 3 + 1:02}", float(i)) for i in range(18)])
    visits = visits.unionByName(visits.withColumn("mrn", F.lit("2")))
    plain = rows(allocate_first_claim(df, visits))
    monkeypatch.setattr(steps, "CROWD", 19)
    assert rows(allocate_first_claim(df, visits)) == plain and len(plain) > 20
    monkeypatch.setattr(steps, "CROWD", 0)
    assert rows(allocate_first_claim(df, visits)) == plain
