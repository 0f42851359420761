from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.frames import day, explained, frame, rows
from visitledger import constants as k
from visitledger.operators import intervals
from visitledger.plans import revenue
from visitledger.plans.revenue import (
    episodic_payers,
    per_visit_payers,
    prorate_by_month,
    rate_card_revenue,
    revenue_fact,
    with_exceptions,
)
from visitledger.sources import schemas
from visitledger.sources.staging import stage

VISIT = (
    "unique_visit_id string, mrn string, agency string, visit_date date, task_name string,"
    " insurance string, payment_model string, total_hours double, episode_identifier string"
)
PERIOD = (
    "billing_period_id string, episode_identifier string, billing_period_start_date date,"
    " billing_period_end_date date, period_ongoing_revenue double, period_closed_revenue double,"
    " total_completed_visits bigint"
)


def visits(spark, *found):
    base = {
        "mrn": "1",
        "agency": "North",
        "visit_date": day("2024-01-10"),
        "task_name": "SN Visit",
        "insurance": "Cash",
        "total_hours": 1.25,
    }
    return frame(spark, VISIT, [base | v for v in found])


def test_ten_thousand_cards_of_one_key(spark, monkeypatch):
    """Priced by day: the same rows as card by card, overlaps and visits without a key included."""
    days = [{"visit_date": date(2000, 1, 1) + timedelta(days=i * 7), "unique_visit_id": str(i)} for i in range(900)]
    odd = [{"insurance": None, "unique_visit_id": "n"}, {"visit_date": None, "unique_visit_id": "d"}, {"agency": "South", "unique_visit_id": "s"}]
    df = visits(spark, *days, *odd)
    start = F.expr("date_add(DATE '1998-01-01', cast(id as int))")
    cards = spark.range(10_000).select(
        F.lit("Cash").alias("insurer"),
        F.lit("SN Visit").alias("task_name"),
        F.when(F.col("id") % 100 == 1, " south").otherwise("NORTH ").alias("location"),
        F.when(F.col("id") % 2 == 0, k.UNIT).otherwise(k.HOURLY).alias("type"),
        start.alias("from_date"),
        F.when(F.col("id") % 3000 == 0, F.lit(date(9999, 12, 31))).otherwise(F.date_add(start, (F.col("id") % 3).cast("int"))).alias("to_date"),
        F.col("id").cast("double").alias("rate"),
    )
    got = rate_card_revenue(df, cards)
    monkeypatch.setattr(revenue, "CROWD", 1 << 20)
    assert rows(got, *sorted(got.columns)) == rows(rate_card_revenue(df, cards), *sorted(got.columns))
    assert got.where("rate IS NOT NULL").count() > 900


def test_cards_of_a_day_meet_visits_as_lists(spark, monkeypatch):
    """A visit meets a row per list and not per card; every card is still paired, copies included."""
    df = visits(
        spark,
        *[{"unique_visit_id": str(i), "visit_date": date(2024, 1, 1 + i % 3), "total_hours": i / 8} for i in range(30)],
        {"unique_visit_id": "none valid", "visit_date": day("2023-01-01")},
        {"unique_visit_id": "no day", "visit_date": None},
        {"unique_visit_id": "no key", "insurance": None},
    )
    base = {"insurer": "Cash", "task_name": "SN Visit", "location": "North", "type": "Hourly", "from_date": day("2024-01-01")}
    found = [base | {"rate": i // 2 + 0.35, "to_date": date(2024, 1, 1 + i % 2)} for i in range(100)]
    cards = frame(spark, schemas.RATE_CARDS, [*found, base | {"rate": None, "to_date": day("2024-01-02"), "type": None}])
    staged, write = {}, stage

    def seen(df, name):
        staged[name] = write(df, name)
        return staged[name]

    monkeypatch.setattr(revenue, "stage", seen)
    monkeypatch.setattr(revenue, "CARD_LIST", 8)
    got = rate_card_revenue(df, cards)
    assert staged["cards_by_day"].count() == 13 + 7  # 101 cards on the first day, 51 on the second
    assert got.count() == 10 * 101 + 10 * 51 + 10 + 3
    monkeypatch.setattr(revenue, "CROWD", 1 << 20)
    assert rows(got, *sorted(got.columns)) == rows(rate_card_revenue(df, cards), *sorted(got.columns))


def test_bounds_of_crowded_cards_are_looked_up_once(spark, monkeypatch):
    """Cards with the same bounds do not go along with all days of their key one by one."""
    df = visits(spark, *[{"unique_visit_id": str(i), "visit_date": date(2024, 1, 1) + timedelta(days=i % 40)} for i in range(80)])
    base = {"insurer": "Cash", "task_name": "SN Visit", "location": "North", "type": "Unit"}
    first = [day("2024-01-05"), day("2024-01-09"), day("2024-02-08"), None]
    last = [day("2024-01-07"), day("9999-12-31"), day("2024-02-01"), day("2024-01-31")]  # the third ends before it begins
    cards = [base | {"rate": float(i // 2), "from_date": first[i % 4], "to_date": last[i % 4]} for i in range(400)]
    cards = frame(spark, schemas.RATE_CARDS, cards)
    looked_up, find = [], intervals._looked_up

    def seen(points, spans, *rest):
        looked_up.append(spans.count())
        return find(points, spans, *rest)

    monkeypatch.setattr(intervals, "_looked_up", seen)
    got = rate_card_revenue(df, cards)
    assert looked_up == [2]  # 200 rows with the two pairs of bounds before
    assert got.where("rate IS NOT NULL").count() == 100 * 2 * (3 + 32)
    monkeypatch.setattr(revenue, "CROWD", 1 << 20)
    assert rows(got, *sorted(got.columns)) == rows(rate_card_revenue(df, cards), *sorted(got.columns))


def test_visits_of_other_keys_do_not_move(spark, monkeypatch):
    """Cards of one crowded key hide how few the others are: these are written, so Spark knows and broadcasts them."""
    df = visits(spark, *[{"unique_visit_id": str(i), "agency": "North" if i % 3 == 0 else "West"} for i in range(30)])
    start = F.expr("date_add(DATE '2022-01-01', cast(id % 900 as int))")
    cards = spark.range(9_000).select(
        F.lit("Cash").alias("insurer"),
        F.lit("SN Visit").alias("task_name"),
        F.when(F.col("id") % 3000 == 0, "West").otherwise("North").alias("location"),
        F.lit(k.UNIT).alias("type"),
        start.alias("from_date"),
        F.lit(day("2024-06-30")).alias("to_date"),
        F.col("id").cast("double").alias("rate"),
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
        got = rate_card_revenue(df, cards)
        assert explained(got).count("SortMergeJoin") == 1  # the pairing; another one for the other visits before
        found = rows(got, *sorted(got.columns))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    monkeypatch.setattr(revenue, "CROWD", 1 << 20)
    assert found == rows(rate_card_revenue(df, cards), *sorted(got.columns))
    assert got.where("agency = 'West' AND rate IS NOT NULL").count() == 20 * 3


def test_payment_models(spark):
    df = visits(
        spark,
        {"unique_visit_id": "per visit", "payment_model": k.PER_VISIT},
        {"unique_visit_id": "unknown"},
        {"unique_visit_id": "episodic", "payment_model": k.EPISODIC},
        {"unique_visit_id": "other", "payment_model": "Capitated"},
        {"unique_visit_id": "unpriced", "task_name": "Aide Care Plan"},
        {"unique_visit_id": "no task", "task_name": None},
    )
    assert rows(per_visit_payers(df), "unique_visit_id") == [("per visit",), ("unknown",)]
    assert rows(episodic_payers(df), "unique_visit_id") == [("episodic",)]


def test_rate_cards(spark):
    cards = [
        {"type": "Hourly", "rate": 50.35, "from_date": day("2024-01-01"), "to_date": day("2024-01-31")},
        {"type": "Unit", "rate": 80.0, "from_date": day("2024-01-10"), "to_date": day("2024-01-10")},
        {"type": "Flat", "rate": 1.0, "from_date": day("2024-01-10"), "to_date": day("9999-12-31")},
        {"type": "Unit", "rate": 7.0, "from_date": day("2024-01-01")},  # open NULL end never matches
    ]
    base = {"insurer": "Cash", "task_name": "SN Visit", "location": " NORTH "}
    df = visits(
        spark,
        {"unique_visit_id": "a"},
        {"unique_visit_id": "b", "visit_date": day("2024-01-09")},
        {"unique_visit_id": "c", "insurance": None},
        {"unique_visit_id": "d", "visit_date": day("2024-01-09"), "total_hours": None},
    )
    got = rate_card_revenue(df, frame(spark, schemas.RATE_CARDS, [base | c for c in cards]))
    assert rows(got, "unique_visit_id", "rate_type", "revenue") == [
        ("a", "Flat", None),  # neither hourly nor unit
        ("a", "Hourly", 62.94),  # 62.9375 to cents
        ("a", "Unit", 80.0),
        ("b", "Hourly", 62.94),
        ("c", None, None),
        ("d", "Hourly", None),
    ]


def spread(spark, days, periods):
    df = visits(
        spark,
        *[
            {"unique_visit_id": n, "visit_date": day(d), "episode_identifier": e}
            for n, d, e in days
        ],
    )
    return prorate_by_month(df, frame(spark, PERIOD, periods))


def period(ident, start, end, **changes):
    base = {
        "billing_period_id": ident,
        "episode_identifier": "E",
        "billing_period_start_date": day(start),
        "billing_period_end_date": day(end),
        "period_ongoing_revenue": 3000.0,
        "total_completed_visits": 4,
    }
    return base | changes


def test_proration_over_a_month_end(spark):
    days = [
        ("jan 1", "2024-01-20", "E"),
        ("jan 2", "2024-01-20", "E"),
        ("feb", "2024-02-05", "E"),
        ("outside", "2024-03-01", "E"),
        ("no episode", "2024-01-20", None),
    ]
    got = spread(spark, days, [period("P", "2024-01-16", "2024-02-14")])
    columns = (
        "unique_visit_id",
        "billing_period_days_in_month",
        "prorate_percent",
        "visits_in_month",
        "ongoing_revenue",
        "closed_revenue",
    )
    january = 3000.0 * (16 / 31) / 2
    assert rows(got, *columns) == [
        ("feb", 14, 14 / 29, 1, 3000.0 * (14 / 29) / 1, None),
        ("jan 1", 16, 16 / 31, 2, january, None),
        ("jan 2", 16, 16 / 31, 2, january, None),
        ("no episode", None, None, None, None, None),
        ("outside", None, None, None, None, None),
    ]


def test_closed_revenue_and_division_by_zero(spark):
    periods = [
        period("P", "2024-01-01", "2024-01-30", period_closed_revenue=2000.0),
        period("Q", "2024-02-01", "2024-02-20", period_closed_revenue=2000.0, total_completed_visits=0),
    ]
    days = [("a", "2024-01-02", "E"), ("b", "2024-02-02", "E")]
    got = spread(spark, days, periods)
    assert rows(got, "unique_visit_id", "closed_revenue") == [("a", 500.0), ("b", None)]


def test_overlapping_periods_repeat_the_visit(spark):
    periods = [period("P", "2024-01-01", "2024-01-30"), period("Q", "2024-01-15", "2024-02-13")]
    days = [("a", "2024-01-02", "E"), ("b", "2024-01-20", "E")]
    got = spread(spark, days, periods)
    assert rows(got, "unique_visit_id", "billing_period_id", "visits_in_month") == [
        ("a", "P", 2),
        ("b", "P", 2),
        ("b", "Q", 1),
    ]


def test_period_without_id_counts_no_visits(spark):
    got = spread(spark, [("a", "2024-01-02", "E")], [period(None, "2024-01-01", "2024-01-30")])
    columns = ("visits_in_month", "ongoing_revenue", "billing_period_days_in_month")
    assert rows(got, *columns) == [(None, None, 30)]


def fact(spark, rated, prorated, flags=(), fixes=()):
    return revenue_fact(
        rated,
        prorated,
        frame(spark, schemas.PDGM_FLAGS, list(flags)),
        frame(spark, schemas.REVENUE_EXCEPTIONS, list(fixes)),
    )


def test_revenue_fact(spark):
    extra = VISIT + ", revenue double, rate_type string"
    rated = frame(
        spark,
        extra,
        [
            {"unique_visit_id": "priced", "agency": "N", "insurance": "M", "revenue": 5.0},
            {"unique_visit_id": "fixed", "agency": "N", "insurance": "X"},
            {"unique_visit_id": "unpriced", "agency": "S", "insurance": "M"},
        ],
    )
    prorated = frame(
        spark,
        VISIT + ", closed_revenue double, ongoing_revenue double",
        [
            {"unique_visit_id": "closed", "closed_revenue": 1.0, "ongoing_revenue": 2.0},
            {"unique_visit_id": "ongoing", "ongoing_revenue": 2.0},
        ],
    )
    flags = [
        {"office": "N", "insurance": "M", "pdgm_non_pdgm": "PDGM"},
        {"office": "N", "insurance": "X", "pdgm_non_pdgm": "Something"},
    ]
    fixes = [{"unique_id": u, "new_revenue": 9.0} for u in ("priced", "fixed")]
    got = fact(spark, rated, prorated, flags, fixes)
    assert got.columns == schemas.REVENUE.names
    assert rows(got, "unique_id", "revenue", "pdgm_non_pdgm") == [
        ("closed", 1.0, "Non PDGM"),
        ("fixed", 9.0, "Non PDGM"),
        ("ongoing", 2.0, "Non PDGM"),
        ("priced", 5.0, "PDGM"),
        ("unpriced", None, "Non PDGM"),
    ]


@pytest.mark.parametrize("copies", [1, 2])
def test_repeated_flags_and_exceptions_repeat_the_visit(spark, copies):
    rated = frame(
        spark,
        VISIT + ", revenue double",
        [{"unique_visit_id": "a", "agency": "N", "insurance": "M"}],
    )
    flag = {"office": "N", "insurance": "M", "pdgm_non_pdgm": "PDGM"}
    fixes = [{"unique_id": "a", "new_revenue": float(i)} for i in range(copies)]
    none = rated.where("false").withColumns(
        {c: F.lit(None).cast("double") for c in ("closed_revenue", "ongoing_revenue")}
    )
    got = fact(spark, rated, none, [flag] * copies, fixes)
    assert got.count() == copies * copies


def test_exceptions_brought_along(spark, no_broadcast):
    """The same fact whether exceptions are joined to priced visits or come with them, which then do not move."""
    found = [{"unique_visit_id": u, "agency": "N", "insurance": "M"} for u in ("a", "b", "c", None)]
    known = frame(spark, VISIT, found)
    fixes = [{"unique_id": u, "new_revenue": r} for u, r in (("a", 1.0), ("a", 2.0), ("b", None), ("b", None), (None, 4.0), ("z", 5.0))]
    exceptions = frame(spark, schemas.REVENUE_EXCEPTIONS, fixes)
    flags = frame(spark, schemas.PDGM_FLAGS, [])

    def priced(df):
        paid = {"closed_revenue": F.when(F.col("unique_visit_id") == "a", 9.0), "ongoing_revenue": F.lit(None).cast("double")}
        return df.withColumn("revenue", F.lit(None).cast("double")), df.withColumns(paid)

    joined = revenue_fact(*priced(known), flags, exceptions)
    brought = revenue_fact(*priced(with_exceptions(known, exceptions)), flags)
    assert rows(brought) == rows(joined) and joined.count() == 12
    wide = with_exceptions(known, exceptions).localCheckpoint()
    assert "(unique_id" not in explained(revenue_fact(*priced(wide), flags))
