from __future__ import annotations

from datetime import date

from tests.frames import at, day, frame, rows
from visitledger.plans.episodes import (
    active_episodes,
    billing_periods,
    episode_set,
    managed_care_episodes,
    pdgm_episodes,
)
from visitledger.sources import schemas

D = date(2024, 3, 1)


def episode(ident: str | None, **changes) -> dict:
    base = {
        "unique_id": ident,
        "episode_identifier": "E1",
        "mrn": "1",
        "agency": "North",
        "insurance": " Medicare",
        "episode_start_date": day("2024-01-01"),
        "episode_end_date": day("2024-02-29"),
        "billing_period_start_date": day("2024-01-01"),
        "billing_period_end_date": day("2024-01-30"),
        "total_scheduled_visits": 5,
        "total_completed_visits": 4,
        "total_missed_visits": 0,
        "anticipated_30_day_payment": 1000.0,
        "updated_at": at("2024-02-01 00:00:00"),
    }
    return base | changes


def payers(spark, *found):
    return frame(spark, schemas.INSURANCE_MAP, list(found))


def pdgm(spark, episodes, *found):
    return pdgm_episodes(frame(spark, schemas.PDGM_EPISODES, episodes), payers(spark, *found), D)


def test_activity(spark):
    cases = [
        (1, 1, 0, True),
        (1, 0, 1, True),
        (1, 0, 0, False),
        (0, 1, 1, False),
        (None, 1, 1, False),
        (1, None, 1, True),  # NULL or true is true
        (1, None, 0, False),  # NULL or false is NULL
        (1, None, None, False),
    ]
    names = ("total_scheduled_visits", "total_completed_visits", "total_missed_visits", "ok")
    df = frame(
        spark,
        "total_scheduled_visits int, total_completed_visits int, total_missed_visits int, ok boolean",
        [dict(zip(names, c)) for c in cases],
    )
    assert rows(active_episodes(df).select("ok").distinct()) == [(True,)]
    assert active_episodes(df).count() == sum(c[3] for c in cases)


def test_versions_per_full_id_then_per_base_id(spark):
    found = [
        episode("X", billing_period=1),
        episode("X.1", billing_period=2, updated_at=at("2024-02-03 00:00:00")),
        # The newest version of X.2 is not active, so its older one does not count either.
        episode("X.2", billing_period=3, updated_at=at("2024-02-05 00:00:00")),
        episode("X.2", billing_period=4, total_scheduled_visits=0, updated_at=at("2024-02-06 00:00:00")),
        episode("X.1", billing_period=5, updated_at=at("2024-03-01 00:00:00")),
    ]
    assert rows(pdgm(spark, found), "unique_id", "billing_period") == [("X", 2)]


def test_payer_is_attached_once(spark):
    two = [
        {"insurance": "Medicare", "office": "North", "parent_insurance": p, "payment_multiplier": m}
        for p, m in (("b", 2.0), ("a", 0.5))
    ]
    got = pdgm(spark, [episode("X"), episode("Y", agency="South")], *two)
    assert rows(got, "unique_id", "parent_insurance", "payment_multiplier") == [
        ("X", "a", 0.5),
        ("Y", None, None),
    ]


def test_billing_periods_scale_payments(spark):
    payer = {"insurance": "Medicare", "office": "North", "payment_multiplier": 0.5}
    found = [episode("X", eoe_anticipated_payment=600.0), episode("Y", agency="South")]
    got = billing_periods(pdgm(spark, found, payer))
    columns = ("billing_period_id", "period_ongoing_revenue", "period_closed_revenue")
    assert rows(got, *columns) == [("X", 500.0, 300.0), ("Y", None, None)]


def test_managed_care_ids_keep_their_dots(spark):
    found = [
        {k: v for k, v in episode("M.1").items() if k in schemas.MC_EPISODES.names},
        {k: v for k, v in episode("M.2").items() if k in schemas.MC_EPISODES.names},
    ]
    got = managed_care_episodes(frame(spark, schemas.MC_EPISODES, found), payers(spark), D)
    assert rows(got, "unique_id", "insurance") == [("M.1", "Medicare"), ("M.2", "Medicare")]


def test_episode_set(spark):
    found = [
        episode("X", episode_end_date=day("2024-02-29")),
        episode("Y", episode_end_date=day("2024-01-31")),  # ends first: stands for E1
        episode("Z", episode_identifier=None),
        episode("W", episode_identifier=None, mrn="2", episode_end_date=day("2024-02-10")),
    ]
    managed = frame(
        spark,
        schemas.MC_EPISODES,
        [{k: v for k, v in episode("M.1").items() if k in schemas.MC_EPISODES.names}],
    )
    got = episode_set(pdgm(spark, found), managed_care_episodes(managed, payers(spark), D))
    assert rows(got, "episode_identifier", "mrn", "episode_end_date") == [
        (None, "2", day("2024-02-10")),  # rows without identifier count as one
        ("E1", "1", day("2024-01-31")),
        ("M.1", "1", day("2024-02-29")),
    ]
