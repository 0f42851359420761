"""Care episodes and billing periods."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitledger.functions import base_id, trim_ws
from visitledger.operators import as_of, first_per_key, latest_per_key, version_spans
from visitledger.plans.visits import insurance_lookup
from visitledger.sources.schemas import MC_EPISODES, PDGM_EPISODES, every_column

PDGM_DATES = (
    "dob",
    "soc_date",
    "episode_start_date",
    "episode_end_date",
    "billing_period_start_date",
    "billing_period_end_date",
    "first_billable_visit",
    "rap_date",
    "rap_payment_date",
    "take_back_date",
    "eoe_date",
    "eoe_payment_date",
    "referral_date",
)
PDGM_COUNTS = (
    "billing_period",
    "total_scheduled_visits",
    "total_completed_visits",
    "total_missed_visits",
    "sn",
    "pt",
    "ot",
    "st",
    "hha",
    "msw",
    "total_therapy_visits",
    "lupa_level",
    "number_of_outstanding_orders",
)
MANAGED_DATES = ("dob", "soc_date", "episode_start_date", "episode_end_date")
MANAGED_COUNTS = (
    "total_scheduled_visits",
    "total_completed_visits",
    "total_missed_visits",
    "total_orphan_visits",
    "sn",
    "pt",
    "ot",
    "st",
    "hha",
    "msw",
)

# Order among versions of an episode recorded at the same instant: these columns,
# then all others, so that versions that tie are equal.
_FIRST_PDGM_TIEBREAK = (
    "episode_start_date",
    "episode_end_date",
    "billing_period_start_date",
    "billing_period_end_date",
    "episode_identifier",
    "mrn",
    "agency",
    "insurance",
    "total_scheduled_visits",
    "total_completed_visits",
    "total_missed_visits",
    "billing_period",
    "lupa_level",
    "eoe_date",
    "anticipated_30_day_payment",
    "eoe_anticipated_payment",
)
_FIRST_MANAGED_TIEBREAK = (
    "episode_start_date",
    "episode_end_date",
    "mrn",
    "agency",
    "total_scheduled_visits",
    "total_completed_visits",
    "total_missed_visits",
)
PDGM_TIEBREAK = every_column(PDGM_EPISODES, _FIRST_PDGM_TIEBREAK, "unique_id", "updated_at")
MANAGED_TIEBREAK = every_column(MC_EPISODES, _FIRST_MANAGED_TIEBREAK, "unique_id", "updated_at")


def active_episodes(df: DataFrame) -> DataFrame:
    """Episodes with scheduled visits of which some were completed or missed."""
    scheduled = F.col("total_scheduled_visits")
    worked = (F.col("total_completed_visits") != 0) | (F.col("total_missed_visits") != 0)
    return df.where(scheduled.isNotNull() & (scheduled != 0) & worked)


def _tidy(df: DataFrame, dates: tuple[str, ...], counts: tuple[str, ...]) -> DataFrame:
    """Dates as date, counts as bigint, record number as text, payer trimmed."""
    typed = {c: F.col(c).cast("date") for c in dates}
    typed |= {c: F.round(c).cast("bigint") for c in counts}
    typed |= {"mrn": F.col("mrn").cast("string"), "insurance": trim_ws("insurance")}
    return df.withColumns({c: e for c, e in typed.items() if c in df.columns})


_ACTIVE = ("total_scheduled_visits", "total_completed_visits", "total_missed_visits")
_PAYER = ("parent_insurance", "insurance_type", "payment_model", "payment_multiplier")


def _read(columns: Sequence[str] | None) -> list[str] | None:
    """The columns of the history behind `columns` of the episodes."""
    if columns is None:
        return None
    looked_up = ("insurance", "agency") if set(columns) & set(_PAYER) else ()
    return list(dict.fromkeys([*(c for c in columns if c not in _PAYER), *looked_up, *_ACTIVE]))


def _with_payer(df: DataFrame, insurance_map: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    if columns is None or set(columns) & set(_PAYER):
        df = df.join(insurance_lookup(insurance_map), ["insurance", "agency"], "left")
    return df if columns is None else df.select(*columns)


def pdgm_episodes(
    episodes: DataFrame, insurance_map: DataFrame, day: date, columns: Sequence[str] | None = None
) -> DataFrame:
    """Latest active PDGM episode per base id, with its payer.

    The newest version is taken per full id first, and the newest of what is
    still active per id without suffix after that. With `columns` the result has
    these, and of the history only what they are made of is read and ranked.
    """
    known = as_of(episodes, "updated_at", day)
    latest = latest_per_key(known, ["unique_id"], "updated_at", PDGM_TIEBREAK, _read(columns))
    return current_pdgm(latest, insurance_map, columns)


def current_pdgm(latest: DataFrame, insurance_map: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`pdgm_episodes` once the newest version of every full id is known."""
    tidy = _tidy(active_episodes(latest), PDGM_DATES, PDGM_COUNTS)
    stripped = tidy.withColumn("unique_id", base_id("unique_id"))
    single = latest_per_key(stripped, ["unique_id"], "updated_at", PDGM_TIEBREAK, _read(columns))
    return _with_payer(single, insurance_map, columns)


def pdgm_spans(
    episodes: DataFrame, columns: Sequence[str] | None = None, days: Sequence[date] | None = None
) -> DataFrame:
    """The days, or which of `days`, each version of a PDGM episode is the newest on."""
    return version_spans(episodes, ["unique_id"], "updated_at", PDGM_TIEBREAK, _read(columns), days)


def managed_care_episodes(
    episodes: DataFrame, insurance_map: DataFrame, day: date, columns: Sequence[str] | None = None
) -> DataFrame:
    """Latest active managed-care episode per id, with its payer; ids keep dots.

    `columns` as for `pdgm_episodes`.
    """
    known = as_of(episodes, "updated_at", day)
    latest = latest_per_key(known, ["unique_id"], "updated_at", MANAGED_TIEBREAK, _read(columns))
    return current_managed(latest, insurance_map, columns)


def current_managed(latest: DataFrame, insurance_map: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`managed_care_episodes` once the newest version of every id is known."""
    return _with_payer(_tidy(active_episodes(latest), MANAGED_DATES, MANAGED_COUNTS), insurance_map, columns)


def managed_spans(
    episodes: DataFrame, columns: Sequence[str] | None = None, days: Sequence[date] | None = None
) -> DataFrame:
    """The days, or which of `days`, each version of a managed-care episode is the newest on."""
    return version_spans(episodes, ["unique_id"], "updated_at", MANAGED_TIEBREAK, _read(columns), days)


def episode_set(pdgm: DataFrame, managed: DataFrame) -> DataFrame:
    """Distinct episodes of both kinds: agency, patient, dates, identifier.

    PDGM rows are periods of an episode, so the earliest-ending one stands for
    its identifier. Managed-care ids are already unique.
    """
    order = [
        F.col("episode_end_date").asc_nulls_first(),
        F.col("episode_start_date").asc_nulls_first(),
        F.col("mrn").asc_nulls_first(),
        F.col("agency").asc_nulls_first(),
    ]
    columns = ["agency", "mrn", "episode_start_date", "episode_end_date", "episode_identifier"]
    first = first_per_key(pdgm.select(*columns), ["episode_identifier"], order)
    other = managed.withColumn("episode_identifier", F.col("unique_id").cast("string"))
    return first.unionByName(other.select(*columns)).distinct()


def billing_periods(pdgm: DataFrame) -> DataFrame:
    """Period payments scaled by the payer's multiplier; NULL if it has none."""
    factor = F.col("payment_multiplier")
    return pdgm.select(
        F.col("unique_id").alias("billing_period_id"),
        "episode_identifier",
        "billing_period_start_date",
        "billing_period_end_date",
        "billing_period",
        (F.col("anticipated_30_day_payment") * factor).alias("period_ongoing_revenue"),
        (F.col("eoe_anticipated_payment") * factor).alias("period_closed_revenue"),
        "total_scheduled_visits",
        "total_completed_visits",
        "lupa_level",
        "eoe_date",
    )
